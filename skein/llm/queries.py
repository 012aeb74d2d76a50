"""One query per operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import ann, langid, mixing, packing, pieces, pii, quality, resampling, secrets, sharding, simhash, toxicity, trie
from skein.llm.common import hadoop_fs, read_table, shared_dir


def fold(n: int) -> Column:
    """crc32 of doc_id as text, modulo ``n``."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    learn = docs.filter(fold(5) != 0).select("doc_id", "text").join(labels.select("doc_id", "toxic"), "doc_id").select("doc_id", "text", "toxic")
    return toxicity.score(docs, toxicity.train(learn), F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(read_table(spark, sf_dir, "documents"))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return pii.find(docs, pii.train(docs))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    langs, net = langid.train(docs.filter(fold(4) != 2))
    return langid.identify(docs, langs, net, F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.schedule(read_table(spark, sf_dir, "documents")).drop("place")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read_table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen arrivals, compacted; the rows as the newest manifest has them, and how many tiers it leaves to merge."""
    docs, root = read_table(spark, sf_dir, "documents"), shared_dir(spark)
    fs, path = hadoop_fs(spark, root)
    fs.deleteOnExit(path)
    table = sharding.ShardedTable(spark, root)
    table.append_arrivals(docs.withColumn("arrival", F.coalesce(F.pmod("doc_id", F.lit(16)), F.lit(0))), "arrival")
    version = table.compact()
    table.expire()
    rows = table.read(version).select("doc_id", "arrival", F.octet_length("text").cast("long").alias("n_bytes"), F.md5("text").alias("text_md5"))
    return rows.withColumn("full_tiers", F.lit(len(table.full_tiers(version))))


def op11_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(read_table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(read_table(spark, sf_dir, "conversations"))


OP10_SQL = "SELECT doc_id, coalesce(doc_id % 16, 0) AS arrival, strlen(text)::BIGINT AS n_bytes, md5(text) AS text_md5, 0 AS full_tiers FROM documents"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_quality_rules": op2_quality_rules,
    "op3_personal_data": op3_personal_data,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_nearest_neighbours": op5_nearest_neighbours,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_language_id": op7_language_id,
    "op8_source_mixing": op8_source_mixing,
    "op9_secret_scan": op9_secret_scan,
    "op10_sharding": op10_sharding,
    "op11_target_resampling": op11_target_resampling,
    "op12_sentencepiece": op12_sentencepiece,
    "op13_prefix_trie": op13_prefix_trie,
}
ORACLE_SQL: dict[str, str] = {"op2_quality_rules": quality.ORACLE_SQL, "op10_sharding": OP10_SQL, "op11_target_resampling": resampling.ORACLE_SQL, "op13_prefix_trie": trie.ORACLE_SQL}
