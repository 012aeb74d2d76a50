"""The corpus pipeline: quality rules, near-dedup, redaction, mixing and packing of ``documents``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet in the shared
folder and reread as the next stage's docs; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skein.llm import mixing, packing, pii, quality, simhash
from skein.llm.common import materialize, read_table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without the lines that too many documents of their source share."""
    return quality.clean(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: Jaccard 0.8 or more of their five-word shingles."""
    return simhash.deduplicate(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind in brackets."""
    return pii.redact(docs, pii.train(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once, those of small sources as often as their weight asks for, in the order of the mixture's blocks."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens and their places in sequences of 4096."""
    return packing.pack_documents(docs, cache_words=300_000)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("redact_personal_data", redact_personal_data),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: Tokenisers, fingerprints and boosted trees have no SQL form; the tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
