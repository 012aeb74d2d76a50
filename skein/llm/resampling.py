"""Importance resampling of documents towards a target distribution (hashed n-gram features, Gumbel top-k).

Identical texts are collapsed first: rows are grouped by their full text, every distinct text gets its features
and its weight once, its counts are multiplied by its multiplicity, and the weight is joined back to the rows by the text's SHA-256 before
noise of the single document is added. Buckets are a fixed number (``buckets``), so the table of gains has a size
known beforehand and goes to every task; everything else is shuffled.

The draw takes the rows in order of falling score: rows are dealt by ranges of (score, doc_id), numbered where they lie, and the number
of rows in the ranges before, one figure a range, is added. No task sees all scores.

Defined results: a null or empty text has no features and weight 0; a null doc_id is the empty text in the noise and
goes before others of equal score; rows with one doc_id and one text share their score and take successive ranks, while
the same doc_id with other texts has the same noise; an empty table gives an empty result, and an empty target makes every gain
depend on the documents alone; further columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.common import byte_texts, map_batches, materialize, text_slices

BUCKETS = 10_000
LONGEST = 1
SEED = 2024
PERCENT = 10
MIN_WORDS = 20

_LETTERS = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B))
#: Bytes of words stand for themselves (A-Z in lower case), all others for a space.
_WORD_BYTES = bytes(b if b > 0x7F or b in _LETTERS else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_WORD_BYTES).split()


def feature_counts(text: bytes | None, longest: int = LONGEST, buckets: int = BUCKETS) -> tuple[int, list[int], list[int]]:
    """Number of words, and buckets with their counts, of all runs of 1 to ``longest`` words."""
    ws = words(text)
    held = Counter(ws)
    for n in range(2, longest + 1):
        held.update(b" ".join(ws[i : i + n]) for i in range(len(ws) - n + 1))
    return len(ws), [zlib.crc32(f) % buckets for f in held], list(held.values())


def features(texts: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """The rows of ``texts`` with n_words, n_features, buckets and counts in place of ``text``."""
    others = [f for f in texts.schema if f.name != "text"]
    more = [("n_words", T.LongType(), pa.int64()), ("n_features", T.LongType(), pa.int64()), ("buckets", T.ArrayType(T.IntegerType()), pa.list_(pa.int32())), ("counts", T.ArrayType(T.LongType()), pa.list_(pa.int64()))]
    out = T.StructType([*others, *(T.StructField(n, t) for n, t, _ in more)])

    def describe(text: bytes | None) -> tuple:
        n_words, at, counts = feature_counts(text, longest, buckets)
        return n_words, sum(counts), at, counts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                columns = zip(*map(describe, byte_texts(part, "text")), strict=True)
                yield pa.record_batch([*(part.column(f.name) for f in others), *(pa.array(c, kind) for c, (_, _, kind) in zip(columns, more, strict=True))], out.names)

    return map_batches(texts, run, out)


def _flat(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False)


def bucket_totals(feats: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in every bucket, repeats of a text by its ``copies`` included. Each task adds up its own, at most ``buckets`` rows leave it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            copies = np.repeat(batch.column("copies").to_numpy(), np.diff(batch.column("buckets").offsets.to_numpy()))
            np.add.at(total, _flat(batch, "buckets"), _flat(batch, "counts") * copies)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array(total[at])], ["bucket", "n"])

    totals = np.zeros(buckets, np.int64)
    for r in map_batches(feats.select("copies", "buckets", "counts"), run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        totals[r.bucket] = r.n
    return totals


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the smoothed ratio of shares) for every bucket, in doubles."""
    n, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weigh(feats: DataFrame, gain: np.ndarray) -> DataFrame:
    """digest, n_words, n_features and weight of every distinct text."""
    kept = ["digest", "n_words", "n_features"]
    out = T.StructType([*(feats.schema[c] for c in kept), T.StructField("weight", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = np.concatenate([[0], np.cumsum(gain[_flat(batch, "buckets")] * _flat(batch, "counts"))])
            ends = np.cumsum(np.concatenate([[0], np.diff(batch.column("buckets").offsets.to_numpy())]))
            yield pa.record_batch([*(batch.column(c) for c in kept), pa.array(np.diff(sums[ends]), pa.int64())], out.names)

    return map_batches(feats.select(*kept, "buckets", "counts"), run, out)


def distinct_texts(docs: DataFrame) -> DataFrame:
    """text (null as empty) and copies of every distinct text."""
    return docs.groupBy(F.coalesce("text", F.lit("")).alias("text")).agg(F.count("*").alias("copies"))


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def weights(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """digest, n_words, n_features and weight of every distinct text of ``docs``, against the texts of ``target``."""
    source = materialize(features(distinct_texts(docs).withColumn("digest", digest(F.col("text"))), longest, buckets))
    wanted = features(distinct_texts(target), longest, buckets)
    return weigh(source, gains(bucket_totals(source, buckets), bucket_totals(wanted, buckets)))


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """floor(1000 x Gumbel noise) from the first 8 hexadecimal digits of sha256(seed:doc_id)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def draw(scored: DataFrame, percent: float = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """``scored`` (a written table) with ``rank``: 1, 2, 3 for the highest scores of rows with ``min_words`` words, null for what is not drawn."""
    fit = F.coalesce(F.col("n_words") >= min_words, F.lit(False))
    n_drawn = math.floor(percent * scored.filter(fit).count() / 100)
    order = [F.desc("fit"), F.desc("score"), F.asc_nulls_first("doc_id")]
    ranged = scored.withColumn("fit", fit).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialize(ranged.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}))
    before, starts = 0, []
    for r in sorted(placed.groupBy("part").count().collect()):  # one row for each range
        starts.append((r.part, before))
        before += r["count"]
    starts = scored.sparkSession.createDataFrame(starts, "part int, before long")
    rank = F.col("at") + F.col("before") + 1
    return placed.join(F.broadcast(starts), "part").withColumn("rank", F.when(F.col("fit") & (rank <= n_drawn), rank)).drop("part", "at", "before", "fit")


def resample(docs: DataFrame, target: DataFrame, percent: float = PERCENT, longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document."""
    weighed = weights(docs, target, longest, buckets)
    rows = docs.select("doc_id", digest(F.coalesce("text", F.lit(""))).alias("digest"))
    scored = rows.join(weighed, "digest").select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + gumbel(F.col("doc_id"), seed)).alias("score"))
    return draw(materialize(scored), percent, min_words).select("doc_id", "n_features", "weight", "score", "rank")


#: crc32 as the bitwise rule that defines it, over the bytes of a value (its hexadecimal digits in pairs).
CRC32_SQL = """
crc_table AS (
  SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, b)) AS tbl)
""".strip()


def crc32_sql(value: str) -> str:
    """SQL for crc32 of the UTF-8 bytes of ``value``, with crc_table's ``tbl`` in scope."""
    return f"""xor(list_reduce(list_transform(range(strlen({value})), lambda i: ('0x' || hex(encode({value}))[2 * i + 1 : 2 * i + 2])::BIGINT),
      lambda c, b: xor(c // 256, tbl[(xor(c, b) % 256) + 1]), 4294967295::BIGINT), 4294967295::BIGINT)"""


ORACLE_SQL = rf"""
WITH {CRC32_SQL},
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
dw AS (SELECT r, word, count(*) AS n FROM (SELECT r, unnest(ws) AS word FROM d) GROUP BY ALL),
bw AS (SELECT word, count(*) AS n FROM (SELECT unnest(ws) AS word FROM b) GROUP BY ALL),
code AS MATERIALIZED (SELECT word, {crc32_sql("word")} % {BUCKETS} AS bucket FROM (SELECT word FROM dw UNION SELECT word FROM bw), crc_table),
s AS (SELECT bucket, sum(n) AS s FROM dw JOIN code USING (word) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS t FROM bw JOIN code USING (word) GROUP BY bucket),
total AS (SELECT (SELECT coalesce(sum(s), 0) FROM s)::DOUBLE AS sa, (SELECT coalesce(sum(t), 0) FROM t)::DOUBLE AS ta),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (sa + {BUCKETS}) / ((s + 1)::DOUBLE * (ta + {BUCKETS}))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket), total),
w AS (SELECT r, sum(n * gain)::BIGINT AS weight FROM dw JOIN code USING (word) JOIN gain USING (bucket) GROUP BY r),
scored AS (
  SELECT doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('{SEED}:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM d LEFT JOIN w USING (r)),
ranked AS (SELECT *, n_features >= {MIN_WORDS} AS fit, row_number() OVER (PARTITION BY n_features >= {MIN_WORDS} ORDER BY score DESC, doc_id NULLS FIRST) AS place, count(*) FILTER (n_features >= {MIN_WORDS}) OVER () AS fits FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND place <= floor({PERCENT} * fits / 100) THEN place END AS rank FROM ranked
"""
