"""Resampling against plain counts and against its SQL."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from conftest import DATA
from skein.llm import queries, resampling

SCHEMA = "doc_id long, text string, source string"
ROWS = [(1, None, "a"), (2, "", "a"), (3, "Alpha beta ALPHA déjà 12", "b"), (None, "alpha beta gamma " * 9, "b"), (4, "Alpha beta ALPHA déjà 12", None), *((i, "same words again and again " * 8, "hot") for i in range(10, 30)), (30, "x" * 100_000 + " y" * 50_000, "c"), (31, "twin " * 25, "c"), (31, "twin " * 25, "c")]
TARGET = [(0, "alpha beta"), (1, None), (2, "gamma gamma delta"), (3, "gamma gamma delta")]


def plain(rows, target, longest, percent, min_words, buckets=10_000):
    def tokens(text):
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
        return ws, [" ".join(ws[i : i + n]) for n in range(1, longest + 1) for i in range(len(ws) - n + 1)]

    def count(texts):
        return Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in tokens(t)[1])

    s, t = count(x[1] for x in rows), count(x[1] for x in target)
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in s}
    out = []
    for doc_id, text, *_ in rows:
        ws, fs = tokens(text)
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] for f in fs)
        out.append((doc_id, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(ws)))
    fit = sorted((r for r in out if r[4] >= min_words), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    drawn = fit[: math.floor(percent * len(fit) / 100)]
    return Counter((*r[:4], None) for r in out) - Counter((*r[:4], None) for r in drawn) + Counter((*r[:4], i) for i, r in enumerate(drawn, 1))


@pytest.mark.parametrize(("longest", "percent", "min_words"), [(1, 10, 20), (2, 40, 20), (3, 100, 1)])
def test_resampling_equals_plain_counts(spark, longest, percent, min_words):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(5).withColumns({c: F.lit("clash") for c in ("digest", "copies", "n_words", "weight", "score", "part", "at", "fit", "rank", "before")})
    got = resampling.resample(docs, spark.createDataFrame(TARGET, "item_id long, text string"), percent, longest, min_words=min_words)
    assert got.dtypes == [("doc_id", "bigint"), *((c, "bigint") for c in ("n_features", "weight", "score", "rank"))]
    assert Counter(map(tuple, got.collect())) == plain(ROWS, TARGET, longest, percent, min_words)


def test_resampling_without_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert resampling.resample(none, none).collect() == []
    got = resampling.resample(spark.createDataFrame(ROWS, SCHEMA), none)
    assert Counter(map(tuple, got.collect())) == plain(ROWS, [], 1, 10, 20)


def test_each_text_is_weighed_once(spark):
    """Identical texts give one row of weights, however many rows hold them, and count as often as they are there."""
    docs = spark.createDataFrame(ROWS, SCHEMA)
    feats = resampling.features(resampling.distinct_texts(docs))
    assert feats.count() == len({r[1] or "" for r in ROWS})
    assert resampling.bucket_totals(feats)[zlib.crc32(b"again") % 10_000] == 20 * 16


def test_resampling_sql(spark):
    with duckdb.connect() as db:
        for t in ("documents", "benchmark"):
            db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
        want = db.sql(resampling.ORACLE_SQL)
        got = queries.op11_target_resampling(spark, DATA).select(*want.columns)
        assert Counter(map(tuple, got.collect())) == Counter(want.fetchall())
