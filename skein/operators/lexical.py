"""Inverted index and BM25 as DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.text import document_terms, query_phrases

# Okapi constants and the floor of the inverse document frequency.
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6


def postings(units: DataFrame) -> DataFrame:
    """unit_id, term, tf and positions over the searchable text alone."""
    terms = units.select("unit_id", F.posexplode(document_terms(F.col("searchable_text"))).alias("pos", "term"))
    return terms.groupBy("unit_id", "term").agg(F.count("*").cast("int").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))


def unit_stats(units: DataFrame) -> DataFrame:
    return units.select("unit_id", F.size(document_terms(F.col("searchable_text"))).alias("doc_len"))


def phrase_parts(phrase: str) -> list[str]:
    """Index terms of one search term (ASCII, so that only punctuation separates)."""
    return [t for t in "".join(c if c.isalnum() else " " for c in phrase).split() if t]


def phrase_hits(index: DataFrame, phrases: list[list[str]]) -> DataFrame:
    """unit_id, phrase (number) and tf of every phrase that a unit holds; terms of a phrase stand side by side."""
    wanted = sorted({t for p in phrases for t in p})
    if not wanted:
        return index.select("unit_id", F.lit(0).alias("phrase"), F.lit(0).alias("tf")).limit(0)
    held = index.filter(F.col("term").isin(wanted))
    held = held.groupBy("unit_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("at"))

    def shift(positions, by: int):
        return F.transform(positions, lambda p: p - by)

    def count(parts: list[str]):
        shifted = [shift(F.col("at")[t], i) for i, t in enumerate(parts)]
        return F.coalesce(F.size(reduce(F.array_intersect, shifted)), F.lit(0)) if len(shifted) > 1 else F.coalesce(F.size(shifted[0]), F.lit(0))

    counts = F.array(*(F.when(F.col("at")[p[0]].isNull(), 0).otherwise(count(p)) for p in phrases))
    return held.select("unit_id", F.posexplode(counts).alias("phrase", "tf")).filter("tf > 0")


def bm25(index: DataFrame, stats: DataFrame, query: str) -> DataFrame:
    """unit_id and bm25 (lower is better) of the units that hold any phrase of ``query``.

    Statistics cover the whole index, before any filter; the query's few phrases are the only rows that meet.
    """
    phrases = [p for q in query_phrases(query) if (p := phrase_parts(q))]
    hits = phrase_hits(index, phrases)
    whole = stats.agg(F.count("*").alias("n"), F.avg("doc_len").alias("avgdl"))
    df = hits.groupBy("phrase").agg(F.count("*").alias("df")).crossJoin(F.broadcast(whole))
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(IDF_FLOOR))
    df = df.select("phrase", idf.alias("idf"), "avgdl")
    scored = hits.join(F.broadcast(df), "phrase").join(stats, "unit_id")
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("doc_len") / F.col("avgdl")))
    return scored.groupBy("unit_id").agg((-F.sum(part)).alias("bm25"))
