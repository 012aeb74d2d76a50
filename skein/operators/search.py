"""Keyword, vector and hybrid search over retrieval units.

A search works on few candidates: keyword search cuts to three times the limit by BM25 before it ranks, and the
confidence gate and the rescaling of the semantic modes are aggregates that run before one final top-k.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.functions.text import preview_text, round_score
from skein.functions.vector import cosine
from skein.operators.lexical import bm25

# Evidence floor, confidence gate, tie-break weight, matches of a session, candidates a limit.
MIN_COSINE, MIN_CONFIDENT, TIE_BREAK = 0.15, 0.32, 0.005
MATCHES, CANDIDATES = 3, 3
DEFAULT_LIMIT, DETAIL_LIMIT, MAX_LIMIT = 5, 50, 100


def _all():
    """All rows: used on few rows alone."""
    return Window.partitionBy()


def normalize_limit(value: float | None, fallback: int = DEFAULT_LIMIT) -> int:
    if value is None or not math.isfinite(value) or value <= 0:
        return fallback
    return min(MAX_LIMIT, max(1, math.floor(value))) if value >= 1 else fallback


def normalize_mode(mode: str | None) -> str:
    return mode if mode in ("keyword", "vector") else "hybrid"


def scope(rows: DataFrame, tools: list[str] | None = None, branches: list[str] | None = None) -> DataFrame:
    """Tool and branch filters; an empty list does not filter, a set one leaves null branches out."""
    for column, wanted in (("tool", tools), ("git_branch", branches)):
        wanted = list(dict.fromkeys(w for w in wanted or [] if w))
        if wanted:
            rows = rows.filter(F.col(column).isin(wanted))
    return rows


def recency(ended: Column, oldest: Column, newest: Column) -> Column:
    at, low, high = (c.cast("double") for c in (ended, oldest, newest))
    return F.when(at.isNull() | (high <= low), 1.0).otherwise(F.least(F.greatest((at - low) / (high - low), F.lit(0.0)), F.lit(1.0)))


def continuity(end_index: Column, count: Column) -> Column:
    return F.when(count <= 1, 1.0).otherwise(F.least(F.greatest(end_index / (count - 1), F.lit(0.0)), F.lit(1.0)))


def keyword_ranks(index: DataFrame, stats: DataFrame, units: DataFrame, sessions: DataFrame, query: str, limit: int, tools=None, branches=None) -> DataFrame:
    """The best 3 x limit units by BM25 (newer first on ties) with pos (from 1) and keyword_score."""
    named = sessions.select("session_ref", "git_branch", "message_count")
    hits = bm25(index, stats, query).join(units, "unit_id").join(named, "session_ref")
    top = scope(hits, tools, branches).orderBy("bm25", F.desc("ended_at"), "unit_id").limit(CANDIDATES * limit)
    pos = F.row_number().over(_all().orderBy("bm25", F.desc("ended_at"), "unit_id"))  # at most 300 rows
    return top.withColumn("pos", pos).withColumn("keyword_score", 1 / F.col("pos"))


def grouped(ranked: DataFrame, limit: int) -> DataFrame:
    """Sessions of ranked units, as a walk in order of ``pos`` meets them until the limit-th session appears.

    One row per match (at most three a session): session_rank, session score and relevance, and the unit's columns.
    """
    by_session = Window.partitionBy("session_ref")
    seen = ranked.withColumn("first_pos", F.min("pos").over(by_session))
    firsts = F.dense_rank().over(_all().orderBy("first_pos"))
    seen = seen.withColumn("met", firsts)
    cut = F.max(F.when(F.col("met") == limit, F.col("first_pos"))).over(_all())
    walked = seen.withColumn("cut", cut).filter((F.col("met") <= limit) & (F.col("cut").isNull() | (F.col("pos") <= F.col("cut"))))
    walked = walked.withColumns({"session_score": F.max("score").over(by_session), "session_relevance": F.max("relevance").over(by_session), "match": F.row_number().over(by_session.orderBy("pos"))})
    walked = walked.withColumn("session_rank", F.dense_rank().over(_all().orderBy(F.desc("session_score"), "first_pos")))
    return walked.filter(F.col("match") <= MATCHES).drop("first_pos", "met", "cut")


def _limited(scored: DataFrame, limit: int) -> DataFrame:
    """The units that can matter for ``limit`` sessions: those of the first ``limit`` sessions by best score."""
    order = [F.desc("score"), F.desc("ended_at"), "unit_id"]
    best = scored.groupBy("session_ref").agg(F.max(F.struct("score", "ended_at")).alias("b")).orderBy(F.desc("b.score"), F.desc("b.ended_at")).limit(limit + 1)
    near = scored.join(F.broadcast(best.select("session_ref")), "session_ref", "left_semi")
    return near.withColumn("pos", F.row_number().over(_all().orderBy(*order)))


def keyword_search(index, stats, units, sessions, query: str, limit: int = DEFAULT_LIMIT, tools=None, branches=None) -> DataFrame:
    ranks = keyword_ranks(index, stats, units, sessions, query, limit, tools, branches)
    rec = recency(F.col("ended_at"), F.min("ended_at").over(_all()), F.max("ended_at").over(_all()))
    scored = ranks.withColumns({"recency_score": rec, "continuity_score": continuity(F.col("message_end_index"), F.col("message_count")), "semantic_score": F.lit(0.0), "relevance": F.lit(None).cast("double")})
    return grouped(scored.withColumn("score", 0.75 * F.col("keyword_score") + 0.15 * F.col("recency_score") + 0.1 * F.col("continuity_score")), limit)


def semantic_search(units: DataFrame, vectors: DataFrame, sessions: DataFrame, query_vector: list[float], limit: int = DEFAULT_LIMIT, keyword: DataFrame | None = None, tools=None, branches=None) -> DataFrame:
    """Vector search, or hybrid search where ``keyword`` (unit_id, keyword_score) is given.

    Only units that have a vector take part, keyword hits included.
    """
    named = sessions.select("session_ref", "git_branch", "message_count")
    rows = scope(units.join(vectors.select("unit_id", "vector"), "unit_id").join(named, "session_ref"), tools, branches)
    rows = rows.withColumn("cosine", cosine(F.col("vector"), F.array(*map(F.lit, query_vector)))).drop("vector")
    rows = rows.join(F.broadcast(keyword.select("unit_id", "keyword_score")), "unit_id", "left") if keyword is not None else rows.withColumn("keyword_score", F.lit(None).cast("double"))
    rows = rows.withColumn("keyword_score", F.coalesce("keyword_score", F.lit(0.0)))
    span = rows.agg(F.min("ended_at").alias("oldest"), F.max("ended_at").alias("newest"))
    known = rows.filter((F.col("cosine") >= MIN_COSINE) | (F.col("keyword_score") > 0))
    best = known.agg(F.coalesce(F.max("cosine"), F.lit(0.0)).alias("best"))
    left = known.crossJoin(F.broadcast(best)).filter((F.col("best") >= MIN_CONFIDENT) | (F.col("keyword_score") > 0)).drop("best")
    edge = left.agg(F.min("cosine").alias("low"), F.max("cosine").alias("high"))
    left = left.crossJoin(F.broadcast(edge)).crossJoin(F.broadcast(span))
    semantic = F.when(F.col("high") > F.col("low"), (F.col("cosine") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(1.0)
    left = left.withColumns({"semantic_score": semantic, "recency_score": recency(F.col("ended_at"), F.col("oldest"), F.col("newest")), "continuity_score": continuity(F.col("message_end_index"), F.col("message_count")), "relevance": F.least(F.greatest("cosine", F.lit(0.0)), F.lit(1.0))})
    tie = TIE_BREAK * (0.5 * F.col("recency_score") + 0.5 * F.col("continuity_score"))
    blend = F.col("semantic_score") + tie if keyword is None else 0.8 * F.col("semantic_score") + 0.2 * F.col("keyword_score") + tie
    return grouped(_limited(left.withColumn("score", blend), limit), limit)


def match_rows(found: DataFrame) -> DataFrame:
    """Flat result rows of a search: one per match, scores rounded to three places."""
    scores = {c: round_score(F.col(c)) for c in ("relevance", "semantic_score", "keyword_score", "recency_score", "continuity_score")}
    return found.select("session_rank", "session_ref", "session_score", "session_relevance", "match", "unit_id", "message_start_index", "message_end_index", preview_text(F.col("content")).alias("preview"), *(c.alias(n) for n, c in scores.items()))


def ranking_metrics(ranked: DataFrame, queries: DataFrame) -> DataFrame:
    """mrr, recall_at_5 and top1 over all ``queries``; ``ranked`` has query_id and rank of the first right result."""
    rows = queries.join(ranked, "query_id", "left")
    hit = lambda c: F.avg(F.coalesce(c.cast("double"), F.lit(0.0)))
    return rows.agg(round_score(hit(1 / F.col("rank"))).alias("mrr"), round_score(hit(F.col("rank") <= 5)).alias("recall_at_5"), round_score(hit(F.col("rank") == 1)).alias("top1"))


def nearest(queries: DataFrame, vectors: DataFrame, k: int, block: int = 8192, asked: int = 1024) -> DataFrame:
    """query_id, vec_id, cosine (six places) and rank of the ``k`` vectors nearest to each query, itself left out; ties to the smaller id.

    ``queries`` (query_id, q) and ``vectors`` (vec_id, embedding) meet in blocks of bounded size, of which each keeps k results a query.
    """
    parts = max(1, -(-vectors.count() // block))
    blocks = max(1, -(-queries.count() // asked))
    salt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("query_id", F.col("q").cast("array<double>").alias("q"), salt("query_id", blocks).alias("b")).withColumn("p", each(parts))
    right = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"), salt("vec_id", parts).alias("p")).withColumn("b", each(blocks))

    def meet(some: pd.DataFrame, against: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "cosine": []}
        if len(some) and len(against):
            q, v, ids = np.stack(some.q), np.stack(against.v), against.vec_id.to_numpy()
            size = np.maximum(np.sqrt((q**2).sum(1))[:, None] * np.sqrt((v**2).sum(1)), 1e-300)
            scores = np.round(q @ v.T / size, 6)
            for i, query in enumerate(some.query_id):
                order = [j for j in np.lexsort((ids, -scores[i]))[: k + 1] if ids[j] != query][:k]
                out["query_id"] += [query] * len(order)
                out["vec_id"] += ids[order].tolist()
                out["cosine"] += scores[i][order].tolist()
        return pd.DataFrame(out)

    found = left.groupBy("b", "p").cogroup(right.groupBy("b", "p")).applyInPandas(meet, "query_id long, vec_id long, cosine double")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id"))).filter(F.col("rank") <= k)
