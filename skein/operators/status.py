"""Session queries: recent, detail, by reference, manifest, status and the active session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.text import truncate_content
from skein.operators.search import DETAIL_LIMIT, normalize_limit, scope
from skein.schema import TOOLS


def recent_sessions(sessions: DataFrame, limit: float | None = None, tools=None, branches=None) -> DataFrame:
    return scope(sessions, tools, branches).orderBy(F.desc("last_activity_at"), "session_ref").limit(normalize_limit(limit))


def session_detail(messages: DataFrame, ref: str, offset: int = 0, limit: float | None = None) -> DataFrame:
    """One page of a session in order, contents cut to the message limit."""
    rows = messages.filter(F.col("session_ref") == ref).orderBy("ts", "message_index", "id")
    return rows.offset(max(0, int(offset))).limit(normalize_limit(limit, DETAIL_LIMIT)).withColumn("content", truncate_content(F.col("content")))


def by_ref(sessions: DataFrame, ref: str) -> DataFrame:
    return sessions.filter(F.col("session_ref") == ref)


def resolve_refs(sessions: DataFrame, refs: list[str]) -> DataFrame:
    """Requested sessions in order of request, each once; ``missing`` where none is stored."""
    wanted = list(dict.fromkeys(r.strip() for r in refs if r and r.strip()))
    rows = sessions.sparkSession.createDataFrame(list(enumerate(wanted)), "position int, session_ref string")
    return rows.join(sessions.filter(F.col("session_ref").isin(wanted)), "session_ref", "left").withColumn("missing", F.col("tool").isNull())


def tool_status(sessions: DataFrame, messages: DataFrame, tools: tuple[str, ...] = TOOLS, newest: str = "ts") -> DataFrame:
    """Every tool of the catalogue with its counts, zero where nothing is stored.

    Messages are counted per session before they meet the sessions, so that the join moves one row per session.
    """
    per = messages.groupBy("session_ref").agg(F.count("*").alias("n"), F.max(newest).alias("newest"))
    counts = sessions.select("session_ref", "tool").join(per, "session_ref", "left")
    counts = counts.groupBy("tool").agg(F.count("*").alias("indexed_sessions"), F.sum("n").alias("indexed_messages"), F.max("newest").alias("newest"))
    known = sessions.sparkSession.createDataFrame([(t,) for t in tools], "tool string")
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("indexed_sessions", "indexed_messages")}
    return known.join(counts, "tool", "left").withColumns(zero)


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    rows = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def active(sessions: DataFrame, now: Column) -> DataFrame:
    """The newest session, if its last activity is within a day of ``now``."""
    newest = sessions.orderBy(F.desc("last_activity_at"), "session_ref").limit(1)
    return newest.filter(now - F.col("last_activity_at") <= F.expr("INTERVAL 24 HOURS"))
