"""Chunks to messages and sessions: identity, idempotent insert, merge and rollup.

Everything is a function of tables, so that batch and streaming runs share it; ``skein.operators.store`` keeps the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.functions.text import PREVIEW_CHARS, hash_parts, iso_time, trim_space


def message_id() -> Column:
    return hash_parts(F.col("tool"), F.col("session_id"), iso_time(F.col("ts")), F.col("role"), F.col("message_index"), F.col("content"))


def to_messages(chunks: DataFrame, project_root: str = "") -> DataFrame:
    """Message rows with content-derived ids; blank contents are left out, equal messages are one."""
    real = chunks.filter(F.length(trim_space(F.col("content"))) > 0)
    rows = real.select(
        message_id().alias("id"),
        F.concat_ws(":", "tool", "session_id").alias("session_ref"),
        "tool",
        F.col("session_id").alias("source_session_id"),
        "ts",
        "role",
        "content",
        "message_index",
        F.sha2("content", 256).alias("content_hash"),
        "metadata",
        F.col("metadata.source_path").alias("source_pointer"),
    )
    return rows.dropDuplicates(["id"])


def new_messages(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Insert or ignore: rows whose id is not stored yet."""
    return incoming.join(stored.select("id"), "id", "left_anti")


def after_cutoff(chunks: DataFrame, since: Column, epoch_always: bool = True) -> DataFrame:
    """Rows newer than ``since``; a full sync (since the epoch) emits rows at the epoch too, unless the source forbids it."""
    newer = F.col("ts") > since
    return chunks.filter(newer | (since == F.timestamp_seconds(F.lit(0)))) if epoch_always else chunks.filter(newer)


def cursors(chunks: DataFrame) -> DataFrame:
    """tool and last_timestamp: the newest row less one second, so that rows of the same instant are read again."""
    newest = chunks.groupBy("tool").agg(F.max("ts").alias("ts"))
    return newest.select("tool", F.greatest(F.col("ts") - F.expr("INTERVAL 1 SECOND"), F.timestamp_seconds(F.lit(0))).alias("last_timestamp"))


def first_known(column: str, order: str) -> Column:
    """First non-null value in ``order``."""
    return F.min_by(F.col(column), F.when(F.col(column).isNotNull(), F.struct(order)))


def sessions_of(messages: DataFrame) -> DataFrame:
    """One row per session: bounds, first known branch, commit and path, count and preview (raw first characters)."""
    order = F.struct("ts", "message_index", "id")
    known = lambda c: F.min_by(c, F.when(c.isNotNull(), order))
    return messages.groupBy("session_ref").agg(
        F.first("tool").alias("tool"),
        F.first("source_session_id").alias("source_session_id"),
        known(F.col("metadata.git_branch")).alias("git_branch"),
        known(F.col("metadata.git_commit")).alias("git_commit"),
        F.min("ts").alias("started_at"),
        F.max("ts").alias("last_activity_at"),
        F.count("*").alias("message_count"),
        F.substring(F.min_by("content", order), 1, PREVIEW_CHARS).alias("preview"),
        known(F.col("metadata.source_path")).alias("source_path"),
    )


def merge_sessions(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Upsert: bounds widen, the first known branch, commit and path stay, the preview stays where the new one is absent."""
    both = stored.withColumn("seq", F.lit(0)).unionByName(incoming.withColumn("seq", F.lit(1)), allowMissingColumns=True)
    early = lambda c: first_known(c, "seq").alias(c)
    late = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    return both.groupBy("session_ref").agg(F.first("tool").alias("tool"), F.first("source_session_id").alias("source_session_id"), early("git_branch"), early("git_commit"), F.min("started_at").alias("started_at"), F.max("last_activity_at").alias("last_activity_at"), late("message_count"), late("preview"), early("source_path"))


def latest(rows: DataFrame, keys: list[str], by: str) -> DataFrame:
    """The newest row of each key, for tables that are appended to."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(by)))
    return rows.withColumn("__n", n).filter("__n = 1").drop("__n")


def drift_summary(drift: DataFrame) -> DataFrame:
    """First location and number of records of each surprise of each tool."""
    return drift.groupBy("tool", "surprise").agg(F.min_by("location", "seq").alias("first_location"), F.sum("records").alias("records"))
