"""Sliding windows of a session's messages, by message count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.functions.text import hash_parts, iso_time

SIZE, STRIDE = 8, 4


def numbered(messages: DataFrame) -> DataFrame:
    """``messages`` with ``place`` (from 0, in order of time) and ``total`` of their session.

    Places take two levels, counts by day and a window inside each day, so that a session of many days is dealt over as many tasks.
    """
    day, order = F.to_date("ts"), ("ts", "message_index", "id")
    rows = messages.withColumn("day", day)
    counts = rows.groupBy("session_ref", "day").agg(F.count("*").alias("n"))
    session = Window.partitionBy("session_ref")
    earlier = F.coalesce(F.sum("n").over(session.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("session_ref", "day", earlier.alias("earlier"), F.sum("n").over(session).alias("total"))
    inside = F.row_number().over(Window.partitionBy("session_ref", "day").orderBy(*order)) - 1
    return rows.withColumn("inside", inside).join(starts, ["session_ref", "day"]).withColumn("place", F.col("earlier") + F.col("inside")).drop("day", "inside", "earlier")


def retrieval_units(messages: DataFrame, size: int = SIZE, stride: int = STRIDE) -> DataFrame:
    """One row per window, with its content-derived id.

    Windows start at every ``stride``-th message; the last is the first one that reaches the end of the session.
    A message goes to the windows that hold it, at most size / stride rounded up; a group is one window.
    """
    size, stride = max(2, size), max(1, stride)
    rows = numbered(messages)
    last = F.greatest(F.ceil((F.col("total") - size) / stride), F.lit(0)) * stride
    lowest = F.greatest(F.ceil((F.col("place") - size + 1) / stride), F.lit(0)) * stride
    highest = F.least(F.floor(F.col("place") / stride) * stride, last)
    held = rows.filter(lowest <= highest).withColumn("start", F.explode(F.sequence(lowest.cast("long"), highest.cast("long"), F.lit(stride).cast("long"))))
    row = F.struct("place", "ts", "message_index", "role", "content")
    cut = held.groupBy("session_ref", "tool", "start").agg(F.sort_array(F.collect_list(row)).alias("w"))
    count = F.size("w").cast("string")
    first, end = F.col("w")[0], F.element_at("w", -1)

    def lines(x, i):
        head = F.concat(F.lit("Turn "), (i + 1).cast("string"), F.lit("/"), count, F.lit(" | message_index="), x["message_index"].cast("string"), F.lit(" | "), x["role"], F.lit(" @ "), iso_time(x["ts"]))
        return F.concat(head, F.lit("\n"), x["content"])

    header = F.concat(F.lit("Session: "), F.col("session_ref"), F.lit("\nChronological window: messages "), first["message_index"].cast("string"), F.lit(" through "), end["message_index"].cast("string"), F.lit("\n"))
    rows = cut.select(
        "session_ref",
        "tool",
        first["message_index"].alias("message_start_index"),
        end["message_index"].alias("message_end_index"),
        first["ts"].alias("started_at"),
        end["ts"].alias("ended_at"),
        F.concat(header, F.array_join(F.transform("w", lines), "\n")).alias("content"),
        F.array_join(F.transform("w", lambda x: x["content"]), "\n").alias("searchable_text"),
    )
    rows = rows.withColumn("content_hash", hash_parts(F.col("content")))
    key = hash_parts(F.lit("retrieval-unit"), F.col("session_ref"), F.col("message_start_index"), F.col("message_end_index"), F.col("content_hash"))
    return rows.withColumn("unit_id", key)


def window_diff(stored: DataFrame, desired: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(windows to delete, windows to insert); unchanged ones keep their vectors."""
    return stored.join(desired, "unit_id", "left_anti"), desired.join(stored, "unit_id", "left_anti")


def backlog(units: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """Windows without a current vector of ``model``, newest first."""
    current = vectors.filter(F.col("model") == model).select("unit_id", "content_hash")
    return units.join(current, ["unit_id", "content_hash"], "left_anti").orderBy(F.desc("ended_at"), "unit_id")
