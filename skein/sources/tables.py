"""The message model over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.text import estimate_tokens
from skein.schema import METADATA, TOOLS

#: Start of the first conversation.
START = 1704067200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conversation_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as chunks: tools in turn, an hour between conversations and a minute between turns."""
    conv, turn = F.col("conv_id"), F.col("turn")
    branch = F.element_at(F.array(F.lit("main"), F.lit("dev"), F.lit(None)), (conv % 3 + 1).cast("int"))
    known = {"git_branch": branch, "token_estimate": estimate_tokens(F.col("text")), "layer": F.lit(0)}
    metadata = F.struct(*(known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in METADATA))
    return table(spark, sf_dir, "conversations").select(
        F.element_at(F.array(*map(F.lit, TOOLS)), (conv % len(TOOLS) + 1).cast("int")).alias("tool"),
        F.concat(F.lit("conv-"), conv.cast("string")).alias("session_id"),
        F.timestamp_seconds(START + conv * 3600 + turn * 60).alias("ts"),
        "role",
        F.col("text").alias("content"),
        turn.cast("int").alias("message_index"),
        metadata.alias("metadata"),
    )


def embedding_units(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(units, vectors, sessions) over ``embeddings``: 50 sessions, a unit for each vector."""
    v = table(spark, sf_dir, "embeddings")
    unit, session = F.lpad(F.col("vec_id").cast("string"), 9, "0"), F.col("vec_id") % 50
    ref = F.concat(F.element_at(F.array(*map(F.lit, TOOLS)), (session % len(TOOLS) + 1).cast("int")), F.lit(":s"), session.cast("string"))
    at = F.timestamp_seconds(START + F.col("vec_id") * 60)
    units = v.select(unit.alias("unit_id"), ref.alias("session_ref"), F.split(ref, ":")[0].alias("tool"), (F.col("vec_id") % 11).cast("int").alias("message_start_index"), (F.col("vec_id") % 11 + 3).cast("int").alias("message_end_index"), at.alias("started_at"), at.alias("ended_at"), F.concat(F.lit("unit "), unit).alias("content"), F.concat(F.lit("label"), F.col("label").cast("string"), F.lit(" group"), (F.col("vec_id") % 7).cast("string"), F.lit(" item")).alias("searchable_text"))
    vectors = v.select(unit.alias("unit_id"), F.lit("given").alias("model"), F.col("embedding").alias("vector"))
    sessions = units.groupBy("session_ref").agg(F.first("tool").alias("tool"), F.lit(15).cast("long").alias("message_count")).withColumn("git_branch", F.lit(None).cast("string"))
    return units, vectors, sessions
