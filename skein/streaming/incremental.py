"""Structured Streaming into the store.

Each micro-batch is one commit under the tag of its query and batch number, so that a batch which is run again after a failure
adds nothing; message ids make the rows idempotent on top of that.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skein.functions.text import sanitize_text
from skein.operators import ingest
from skein.operators.store import Store
from skein.schema import CHUNK
from skein.sources.registry import Source


def chunk_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Chunks from a folder that Parquet files arrive in."""
    return spark.readStream.schema(CHUNK).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def deduplicated(chunks: DataFrame, lateness: str = "1 second") -> DataFrame:
    """A stream with equal messages once within the watermark; later rows are lost, as older than the cursor."""
    return chunks.withColumn("id", ingest.message_id()).withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["id"]).drop("id")


def into_store(chunks: DataFrame, store: Store, checkpoint: str, name: str = "chunks") -> StreamingQuery:
    """Everything that is there now, in bounded micro-batches; call again for what has come since."""

    def write(batch: DataFrame, number: int) -> None:
        store.ingest(batch, tag=f"{name}-{number}")

    return chunks.writeStream.queryName(name).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def refresh(spark: SparkSession, store: Store, sources: list[Source]) -> dict[str, str]:
    """Read what each source has since its cursor into the store; ``sources`` that fail are returned with their errors.

    A source that fails is recorded as last_error:<tool> without paths, its cursor stays and the others go on.
    """
    errors: dict[str, str] = {}
    said: dict[str, str | None] = {}
    cursors = {r.tool: r.last_timestamp for r in store.cursors().collect()}
    for source in sources:
        try:
            if source.read is None:
                raise ValueError(f"no reader for {source.tool}")
            chunks, drift = source.read(spark, source, cursors.get(source.tool))
            store.ingest(chunks, drift)
            said[f"last_error:{source.tool}"] = None
        except Exception as e:  # one broken store must not stop the rest
            first = str(e).splitlines()[0][:500] if str(e) else type(e).__name__
            errors[source.tool] = said[f"last_error:{source.tool}"] = sanitize_text(first)
    now = spark.sql("SELECT date_format(now(), \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\") AS t").first().t
    store.set(last_scan_at=now, **said)
    return errors


def running_index(events: DataFrame, key: str, order: str) -> DataFrame:
    """A stateful running counter per ``key`` over a stream, in ``order`` within each micro-batch: (key, order, message_index)."""
    schema = events.select(key, order).schema

    def count(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values(order)
        state.update((seen + len(rows),))
        yield pd.DataFrame({key: rows[key], order: rows[order], "message_index": range(seen, seen + len(rows))})

    out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema) + ", message_index long"
    return events.select(key, order).groupBy(key).applyInPandasWithState(count, out, "seen long", "append", GroupStateTimeout.NoTimeout)


def lag_report(query: StreamingQuery) -> dict:
    """Rows and files of the last micro-batch, for progress reports."""
    last = query.lastProgress or {}
    return {"batch": last.get("batchId"), "rows": last.get("numInputRows"), "running": query.isActive}


