"""Helpers that the operators of this subpackage share.

Every operator that needs a result twice writes it once as Parquet below the folder named by
``spark.checkpoint.dir`` (shared by driver and executors) and reads it back, so a lost executor costs a
recomputation of one stage at most and no plan is evaluated twice.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: ASCII white space as the contracts define it; everything else belongs to a word.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below ``spark.checkpoint.dir``.

    Where the setting is missing, a local master gets a temporary folder (tests); a cluster is refused,
    because a machine-local folder would not be seen by the other machines.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-skein-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/skein-{uuid.uuid4().hex}"


def hadoop_fs(spark: SparkSession, path: str):
    """The Hadoop file system and path object behind ``path``."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


#: Folders that each open ``scratch`` removes.
_SCRATCH: ContextVar[tuple[list[str], ...]] = ContextVar("scratch", default=())


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that ``materialize`` writes in this block go at its end, but for those that are to stay."""
    folders: list[str] = []
    token = _SCRATCH.set((*_SCRATCH.get(), folders))
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        for path in folders:
            fs, p = hadoop_fs(spark, path)
            fs.delete(p, True)


def materialize(df: DataFrame, stay: bool = False, **options: str) -> DataFrame:
    """Write ``df`` once into the shared folder and return the written table; it goes with the session, or with the ``scratch`` around (``stay``: the next one out)."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.options(**options).parquet(path)
    fs, p = hadoop_fs(spark, path)
    fs.deleteOnExit(p)
    if around := _SCRATCH.get()[:-1] if stay else _SCRATCH.get():
        around[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows and bytes that Spark hands to a Python worker at a time: with its defaults (10,000 rows, 64 MB) two workers hold most of an executor.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "4m")}


#: What a worker process keeps from task to task: functions under ``functools.cache``, by the kind of task that uses them.
_KEPT: dict[str, Callable] = {}


def keep_cache(owner: str, cache: Callable) -> None:
    _KEPT[owner] = cache


def drop_caches(owner: str) -> None:
    """Forget what tasks of other kinds have kept in this process."""
    for other in [o for o in _KEPT if o != owner]:
        _KEPT.pop(other).cache_clear()


def release_memory() -> None:
    """Give freed memory of this process back to the system, where the C library can."""
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None
    if trim:
        trim(0)


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """``mapInArrow`` over small batches; a session that has sizes of its own keeps them.

    A task that ends gives its memory back; what earlier tasks have kept goes when a task of another kind begins, and so does
    what the task before held to its very end (its function and models).
    """
    for key, (default, wanted) in BATCHES.items():
        if df.sparkSession.conf.get(key, default) == default:
            df.sparkSession.conf.set(key, wanted)

    owner = run.__qualname__

    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_caches(owner)
        release_memory()
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        release_memory()

    return df.mapInArrow(released, schema)


def spare(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    while name in df.columns:
        name += "_"
    return name


def text_slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``most`` bytes of text, so that word lists stay small."""
    col = batch.column(batch.schema.get_field_index(column))
    sizes = pa.compute.fill_null(pa.compute.binary_length(col), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def byte_texts(batch: pa.RecordBatch, column: str) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding."""
    return batch.column(batch.schema.get_field_index(column)).cast(pa.binary()).to_pylist()


def bounded_rows(df: DataFrame, limit: int, *keys: str, seed: int = 17) -> DataFrame:
    """About ``limit`` rows (all of fewer), chosen by the hash of ``keys`` (of all columns, if none are named).

    A share of the hash space is taken, so that the same rows come however the input is dealt, every task filters for itself and no
    task gathers the sample. The count differs from the limit by a few of its square roots.
    """
    n = df.count()
    if n <= limit:
        return df
    return df.filter(F.xxhash64(F.lit(seed), *(keys or df.columns)) < int(2**64 * (limit / n)) - 2**63)
