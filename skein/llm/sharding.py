"""Sharding by size-tiered compaction under a versioned manifest, with DataFrame readers and writers alone.

Arrivals are appended as small immutable runs (folders of Parquet shards). Runs of similar size form a tier; a tier with
``fanout`` runs or more is merged, ``fanout`` runs at a time, into one run of files of about ``target_bytes``, which belongs to a higher
tier; so a row is rewritten once a tier, not once an arrival. A run of ``target_bytes`` is left as it is: its files can't grow any more. The merges of a tier run side by side. Merging coalesces the read splits: no
shuffle, and a task writes one file of bounded size.

A table is what its newest manifest names. A manifest is written beside and renamed to its version number, which fails if another writer was
first: readers see one version or another, never a mixture, and a job that dies leaves files that no manifest names. A writer that was second
reads the newer manifest and tries again; it loses only if a run that it merged is gone. Every version stays readable until ``expire`` drops
it: that removes the manifests before the newest ``keep`` and the runs that no manifest left names. ``expire`` also removes runs
without a manifest once they are older than ``grace_seconds``, so that a writer at work keeps its files.

Defined results: every row is kept as it is, equal rows and nulls included; a null arrival is an arrival of its own; an empty arrival adds a run without rows;
a table without a manifest has version 0 and cannot be read; columns follow the first run's schema, and columns of any name are kept.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession

from skein.llm.common import hadoop_fs, spare

TARGET_BYTES = 64 << 20
FANOUT = 4
#: Runs below this size share the lowest tier.
SMALL_BYTES = 1 << 20
#: Versions that ``expire`` keeps, and the age at which a run without a manifest is rubbish.
KEEP_VERSIONS, GRACE_SECONDS = 2, 24 * 3600
#: Merges that run side by side, and times that a writer tries again.
MERGES, TRIES = 4, 20


@dataclass(frozen=True)
class Run:
    path: str
    bytes: int
    files: int


class ConflictError(RuntimeError):
    """Another writer committed the same version."""


class LostRunError(RuntimeError):
    """A run that was merged is no longer part of the table."""


class ShardedTable:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT, small_bytes: int = SMALL_BYTES):
        self.spark, self.root = spark, root.rstrip("/")
        self.target_bytes, self.fanout, self.small_bytes = target_bytes, fanout, small_bytes

    # manifest

    def versions(self) -> list[int]:
        fs, p = hadoop_fs(self.spark, f"{self.root}/manifest")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n[1:]) for n in names if n.startswith("v"))

    def version(self) -> int:
        return max(self.versions(), default=0)

    def runs(self, version: int | None = None) -> list[Run]:
        version = self.version() if version is None else version
        if not version:
            return []
        lines = self.spark.read.text(f"{self.root}/manifest/v{version}", wholetext=True).first()
        return [Run(**r) for r in json.loads(lines.value)["runs"]]

    def commit(self, version: int, runs: list[Run]) -> int:
        """Make ``runs`` the table of ``version``; ConflictError if that version exists."""
        jvm = self.spark.sparkContext._jvm
        fs, new = hadoop_fs(self.spark, f"{self.root}/manifest/.{uuid.uuid4().hex}")
        out = fs.create(new)
        out.write(json.dumps({"version": version, "runs": [asdict(r) for r in runs]}).encode())
        out.close()
        to = jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifest/v{version}")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        rename = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(new, to, rename)
        except Exception as e:
            fs.delete(new, False)
            if fs.exists(to):
                raise ConflictError(f"version {version} of {self.root} exists") from e
            raise
        return version

    def change(self, edit: Callable[[list[Run]], list[Run]]) -> int:
        """Commit what ``edit`` makes of the newest runs, again on the newer ones if another writer was first."""
        for _ in range(TRIES):
            version = self.version()  # read once: the runs are those of just this version
            try:
                return self.commit(version + 1, edit(self.runs(version)))
            except ConflictError:
                continue
        raise ConflictError(f"{self.root}: other writers were first {TRIES} times")

    # data

    def _run(self, path: str) -> Run:
        fs, p = hadoop_fs(self.spark, path)
        files = [s for s in fs.listStatus(p) if s.getPath().getName().startswith("part-")]
        return Run(path, sum(s.getLen() for s in files), len(files))

    def append(self, rows: DataFrame) -> int:
        path = f"{self.root}/data/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        run = self._run(path)
        return self.change(lambda runs: [*runs, run])

    def append_arrivals(self, rows: DataFrame, arrival: str) -> int:
        """One run and one version for each value of the column ``arrival``, written in one pass over ``rows``."""
        path, at = f"{self.root}/data/{uuid.uuid4().hex}", spare(rows, "run")
        rows.withColumn(at, rows[arrival]).write.partitionBy(at).parquet(path)
        fs, p = hadoop_fs(self.spark, path)
        for name in sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()):
            run = self._run(f"{path}/{name}")
            self.change(lambda runs, run=run: [*runs, run])
        return self.version() or self.append(rows)

    def tier(self, run: Run) -> int:
        return max(0, math.ceil(math.log(max(run.bytes, 1) / self.small_bytes, self.fanout)))

    def full_tiers(self, version: int | None = None) -> dict[int, list[Run]]:
        """The tiers that hold ``fanout`` runs below the target size or more."""
        tiers: dict[int, list[Run]] = {}
        for run in self.runs(version):
            if run.bytes < self.target_bytes:
                tiers.setdefault(self.tier(run), []).append(run)
        return {t: runs for t, runs in sorted(tiers.items()) if len(runs) >= self.fanout}

    def compact(self) -> int:
        """Merge full tiers until none is left; the version that results. The runs that were merged stay for the versions that name them."""
        while True:
            version = self.version()
            full = next(iter(self.full_tiers(version).values()), None)
            if full is None:
                return version
            whole = len(full) // self.fanout * self.fanout
            chosen = sorted(full, key=lambda r: (r.bytes, r.path))[:whole]
            with ThreadPoolExecutor(MERGES) as pool:
                merged = list(pool.map(self._merge, [chosen[i : i + self.fanout] for i in range(0, whole, self.fanout)]))
            gone = {r.path for r in chosen}

            def swapped(runs: list[Run], gone: set[str] = gone, merged: list[Run] = merged) -> list[Run]:
                if not gone <= {r.path for r in runs}:
                    raise LostRunError(f"another writer has merged runs of {self.root}")
                return [r for r in runs if r.path not in gone] + merged

            try:
                self.change(swapped)
            except LostRunError:  # the other writer's merge stands; these files go, and the tiers are looked at anew
                for run in merged:
                    self._delete(run.path)

    def _merge(self, runs: list[Run]) -> Run:
        path = f"{self.root}/data/{uuid.uuid4().hex}"
        files = max(1, math.ceil(sum(r.bytes for r in runs) / self.target_bytes))
        self.spark.read.parquet(*(r.path for r in runs)).coalesce(files).write.parquet(path)
        return self._run(path)

    def _delete(self, path: str) -> None:
        fs, p = hadoop_fs(self.spark, path)
        fs.delete(p, True)

    def expire(self, keep: int = KEEP_VERSIONS, grace_seconds: float = GRACE_SECONDS) -> list[int]:
        """Drop all versions but the newest ``keep`` and the runs that are named by none that is left; the versions left."""
        versions = self.versions()
        left = versions[-max(1, keep) :]
        named = {r.path for v in left for r in self.runs(v)}
        dropped = {r.path for v in versions[: -len(left)] for r in self.runs(v)} if left else set()
        for v in versions[: -len(left)]:
            self._delete(f"{self.root}/manifest/v{v}")
        for path in dropped - named:
            self._delete(path)
        fs, p = hadoop_fs(self.spark, f"{self.root}/data")
        for status in fs.listStatus(p) if fs.exists(p) else []:
            path = f"{self.root}/data/{status.getPath().getName()}"
            inside = any(x == path or x.startswith(f"{path}/") for x in named)
            if not inside and time.time() - status.getModificationTime() / 1000 > grace_seconds:
                self._delete(path)
        return left

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version; ``_metadata.file_path`` tells a row's shard."""
        paths = [r.path for r in self.runs(version)]
        if not paths:
            raise ValueError(f"{self.root} has no version to read")
        return self.spark.read.parquet(*paths)

    def shards(self) -> DataFrame:
        """version, path, bytes, files and tier of the runs of every version that can be read."""
        rows = [(v, r.path, r.bytes, r.files, self.tier(r)) for v in self.versions() for r in self.runs(v)]
        return self.spark.createDataFrame(rows, "version int, path string, bytes long, files int, tier int")
