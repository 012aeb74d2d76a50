"""The stored tables: immutable batches of Parquet and one state file that names those which count.

A batch holds the rows that it adds to each table; windows that no longer apply are added to ``units_gone``. A ``Snapshot`` is one version of the
store: every table that it gives is of that version. A write plans on a snapshot and commits on it: the state file of the next version is written beside and renamed, so
that readers see whole batches and of two writers one fails, plans anew on what the other has committed, and tries again. (The rename is
atomic on HDFS and local disks; an object store needs a committer that has one.)

Messages and windows lie in buckets of their session, postings in buckets of their term: a batch reads only the stored buckets of the sessions that it touches, a search
those of its terms. How many buckets a batch has follows its rows and stands in the state; a bucket with too many rows for one task is written by several.
``compact`` makes one batch of all; what no version within the retention names goes with ``expire``.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein import schema
from skein.operators import ingest, lexical, windows

TABLES = ("messages", "sessions", "units", "units_gone", "postings", "unit_stats", "vectors", "settings", "cursors", "drift")
#: The column that each bucketed table is dealt by.
DEALT_BY = {"messages": "session_ref", "units": "session_ref", "postings": "term"}
#: Buckets of a small batch, messages for each bucket of a larger one, and buckets that a folder can have.
LEAST_BUCKETS, BUCKET_ROWS, MOST_BUCKETS = 16, 250_000, 1 << 16
#: Times that a write plans anew when others commit before it; seconds that superseded files stay.
TRIES, RETENTION = 20, 7 * 24 * 3600.0


def bucket(column: str, n: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")


def buckets_for(rows: int) -> int:
    """A power of two."""
    n = LEAST_BUCKETS
    while n < MOST_BUCKETS and n * BUCKET_ROWS < rows:
        n *= 2
    return n


class ConflictError(RuntimeError):
    """Another writer committed the same version."""


class Snapshot:
    """The tables of one version; those that are dealt in buckets can be read for some sessions or terms alone."""

    def __init__(self, store: Store, state: dict):
        self.store, self.state, self.spark = store, state, store.spark

    def raw(self, name: str, only: DataFrame | None = None) -> DataFrame | None:
        """All rows of a table; with ``only`` (rows of its dealing column) those of their buckets: no other folder is listed."""
        batches = [b for b in self.state["batches"] if name in b["tables"]]
        folder = lambda b: f"{self.store.root}/data/{b['id']}/{name}"
        if name not in DEALT_BY:
            paths = [folder(b) for b in batches]
        else:
            wanted: dict[int, set[str]] = {}
            for n in {b["buckets"] for b in batches} if only is not None else ():  # bucket numbers: at most MOST_BUCKETS
                wanted[n] = {f"bucket={r.b}" for r in only.select(bucket(DEALT_BY[name], n).alias("b")).distinct().collect()}
            paths = []
            for b in batches:
                fs, p = self.store._fs(folder(b))
                found = [s.getPath() for s in fs.listStatus(p) if s.isDirectory()] if fs.exists(p) else []
                paths += [f.toString() for f in found if only is None or f.getName() in wanted[b["buckets"]]]
        return self.spark.read.parquet(*paths) if paths else None

    def messages(self, only: DataFrame | None = None) -> DataFrame | None:
        return self.raw("messages", only)

    def sessions(self) -> DataFrame | None:
        rows = self.raw("sessions")
        return None if rows is None else ingest.latest(rows, ["session_ref"], "seq")

    def _live(self, name: str, only: DataFrame | None = None) -> DataFrame | None:
        """Rows of the windows that apply."""
        rows, units = self.raw(name, only), self.units()
        return None if rows is None or units is None else rows.join(units.select("unit_id"), "unit_id", "left_semi").dropDuplicates(["unit_id", "term"] if name == "postings" else ["unit_id"])

    def index(self, terms: list[str]) -> tuple[DataFrame, DataFrame] | None:
        """The stored postings of ``terms`` and the lengths of all windows."""
        only = self.spark.createDataFrame([(t,) for t in terms] or [("",)], "term string")
        postings, stats = self._live("postings", only), self._live("unit_stats")
        return None if postings is None or stats is None else (postings.filter(F.col("term").isin(terms)), stats)

    def units(self, only: DataFrame | None = None) -> DataFrame | None:
        rows, gone = self.raw("units", only), self.raw("units_gone")
        if rows is None or gone is None:
            return rows
        last = gone.groupBy("unit_id").agg(F.max("seq").alias("gone"))
        return ingest.latest(rows, ["unit_id"], "seq").join(last, "unit_id", "left").filter(F.col("gone").isNull() | (F.col("gone") < F.col("seq"))).drop("gone")

    def vectors(self) -> DataFrame | None:
        rows = self.raw("vectors")
        return None if rows is None else ingest.latest(rows, ["unit_id", "model"], "seq")

    def settings(self) -> dict[str, str]:
        rows = self.raw("settings")
        return {} if rows is None else {r.key: r.value for r in ingest.latest(rows, ["key"], "seq").collect() if r.value is not None}

    def cursors(self) -> DataFrame:
        """tool and last_timestamp; none while no session is stored, so that the next run reads everything."""
        rows = self.raw("cursors")
        if rows is None or self.raw("sessions") is None:
            return self.spark.createDataFrame([], schema.CURSOR)
        return rows.groupBy("tool").agg(F.max("last_timestamp").alias("last_timestamp"))

    def drift(self) -> DataFrame | None:
        return self.raw("drift")


class Store:
    """Reads are of the version at the time of the call; take a ``snapshot`` for several tables of one version."""

    def __init__(self, spark: SparkSession, root: str, window_size: int = windows.SIZE, window_stride: int = windows.STRIDE):
        self.spark, self.root = spark, root.rstrip("/")
        self.window_size, self.window_stride = window_size, window_stride

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _versions(self) -> dict[int, object]:
        fs, p = self._fs(f"{self.root}/state")
        return {int(n[1:]): s for s in (fs.listStatus(p) if fs.exists(p) else []) if (n := s.getPath().getName()).startswith("v")}

    def state(self, version: int | None = None) -> dict:
        """The newest state, or that of a version. One of another table schema counts as empty: there are no migrations, and the next write starts anew."""
        versions = [version] if version is not None else list(self._versions())
        if not versions:
            return {"version": 0, "schema": schema.SCHEMA_VERSION, "batches": [], "tags": {}}
        found = json.loads(self.spark.read.text(f"{self.root}/state/v{max(versions)}", wholetext=True).first().value)
        return found if found["schema"] == schema.SCHEMA_VERSION else {"version": found["version"], "schema": schema.SCHEMA_VERSION, "batches": [], "tags": {}}

    def snapshot(self, version: int | None = None) -> Snapshot:
        return Snapshot(self, self.state(version))

    def _commit(self, before: dict, batch: dict, alone: bool = False) -> None:
        """Add ``batch`` to those of ``before``; ``alone`` puts it in their place."""
        jvm = self.spark.sparkContext._jvm
        tags = dict(before.get("tags", {}))
        if batch.get("tag"):
            name, number = _tag(batch["tag"])
            tags[name] = max(number, tags.get(name, -1))
        after = {"version": before["version"] + 1, "schema": schema.SCHEMA_VERSION, "batches": [*([] if alone else before["batches"]), batch], "tags": tags}
        fs, new = self._fs(f"{self.root}/state/.{uuid.uuid4().hex}")
        out = fs.create(new)
        out.write(json.dumps(after).encode())
        out.close()
        to = jvm.org.apache.hadoop.fs.Path(f"{self.root}/state/v{after['version']}")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(new, to, self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            fs.delete(new, False)
            if fs.exists(to):
                raise ConflictError(f"version {after['version']} of {self.root} exists") from e
            raise

    def write(self, plan: Callable[[Snapshot], dict[str, DataFrame] | None], tag: str | None = None, rows: int = 0, alone: bool = False) -> bool:
        """Write the tables that ``plan`` makes from a snapshot, as one batch on that very version; whether there was something to write.

        Where another writer commits first, the files go and the plan is made anew. A ``tag`` (name-number) that is not above the
        last one of its name is not written again; ``rows`` tells how many buckets a large batch needs.
        """
        for _ in range(TRIES):
            snapshot = self.snapshot()
            if tag is not None and _tag(tag)[1] <= snapshot.state.get("tags", {}).get(_tag(tag)[0], -1):
                return False
            tables = plan(snapshot)
            if tables is None:
                return False
            batch = self._write(snapshot.state, tables, tag, buckets_for(rows))
            try:
                self._commit(snapshot.state, batch, alone)
                return True
            except ConflictError:
                fs, p = self._fs(f"{self.root}/data/{batch['id']}")
                fs.delete(p, True)
        raise ConflictError(f"{TRIES} times others committed to {self.root} first")

    def add(self, tables: dict[str, DataFrame], tag: str | None = None) -> None:
        """Write one batch of rows that don't depend on what is stored, and commit it."""
        self.write(lambda _: tables, tag)

    def _write(self, before: dict, tables: dict[str, DataFrame], tag: str | None = None, buckets: int = LEAST_BUCKETS) -> dict:
        batch = {"id": uuid.uuid4().hex, "seq": before["version"] + 1, "tag": tag, "tables": sorted(tables), "buckets": buckets}
        for name, rows in tables.items():
            rows, path = rows.withColumn("seq", F.lit(batch["seq"])), f"{self.root}/data/{batch['id']}/{name}"
            if name in DEALT_BY:
                # a rebalance, not a repartition: a bucket that is too large for a task is written by several
                dealt = rows.withColumn("bucket", bucket(DEALT_BY[name], buckets)).hint("rebalance", "bucket")
                dealt.write.partitionBy("bucket").parquet(path)
            else:
                rows.write.parquet(path)
        return batch

    def compact(self) -> None:
        """One batch of the tables as they stand, so that reads list one folder a table; the files of before stay for their readers until they expire."""
        messages = self.messages()

        def now(s: Snapshot) -> dict[str, DataFrame] | None:
            settings = s.raw("settings")
            tables = {"messages": s.messages(), "sessions": s.sessions(), "units": s.units(), "postings": s._live("postings"), "unit_stats": s._live("unit_stats"), "vectors": s.vectors(), "cursors": s.raw("cursors"), "drift": s.raw("drift"), "settings": None if settings is None else ingest.latest(settings, ["key"], "seq")}
            return {n: t.drop("seq", "bucket") for n, t in tables.items() if t is not None} or None

        self.write(now, rows=0 if messages is None else messages.count(), alone=True)

    def expire(self, retention: float = RETENTION) -> int:
        """Delete the state files, batches and staged files that were superseded over ``retention`` seconds ago; how many batches went.

        A version is superseded when the next one is committed. A batch goes if no version that stays names it and it is older than
        the retention itself, so that what a writer has not committed yet is safe.
        """
        now, versions = time.time() * 1000, self._versions()
        old = lambda s: now - s.getModificationTime() > retention * 1000
        ordered = sorted(versions)
        stay = [v for v, following in zip(ordered, [*ordered[1:], None], strict=True) if following is None or not old(versions[following])]
        named = {b["id"] for v in stay for b in self.state(v)["batches"]}
        gone = 0
        for folder in ("data", "staging"):
            fs, p = self._fs(f"{self.root}/{folder}")
            for s in fs.listStatus(p) if fs.exists(p) else []:
                if s.getPath().getName() not in named and old(s):
                    gone += fs.delete(s.getPath(), True) and folder == "data"
        fs, _ = self._fs(self.root)
        for v in set(ordered) - set(stay):
            fs.delete(versions[v].getPath(), False)
        return int(gone)

    # tables as they stand

    def raw(self, name: str, only: DataFrame | None = None) -> DataFrame | None:
        return self.snapshot().raw(name, only)

    def messages(self, only: DataFrame | None = None) -> DataFrame | None:
        return self.snapshot().messages(only)

    def sessions(self) -> DataFrame | None:
        return self.snapshot().sessions()

    def index(self, terms: list[str]) -> tuple[DataFrame, DataFrame] | None:
        return self.snapshot().index(terms)

    def units(self, only: DataFrame | None = None) -> DataFrame | None:
        return self.snapshot().units(only)

    def vectors(self) -> DataFrame | None:
        return self.snapshot().vectors()

    def settings(self) -> dict[str, str]:
        return self.snapshot().settings()

    def cursors(self) -> DataFrame:
        return self.snapshot().cursors()

    def drift(self) -> DataFrame | None:
        return self.snapshot().drift()

    # writes

    def set(self, **values: str | None) -> None:
        self.add({"settings": self.spark.createDataFrame([(k, v) for k, v in values.items()], schema.SETTING)})

    def ingest(self, chunks: DataFrame, drift: DataFrame | None = None, tag: str | None = None) -> None:
        """Add chunks: new messages, the sessions and windows that they change, cursors and drift, in one commit planned on one version."""
        staged = f"{self.root}/staging/{uuid.uuid4().hex}"
        ingest.to_messages(chunks).write.parquet(staged)
        incoming = self.spark.read.parquet(staged)
        touched = incoming.select("session_ref").distinct()

        def plan(now: Snapshot) -> dict[str, DataFrame]:
            stored = now.messages(touched)
            old = None if stored is None else stored.drop("seq", "bucket").join(touched, "session_ref", "left_semi")
            new = incoming if old is None else ingest.new_messages(incoming, old).select(incoming.columns)
            whole = new if old is None else old.unionByName(new)
            desired = windows.retrieval_units(whole, self.window_size, self.window_stride)
            tables = {"messages": new, "sessions": ingest.sessions_of(whole), "cursors": ingest.cursors(chunks)}
            units = now.units(touched)
            if units is None:
                tables["units"] = fresh = desired
            else:
                mine = units.drop("seq", "bucket").join(touched, "session_ref", "left_semi")
                gone, fresh = windows.window_diff(mine, desired)
                tables |= {"units": fresh, "units_gone": gone.select("unit_id")}
            tables |= {"postings": lexical.postings(fresh), "unit_stats": lexical.unit_stats(fresh)}
            return tables if drift is None else tables | {"drift": drift}

        self.write(plan, tag, incoming.count())
        fs, p = self._fs(staged)
        fs.delete(p, True)


def _tag(tag: str) -> tuple[str, int]:
    """A query's name and the number of its batch."""
    name, _, number = tag.rpartition("-")
    return (name, int(number)) if name and number.isdigit() else (tag, 0)
