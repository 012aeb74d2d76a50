"""A Spark data source of transcript lines, for batches and streams: ``spark.read.format("skein_lines")`` and ``readStream``.

A row is a line: file, place (the byte where it begins), line, modified, folder and error. Files are opened through pyarrow's file systems, so that
a path may be local or of any scheme that pyarrow knows. Plain files are cut into splits of ``splitBytes``, small ones share a task, compressed
ones are one split. A file that cannot be listed, opened or read to its end gives one row with ``error`` and no line; the others are read.

Filters on ``folder`` (equal, in, beginning) and ``modified`` (later than) are taken over: files that they leave out are not opened. (The session
must allow it: ``spark.sql.python.filterPushdown.enabled``.) The offset of a stream is the cursor: for every file, the bytes up to the end of its last whole line, so that a restart
reads nothing twice, appended lines follow, and a line that is still being written waits. It takes about 100 bytes a file.
"""

from __future__ import annotations

import fnmatch
import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, StringStartsWith

SCHEMA = "file string, place long, line string, modified timestamp, folder string, error string"
#: Bytes of a split, and bytes that opening a file counts as when small ones share a task.
SPLIT_BYTES, OPEN_BYTES = 64 << 20, 1 << 20
_BLOCK = 1 << 20
_ARROW = pa.schema([("file", pa.string()), ("place", pa.int64()), ("line", pa.string()), ("modified", pa.timestamp("us", "UTC")), ("folder", pa.string()), ("error", pa.string())])


@dataclass
class File:
    path: str
    size: int
    modified: datetime | None

    @property
    def folder(self) -> str:
        return self.path.rsplit("/", 2)[-2] if self.path.count("/") else ""

    @property
    def packed(self) -> bool:
        return self.path.endswith((".gz", ".bz2", ".zst"))


@dataclass
class Split(InputPartition):
    #: (file, first byte, byte before which a line must begin)
    pieces: list[tuple[File, int, int]] = field(default_factory=list)

    def __post_init__(self):
        super().__init__(0)


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def listed(path: str, glob: str) -> list[File]:
    system, root = file_system(path)
    info = system.get_file_info(root)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    return sorted((File(i.path, i.size or 0, i.mtime) for i in found if i.type == fs.FileType.File and fnmatch.fnmatch(i.base_name, glob)), key=lambda f: f.path)


def splits(pieces: list[tuple[File, int, int]], size: int) -> list[Split]:
    """Long pieces cut, short ones put together."""
    out, held = [Split()], 0
    for file, start, end in pieces:
        for a in range(start, max(end, start + 1), size) if not file.packed else [start]:
            b = end if file.packed else min(a + size, end)
            if out[-1].pieces and held + b - a + OPEN_BYTES > size:
                out.append(Split())
                held = 0
            out[-1].pieces.append((file, a, b))
            held += b - a + OPEN_BYTES
    return [s for s in out if s.pieces]


def read_lines(system: fs.FileSystem, file: File, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(place, line) of the lines that begin in [start, end): a line goes to the split where it begins."""
    source = system.open_input_stream(file.path) if file.packed else system.open_input_file(file.path)
    with source:
        at = start
        if start:  # the line that begins before the split is another's
            source.seek(start - 1)
            at = start - 1
        rest, skip = b"", bool(start)
        while True:
            block = source.read(_BLOCK)
            *whole, rest = (rest + block).split(b"\n")
            if not block and rest:
                whole, rest = [*whole, rest], b""
            for line in whole:
                place, at = at, at + len(line) + 1
                if skip:
                    skip = False
                elif not file.packed and place >= end:
                    return
                else:
                    yield place, line.removesuffix(b"\r")
            if not block:
                return
            if not file.packed and not skip and at >= end:
                return


def last_line_end(system: fs.FileSystem, file: File) -> int:
    """Bytes of a file up to the end of its last whole line."""
    with system.open_input_file(file.path) as source:
        end = file.size
        while end:
            a = max(0, end - _BLOCK)
            source.seek(a)
            at = source.read(end - a).rfind(b"\n")
            if at >= 0:
                return a + at + 1
            end = a
    return 0


class _Lines:
    """What the batch and the stream reader share."""

    def __init__(self, options: dict[str, str]):
        given = {k.lower(): v for k, v in options.items()}
        if "path" not in given:
            raise ValueError("no path")
        self.path, self.glob, self.size = given["path"], given.get("glob", "*.jsonl"), int(given.get("splitbytes", SPLIT_BYTES))

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(self.path)
        for file, start, end in partition.pieces:
            held: list[tuple] = []
            size = 0
            try:
                for place, line in read_lines(system, file, start, end):
                    held.append((file.path, place, line.decode("utf-8", "replace"), file.modified, file.folder, None))
                    size += len(line)
                    if size > _BLOCK:
                        yield _batch(held)
                        held, size = [], 0
            except Exception as e:  # one file must not stop the others
                held.append((file.path, None, None, file.modified, file.folder, f"{type(e).__name__}: file not read to its end"))
            if held:
                yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def _as_utc(x: datetime) -> datetime:
    return x.replace(tzinfo=UTC) if x.tzinfo is None else x


class LinesReader(_Lines, DataSourceReader):
    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.folders: list = []
        self.later: list = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In | StringStartsWith) and f.attribute == ("folder",):
                self.folders.append(("in", [f.value]) if isinstance(f, EqualTo) else ("in", list(f.value)) if isinstance(f, In) else ("starts", f.value))
            elif isinstance(f, GreaterThan | GreaterThanOrEqual) and f.attribute == ("modified",):
                self.later.append((_as_utc(f.value), isinstance(f, GreaterThanOrEqual)))
            else:
                yield f

    def wanted(self, file: File) -> bool:
        inside = all(file.folder in x if kind == "in" else file.folder.startswith(x) for kind, x in self.folders)
        return inside and all(file.modified is not None and (file.modified >= t if equal else file.modified > t) for t, equal in self.later)

    def partitions(self) -> list[Split]:
        return splits([(f, 0, f.size) for f in listed(self.path, self.glob) if self.wanted(f)], self.size) or [Split()]


class LinesStream(_Lines, DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.known: dict[str, tuple[int, int]] = {}

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        system, ends = file_system(self.path)[0], {}
        for f in listed(self.path, self.glob):
            if self.known.get(f.path, (-1, 0))[0] != f.size:
                try:
                    self.known[f.path] = (f.size, f.size if f.packed else last_line_end(system, f))
                except OSError:  # read again with the next batch
                    continue
            ends[f.path] = self.known[f.path][1]
        return {"files": json.dumps(ends, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Split]:
        before, after = json.loads(start["files"]), json.loads(end["files"])
        modified = {f.path: f.modified for f in listed(self.path, self.glob)}
        # a file that is shorter than before was written anew; a packed one is read when it appears
        new = [(File(p, n, modified.get(p)), 0 if n < before.get(p, 0) else before.get(p, 0), n) for p, n in sorted(after.items()) if n != before.get(p, 0)]
        return splits([x for x in new if not (x[0].packed and x[1])], self.size)

    def commit(self, end: dict) -> None:
        """The checkpoint keeps the offsets."""


class LinesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "skein_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LinesReader:
        return LinesReader(dict(self.options))

    def streamReader(self, schema) -> LinesStream:
        return LinesStream(dict(self.options))


def register(spark: SparkSession) -> SparkSession:
    """Make the format known to the session, with its filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LinesSource)
    return spark
