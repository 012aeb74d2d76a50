"""The data source of lines and the streamed fold of codex files."""

import json
import os

import pytest
from pyspark.sql import functions as F

from skein.sources import datasource, jsonl
from skein.streaming import folds


@pytest.fixture(scope="module")
def registered(spark):
    from skein.session import ship

    return datasource.register(ship(spark))


def put(path, text, when=None):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    if when:
        os.utime(path, (when, when))


def test_splits_give_every_line_once(registered, tmp_path):
    body = "".join(f"{'é' * (i % 40)} line {i}\r\n" if i % 5 else "\n" for i in range(3000)) + "no end"
    put(tmp_path / "a" / "x.jsonl", body)
    for i in range(30):
        put(tmp_path / "b" / f"{i}.jsonl", f"small {i}\n")
    put(tmp_path / "b" / "other.txt", "not asked for\n")
    want = [("x.jsonl", line.removesuffix("\r")) for line in body.split("\n")] + [(f"{i}.jsonl", f"small {i}") for i in range(30)]
    for size in (700, 5000, 1 << 26):
        read = registered.read.format("skein_lines").option("splitBytes", size).load(str(tmp_path))
        rows = read.select(F.regexp_extract("file", "[^/]+$", 0), "line", "place").collect()
        assert sorted(r[:2] for r in map(tuple, rows)) == sorted(want)
        assert all(body.encode()[r.place :].startswith(r.line.encode()) for r in rows if r[0] == "x.jsonl")
        assert (read.rdd.getNumPartitions() > 20) == (size < 1 << 20)


def test_filters_open_no_other_file(registered, tmp_path):
    """Files that a pushed filter leaves out are not opened: a broken one among them gives no error row."""
    put(tmp_path / "-work-app" / "s.jsonl", "one\n", 2_000_000_000)
    put(tmp_path / "-work-app" / "old.jsonl", "old\n", 1_000_000_000)
    put(tmp_path / "-other" / "broken.jsonl.gz", b"no archive")
    read = registered.read.format("skein_lines").option("glob", "*.jsonl*").load(str(tmp_path))
    assert [(r.file.rsplit("/", 1)[1], r.line) for r in read.filter("error IS NOT NULL").collect()] == [("broken.jsonl.gz", None)]
    some = read.filter("folder = '-work-app' AND modified > timestamp'2020-01-01'")
    assert [r.line for r in some.collect()] == ["one"] and some.rdd.getNumPartitions() == 1
    reader = datasource.LinesReader({"path": str(tmp_path), "glob": "*.jsonl*"})
    from pyspark.sql.datasource import StringStartsWith

    assert list(reader.pushFilters([StringStartsWith(("folder",), "-work")])) == []
    assert [f.path.rsplit("/", 1)[1] for s in reader.partitions() for f, _, _ in s.pieces] == ["old.jsonl", "s.jsonl"]


def test_broken_files_give_one_error_row(registered, tmp_path):
    import gzip

    packed = gzip.compress("".join(f"line {i} {hash(i * 7919)}\n" for i in range(50_000)).encode())
    put(tmp_path / "fine.jsonl.gz", packed)
    put(tmp_path / "cut.jsonl.gz", packed[: len(packed) // 2])
    put(tmp_path / "good.jsonl", "a\nb\n")
    rows = registered.read.format("skein_lines").option("glob", "*.jsonl*").load(str(tmp_path)).select(F.regexp_extract("file", "[^/]+$", 0).alias("f"), "line", "error").collect()
    assert [r.f for r in rows if r.error] == ["cut.jsonl.gz"]
    assert sum(r.f == "fine.jsonl.gz" for r in rows) == 50_000 and [r.line for r in rows if r.f == "good.jsonl"] == ["a", "b"]
    gone = datasource.LinesReader({"path": str(tmp_path)})
    (found,) = gone.partitions()
    (tmp_path / "good.jsonl").unlink()
    assert [b.column("error")[0].as_py() for b in gone.read(found)] == ["FileNotFoundError: file not read to its end"]


RECORDS = [
    {"type": "session_meta", "payload": {"id": "c1", "cwd": "/work/app", "git": {"branch": "main", "commit_hash": "abc"}}},
    {"type": "turn_context", "payload": {"approval_policy": "full-auto", "sandbox_policy": {"type": "strict"}}},
    {"timestamp": "2026-05-10T10:00:01Z", "type": "event_msg", "payload": {"type": "user_message", "message": "q1"}},
    {"type": "response_item", "payload": {"type": "message", "role": "assistant", "content": [{"text": "a1"}]}},
    {"type": "odd", "payload": {}},
    {"type": "turn_context", "payload": {"approval_policy": "suggest"}},
    {"type": "event_msg", "payload": {"type": "user_message", "message": "q2"}},
    {"type": "compacted", "payload": {"summary": "sum"}},
    {"type": "turn_context", "payload": {"cwd": "/else"}},
    {"type": "event_msg", "payload": {"type": "user_message", "message": "lost"}},
]


def test_streamed_fold_equals_the_batch(registered, tmp_path):
    """Two files grow line by line, the stream is stopped and started from its checkpoint after each; the chunks and drift are those of one batch."""
    spark, lines = registered, [json.dumps(r) for r in RECORDS]
    provider = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    root, out = tmp_path / "store", str(tmp_path / "out")
    try:
        done = {"a": 0, "b": 0}
        for step in ((3, 1), (4, 1), (8, 5), (10, 7)):
            for name, n in zip("ab", step, strict=True):
                (root).mkdir(exist_ok=True)
                with (root / f"{name}.jsonl").open("a") as f:
                    f.write("".join(f"{x}\n" for x in lines[done[name] : n]))
                    done[name] = n
            with (root / "a.jsonl").open("a") as f:
                f.write("" if step[0] < 10 else '{"half of a li')  # not a whole line yet
            stream = spark.readStream.format("skein_lines").load(str(root))
            folded = folds.fold_codex(stream, "/work/app")
            folded.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start(out).awaitTermination()
        rows = spark.read.parquet(out)
        assert rows.count() == 17  # nothing twice, and the half line waits
        got = folds.codex_batch(rows, "/work/app")
        batch = spark.read.format("skein_lines").load(str(root)).filter("line NOT LIKE '%half%'")
        numbered = batch.withColumn("line_no", F.expr("row_number() OVER (PARTITION BY file ORDER BY place)")).selectExpr("file", "line_no", "line", "try_parse_json(line) AS v")
        want = jsonl.codex(numbered, "/work/app")
        shown = lambda df: sorted(map(repr, df.collect()))
        assert [shown(x) for x in got] == [shown(x) for x in want] and want[0].count() == 7
    finally:
        spark.conf.set(provider, old)
