"""Functions, windows, search, store and streams, by small cases and an SQL engine."""

import sqlite3

import duckdb
import pytest
from pyspark.sql import functions as F

from conftest import DATA
from skein import render
from skein.functions import text as X
from skein.functions.vector import cosine, unit
from skein.operators import embed, ingest, lexical, profile, search, status, windows
from skein.operators.store import ConflictError, Store
from skein.plans import catalogue
from skein.service import Service
from skein.sources.tables import conversation_chunks
from skein.streaming import incremental


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("s, n", [("", 0), ("Hello World", 3), ("let x = 123;", 4)])
def test_estimate_tokens(spark, s, n):
    assert one(spark, X.estimate_tokens(F.lit(s))) == n


def test_to_timestamp(spark):
    epoch = one(spark, F.timestamp_seconds(F.lit(0)))
    assert one(spark, X.to_timestamp(F.lit("1716578000000"))) == one(spark, X.to_timestamp(F.lit("1716578000")))
    assert one(spark, X.to_timestamp(F.lit("invalid-date"))) == epoch == one(spark, X.to_timestamp(F.lit("")))


@pytest.mark.parametrize("a, root, inside", [("/c:/some/project", "c:\\some\\project", True), ("c:/some/projectile", "c:/some/project", False), ("/x/app--secret", "/x/app", False), ("file:///c%3A/some/a%20b/x", "C:\\some\\a b", True)])
def test_path_in_project(spark, a, root, inside):
    assert one(spark, X.path_in_project(F.lit(a), F.lit(root))) is inside


def test_paths_errors_fences(spark):
    assert one(spark, X.encode_path(F.lit("/Users/me/code/app"))) == "-Users-me-code-app"
    assert one(spark, X.encode_path(F.lit("H:\\projects\\x"))) == "H--projects-x"
    assert one(spark, X.sanitize_error(F.lit("no C:\\a\\b and '/var/x/y' here"))) == "no <path> and '<path>' here"
    body = "a\n~~~\nb\n~~~~~  \n"
    assert one(spark, X.fence_for(F.lit(body))) == "~" * 6 == render.fence(body)
    assert one(spark, X.fence_for(F.lit("plain"))) == "~~~"
    assert len(one(spark, X.truncate_content(F.lit("x" * 64_000)))) < 20_000
    assert one(spark, X.round_score(F.lit(-0.0005))) == 0.0


def test_segments():
    assert [len(s) for s in X.split_segments("x" * 2500, 1000)] == [1000, 1000, 500]
    lines = "\n".join(f"line {i} " + "y" * (i % 40) for i in range(200))
    parts = X.split_segments(lines, 300)
    assert max(map(len, parts)) <= 300 and "\n".join(parts) == lines
    assert X.split_segments("\n" * 2000) == [] and X.split_segments("") == [""]


def test_vectors(spark):
    assert one(spark, cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.6), F.lit(0.8)))) == pytest.approx(0.6)
    assert one(spark, cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0
    assert one(spark, unit(F.array(F.lit(3.0), F.lit(4.0)))) == [0.6, 0.8]
    assert embed.pool([[1, 0], [0, 1]]) == pytest.approx([0.5**0.5] * 2) and embed.pool([]) is None


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 9, 12, 24])
@pytest.mark.parametrize("size, stride", [(8, 4), (4, 2), (2, 1), (3, 5)])
def test_windows_match_a_plain_walk(spark, n, size, stride):
    rows = spark.range(n).select(F.lit("t:s").alias("session_ref"), F.lit("t").alias("tool"), F.timestamp_seconds(F.col("id")).alias("ts"), F.col("id").cast("int").alias("message_index"), F.col("id").cast("string").alias("id"), F.lit("user").alias("role"), F.col("id").cast("string").alias("content"))
    got = sorted((r.message_start_index, r.message_end_index) for r in windows.retrieval_units(rows, size, stride).collect())
    want, at = [], 0
    while at < n:
        want.append((at, min(at + size, n) - 1))
        if at + size >= n:
            break
        at += stride
    assert got == want


@pytest.fixture(scope="module")
def corpus(spark):
    units = windows.retrieval_units(ingest.to_messages(conversation_chunks(spark, DATA)), 4, 2).cache()
    return units, lexical.postings(units).cache(), lexical.unit_stats(units)


@pytest.mark.parametrize("query", ["the and tion of", "of.the in", "etion unter", "zz_nothing", "the.of", "."])
def test_bm25_equals_full_text_search(spark, corpus, query):
    units, index, stats = corpus
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(id UNINDEXED, t)")
    db.executemany("INSERT INTO f VALUES (?, ?)", [(r.unit_id, r.searchable_text) for r in units.collect()])
    phrases = X.query_phrases(query)
    said = " OR ".join(f'"{p}"' for p in phrases)
    want = dict(db.execute("SELECT id, bm25(f) FROM f WHERE f MATCH ?", [said]).fetchall()) if said else {}
    got = {r.unit_id: r.bm25 for r in lexical.bm25(index, stats, query).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in got)


def test_scaffolding_is_not_indexed(corpus):
    _, index, stats = corpus
    assert lexical.bm25(index, stats, "message_index chronological").isEmpty()


def test_walk_stops_at_the_limit(spark):
    rows = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 4.0), ("b", 3, 9.0), ("a", 4, 3.0), ("c", 5, 2.0)], "session_ref string, pos int, score double").withColumn("relevance", F.lit(0.5))
    got = [(r.session_ref, r.pos, r.session_rank) for r in search.grouped(rows, 2).orderBy("pos").collect()]
    assert got == [("a", 1, 2), ("a", 2, 2), ("b", 3, 1)]
    assert search.grouped(rows, 1).count() == 1


def test_limits_and_modes():
    assert [search.normalize_limit(x) for x in (None, 0, -1, float("nan"), 2.9, 1000)] == [5, 5, 5, 5, 2, 100]
    assert search.normalize_mode("x") == "hybrid"


def chunk(session, i, content, tool="codex", branch=None, minute=None):
    from skein.schema import METADATA

    meta = tuple(branch if f.name == "git_branch" else None for f in METADATA)
    from datetime import datetime, timedelta

    return (tool, session, datetime(2026, 5, 10, 10) + timedelta(minutes=i if minute is None else minute), "user" if i % 2 == 0 else "assistant", content, i, meta)


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"), 2, 1)


def chunks(spark, *rows):
    from skein.schema import CHUNK

    return spark.createDataFrame(list(rows), CHUNK)


def test_ingest_is_idempotent_and_incremental(spark, store):
    first = chunks(spark, chunk("s", 0, "alpha cache"), chunk("s", 1, "beta"), chunk("t", 0, "gamma", branch="main"), chunk("t", 1, "  "))
    store.ingest(first)
    store.ingest(first)
    assert store.messages().count() == 3 and store.units().count() == 2
    before = {r.unit_id for r in store.units().collect()}
    store.ingest(chunks(spark, chunk("s", 2, "delta cache cache"), chunk("t", 2, "late", branch="dev")))
    units = store.units().collect()
    assert len(units) == 3 and len({r.unit_id for r in units} & before) == 1
    by = {r.session_ref: r for r in store.sessions().collect()}
    assert by["codex:s"].message_count == 3 and by["codex:s"].preview == "alpha cache" and by["codex:t"].git_branch == "main"
    assert status.recent_sessions(store.sessions(), branches=["main"]).count() == 1
    assert str(store.cursors().first().last_timestamp) == "2026-05-10 10:01:59"
    again = Store(spark, store.root, 2, 1)
    state = again.state()
    with pytest.raises(ConflictError):
        again._commit(state | {"version": state["version"] - 1}, {})


def test_search_service(spark, store):
    rows = [chunk("old", i, "cache invalidation bug in the cache layer") for i in range(3)] + [chunk("new", 0, "we mention cache once among many other unrelated words here", minute=600)]
    store.ingest(chunks(spark, *rows))
    service = Service(spark, store, embed.HashingEmbedder(64))
    found = service.search("cache invalidation", mode="keyword").orderBy("session_rank", "match").collect()
    assert found[0].session_ref == "codex:old" and found[0].score > 0
    assert {r.session_ref for r in service.search("cache invalidation").collect()} >= {"codex:old"}
    assert service.search("zqxv wvutq").isEmpty() and service.search("  ") is None
    assert service.status()["vectorized_units"] == service.status()["retrieval_units"] > 0
    assert service.manifest(["codex:old", "codex:none"])["missing_session_refs"] == ["codex:none"]
    assert "codex:old" in render.session_list([r.asDict() for r in service.recent_sessions().collect()])
    page = [r.asDict() for r in service.session_detail("codex:old", 1, 1).collect()]
    assert len(page) == 1 and "~~~" in render.session_detail("codex:old", page, 1, 1)
    answer = service.answer("cache invalidation")
    assert answer["mode"] == "hybrid" and answer["sessions"][0]["matches"] and answer["progress"]["vectorized_units"] == answer["progress"]["retrieval_units"]
    assert "codex:old" in render.search_answer(answer) and "Mode: hybrid" in render.search_answer(answer)
    assert service.manifest(["codex:old"], tools=["cursor"])["missing_session_refs"] == ["codex:old"]
    assert "codex:none: not stored" in render.manifest(service.manifest(["codex:old", "codex:none"]))
    assert service.indexed_sessions().count() == 2

    class Slow(embed.HashingEmbedder):
        def ready(self):
            return False

    waiting = Service(spark, store, Slow(64))
    assert waiting.answer("cache")["mode"] == "keyword" and waiting.progress()["loading"]
    assert render.failure(ValueError("no C:\\x\\y"))["message"] == "no <path>"
    calls_by_name(service)
    broken = Service(spark, store, None)
    assert not broken.search("cache").isEmpty() and broken.embedding_error
    with pytest.raises(RuntimeError):
        broken.search("cache", mode="vector")


def calls_by_name(service):
    """Envelopes: values with texts, and three kinds of errors."""
    good = service.call("manifest", {"refs": ["codex:old"], "correlation_id": " c1 "})
    value = good["value"]
    assert not good["is_error"] and value["correlation_id"] == "c1" and value["freshness"]["indexed_sessions"] == 2 and value["freshness"]["indexing"]["scanning"] is False
    assert value["sessions"][0]["started_at"] == "2026-05-10T10:00:00.000Z" and "c1" in good["text"]
    assert service.call("search_sessions", {"query": "cache", "format": "markdown"})["text"].startswith("**Found**")
    assert "`codex:new`" in service.call("recent_sessions", "no mapping")["text"].replace('"codex:new"', "`codex:new`")
    assert service.call("session_detail", {"session_ref": "codex:old", "limit": 1})["value"]["messages"][0]["role"] == "user"
    assert service.call("status", {"format": "markdown"})["text"].startswith("**Stored**")
    kinds = [service.call(*c)["kind"] for c in (("no_such_query", {}), ("search_sessions", {"query": " "}), ("search_sessions", {"q": "x"}), ("session_detail", {}))]
    assert kinds == ["not_found", "invalid_argument", "invalid_argument", "invalid_argument"]


def test_index_is_stored_and_pruned(spark, store):
    """A search reads the postings of its terms' buckets alone, a batch the buckets of its sessions, and both equal a fresh index."""
    store.ingest(chunks(spark, *(chunk(f"s{i}", j, f"cache number{i} word{j} invalidation") for i in range(12) for j in range(3))))
    store.ingest(chunks(spark, *(chunk(f"s{i}", 3, "late cache entry") for i in range(4))))
    units = store.units()
    index, stats = store.index(["cache", "late"])
    fresh = lexical.postings(units).filter("term in ('cache', 'late')")
    shown = lambda df: sorted((r.unit_id, r.term, r.tf, tuple(r.positions)) for r in df.collect())
    assert shown(index) == shown(fresh) and stats.count() == units.count()
    read = {f.split("/")[-2] for f in store.raw("postings", spark.createDataFrame([("cache",), ("late",)], "term string")).inputFiles()}
    assert len(read) <= 2 < len({f.split("/")[-2] for f in store.raw("postings").inputFiles()})
    touched = spark.createDataFrame([("codex:s1",)], "session_ref string")
    assert {r.session_ref for r in store.messages(touched).select("session_ref").distinct().collect()} < {r.session_ref for r in store.messages().select("session_ref").distinct().collect()}
    rows = lambda df: sorted(map(repr, df.drop("seq").collect()))
    before = [rows(t) for t in (store.messages(), store.units(), store.sessions(), store.cursors())]
    found = shown(store.index(["cache", "late"])[0])
    store.compact()
    assert [rows(t) for t in (store.messages(), store.units(), store.sessions(), store.cursors())] == before and len(store.state()["batches"]) == 1
    assert shown(store.index(["cache", "late"])[0]) == found
    store.ingest(chunks(spark, chunk("s1", 4, "after it")))
    assert store.messages().count() == 41


def test_two_writers_store_a_message_once(spark, store, monkeypatch):
    """A commit between a writer's plan and its own commit makes it plan anew; compaction beside it loses nothing."""
    store.ingest(chunks(spark, chunk("s", 0, "one")))
    other, commit = Store(spark, store.root, 2, 1), Store._commit
    meant = [lambda: other.ingest(chunks(spark, chunk("s", 1, "two"), chunk("s", 2, "three"))), other.compact, lambda: other.set(k="v")]

    def interrupted(self, *given):
        if self is store and meant:
            meant.pop(0)()
        commit(self, *given)

    monkeypatch.setattr(Store, "_commit", interrupted)
    store.ingest(chunks(spark, chunk("s", 1, "two"), chunk("s", 3, "four")))
    assert sorted(r.content for r in store.messages().collect()) == ["four", "one", "three", "two"] and not meant
    assert store.sessions().first().message_count == 4 and store.settings() == {"k": "v"} and store.units().count() == 3
    data = {s.getPath().getName() for s in store._fs(f"{store.root}/data")[0].listStatus(store._fs(f"{store.root}/data")[1])}
    assert {b["id"] for b in store.state()["batches"]} <= data and len(data) == 5  # what was planned in vain is gone


def test_snapshot_is_one_version_and_old_files_expire(spark, store):
    store.ingest(chunks(spark, chunk("s", 0, "one")), tag="q-0")
    before = store.snapshot()
    store.ingest(chunks(spark, chunk("s", 1, "two")), tag="q-1")
    assert before.messages().count() == 1 and before.sessions().first().message_count == 1 and store.messages().count() == 2
    store.compact()
    assert store.state()["tags"] == {"q": 1} and store.expire() == 0 and before.messages().count() == 1
    assert store.expire(0) == 2 and len(store._versions()) == 1
    assert sorted(r.content for r in store.messages().collect()) == ["one", "two"]
    store.ingest(chunks(spark, chunk("s", 2, "three")), tag="q-1")
    assert store.messages().count() == 2


def test_buckets_grow_and_large_ones_are_split(spark, store, monkeypatch):
    from skein.operators import store as S

    monkeypatch.setattr(S, "BUCKET_ROWS", 10)
    store.ingest(chunks(spark, *(chunk(f"t{i}", 0, f"few {i}") for i in range(5))))
    store.ingest(chunks(spark, *(chunk(f"s{i}", j, f"text {i} {j}") for i in range(120) for j in range(4))))
    assert [b["buckets"] for b in store.state()["batches"]] == [16, 64]
    folders = {f.split("/")[-2] for f in store.raw("messages").inputFiles()}
    assert len(folders) > 40 and store.messages().count() == 485
    some = spark.createDataFrame([("codex:s7",), ("codex:t1",)], "session_ref string")
    assert len(store.raw("messages", some).inputFiles()) <= 3 and {"codex:s7", "codex:t1"} <= {r.session_ref for r in store.messages(some).collect()}


def test_other_schema_is_left_alone_by_readers(spark, store, monkeypatch):
    from skein import schema

    store.ingest(chunks(spark, chunk("s", 0, "one")))
    monkeypatch.setattr(schema, "SCHEMA_VERSION", 99)
    assert Store(spark, store.root).messages() is None and len(store._versions()) == 1
    store.ingest(chunks(spark, chunk("s", 1, "two")))
    assert [r.content for r in store.messages().collect()] == ["two"]


def test_windows_of_one_long_session(spark):
    """A session that is all of the data still numbers its messages over several days."""
    rows = [chunk("s", i, f"m{i}", minute=400 * i) for i in range(50)]
    units = windows.retrieval_units(ingest.to_messages(chunks(spark, *rows)), 8, 4).orderBy("message_start_index").collect()
    assert [(u.message_start_index, u.message_end_index) for u in units] == [(s, min(s + 8, 50) - 1) for s in range(0, 45, 4)]
    assert all(u.searchable_text.split("\n") == [f"m{i}" for i in range(u.message_start_index, u.message_end_index + 1)] for u in units)


def test_nearest_in_blocks(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(90, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    q = df.filter("vec_id % 9 = 0").selectExpr("vec_id AS query_id", "embedding AS q")
    whole, cut = (sorted(map(tuple, search.nearest(q, df, 4, *sizes).collect())) for sizes in ((), (16, 3)))
    unit_x = x / np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(0, 90, 9):
        order = sorted((j for j in range(90) if j != i), key=lambda j: (-round(float(unit_x[i] @ unit_x[j]), 6), j))[:4]
        assert [v for _, v in sorted((r, v) for a, v, _, r in whole if a == i)] == order
    assert whole == cut


def test_stream_into_store(spark, store, tmp_path):
    arrivals, checkpoint = str(tmp_path / "arrivals"), str(tmp_path / "checkpoint")
    for part in ([chunk("s", 0, "one"), chunk("s", 0, "one")], [chunk("s", 1, "two")]):
        chunks(spark, *part).write.mode("append").parquet(arrivals)
        incremental.into_store(incremental.chunk_stream(spark, arrivals), store, checkpoint).awaitTermination()
    assert sorted(r.content for r in store.messages().collect()) == ["one", "two"]
    assert store.sessions().first().message_count == 2
    n = len(store.state()["batches"])
    store.ingest(chunks(spark, chunk("s", 5, "again")), tag="chunks-0")
    assert len(store.state()["batches"]) == n


def test_failing_source_is_isolated(spark, store):
    from skein.sources.registry import Registry, Source

    good = Source("codex", "Codex", "/tmp", lambda s, *_: (chunks(s, chunk("s", 0, "ok")), None))

    def fail(*_):
        raise OSError("cannot open /var/x")

    registry = Registry()
    for s in (Source("cursor", "Cursor", "/tmp", fail), good):
        registry.register(s)
    assert set(incremental.refresh(spark, store, registry.available(spark))) == {"cursor"}
    assert store.messages().count() == 1 and store.settings()["last_error:cursor"] == "cannot open <path>"
    assert [r.tool for r in store.cursors().collect()] == ["codex"]


def test_running_index_stream(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "k string, t int").write.parquet(path)
    rows = incremental.running_index(spark.readStream.schema("k string, t int").parquet(path), "k", "t")
    q = rows.writeStream.format("memory").queryName("counted").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(tuple(r) for r in spark.table("counted").collect()) == [("a", 1, 0), ("a", 2, 1), ("b", 1, 0)]


def test_terms_fold_as_the_full_text_tokeniser_does(spark):
    """Every letter, digit and mark of the first plane between two letters, against SQLite's tokeniser; its tables end with Unicode 6.1."""
    import sqlite3
    import unicodedata

    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize='unicode61')")
    db.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, instance)")
    points = [c for c in range(0x80, 0x10000) if unicodedata.category(chr(c)) in ("Lu", "Ll", "Lt", "Lm", "Lo", "Nd", "Nl", "No") or c in range(0x300, 0x332)]
    db.executemany("INSERT INTO t (rowid, x) VALUES (?, ?)", [(c, f"a{chr(c)}b") for c in points])
    want = {}
    for term, c in db.execute("SELECT term, doc FROM v ORDER BY doc, offset"):
        want.setdefault(c, []).append(term)
    rows = spark.createDataFrame([(c, f"a{chr(c)}b") for c in points], "c int, x string").filter(~F.col("x").rlike(r"\p{Cn}")).select("c", X.document_terms(F.col("x")).alias("terms")).collect()  # what Java knows
    newer = lambda c: want[c] == [f"a{chr(c)}b"] and (chr(c).isupper() or c >= 0x1C80 and not unicodedata.decomposition(chr(c)))  # noqa: E731  (cases that its tables don't know)
    differ = [hex(r.c) for r in rows if r.terms != want[r.c] and not newer(r.c) and not 0x19B0 <= r.c <= 0x19C9 and not 0x1CF2 <= r.c <= 0x1CF3 and not 0xAB70 <= r.c <= 0xABBF and not 0x13F8 <= r.c <= 0x13FD]
    assert differ == [] and len(rows) > 48_000
    assert spark.range(1).select(X.document_terms(F.lit("Cafe\u0301 TIẾNG Ơn µ"))).first()[0] == ["cafe", "tiếng", "on", "μ"]


def test_shapes_of_nested_values():
    """Five levels of objects, arrays of arrays, keys that are data, empty objects and arrays."""
    import json

    deep = {"l1": {"l2": {"l3": {"l4": {"l5": {"l6": 1}}}}}}
    value = {"a-b": 1, "x.y": None, "$@:9": True, "k" * 64: "s", "k" * 65: "s", "/home/me": 1.5, "0123456789abcdef": 1, "DEADBEEF-0000-1111-2222-333344445555": [], "n": [[1, "x"], [None], {}, []], "none": {}, **deep}
    got = sorted(profile.shape_lines(json.dumps(value)))
    assert got == sorted(["a-b: number", "x.y: null", "$@:9: boolean", f"{'k' * 64}: string", "*: string", "*: number", "*: number", "*: array<empty>", "n: array<array<empty>|array<null>|array<number|string>|object>", "l1.l2.l3.l4.l5: object"])
    assert list(profile.shape_lines("[1]")) == [] and list(profile.shape_lines(None)) == ["$: invalid"]


def test_counters_go_at_any_depth(spark):
    one, two = '{"a": {"filesSampled": 3, "b": [{"recordsSampled": 9, "c": 1}]}}', '{"a":{"b":[{"c":1}],\r\n"filesSampled":77}}'
    got = spark.createDataFrame([(one,), (two,), ("no json",), (None,)], "x string").select(profile.comparable_json(F.col("x"))).collect()
    assert got[0][0] == got[1][0] and "filesSampled" not in got[0][0] and got[2][0] is None and got[3][0] is None


def test_fingerprints(spark):
    rows = spark.createDataFrame([("a", '{"x": 1, "y": {"deadbeefdeadbeef": [1, "s"]}}'), ("a", "{bad"), ("a", None)], "record_type string, json string")
    before = profile.fingerprint(rows.limit(1))
    assert before.first().shapes.split("\n") == ["x: number", "y.*: array<number|string>"]
    assert [r["shape"] for r in profile.added_lines(before, profile.fingerprint(rows)).collect()] == ["$: invalid"]


def test_fingerprints_are_compared_without_noise(spark):
    before = spark.createDataFrame([("a", "x: number\r\ny: string", 3), ("b", "z: null", 1)], "record_type string, shapes string, recordsSampled int")
    after = spark.createDataFrame([("a", "x: number\ny: string", 900), ("c", "z: null", 1)], "record_type string, shapes string, recordsSampled int")
    assert sorted(r.record_type for r in profile.differing(before, after).collect()) == ["b", "c"]
    files = spark.createDataFrame([("/s/state.vscdb",), ("/s/state.vscdb-wal",), ("/s/state.db-journal",), ("/s/notes-wal.md",)], "path string")
    assert sorted(r.path for r in profile.lasting(files).collect()) == ["/s/notes-wal.md", "/s/state.vscdb"]


def test_newest_sample(spark):
    files = spark.createDataFrame([("old", 1), ("new", 3), ("mid", 2)], "path string, modified int")
    records = spark.createDataFrame([(p, i, f"{p}{i}") for p in ("old", "mid", "new") for i in range(5)], "path string, line_no int, value string")
    assert sorted(r.value for r in profile.newest_sample(files, records, 2, 3).collect()) == ["mid0", "mid1", "mid2", "new0", "new1", "new2"]


def test_queries_match_their_sql(spark):
    db = duckdb.connect()
    for t in ("conversations", "embeddings", "documents", "events", "pages"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    rows = lambda df: sorted(map(repr, df[sorted(df.columns)].itertuples(index=False, name=None)))
    for name in ("recent_sessions", "manifest_resolve", "sliding_windows_4_2", "window_diff", "phrase_match", "keyword_search", "vector_search", "hybrid_search", "drift_summary", "path_scope"):
        got, want = catalogue.QUERIES[name](spark, DATA).toPandas(), db.execute(catalogue.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns), name
        clean = lambda df: df.astype(object).map(lambda x: x.item() if hasattr(x, "item") else x)
        assert rows(clean(got)) == rows(clean(want)), name
    assert set(catalogue.ORACLE_SQL) <= set(catalogue.QUERIES)
