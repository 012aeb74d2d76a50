"""Golden rows of every source, attribution, index rules and a mutation battery."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from skein.sources import artifacts, jsonl, sqlite

T = "2026-05-10T10:00:0{}.000Z"


def lines(path, *records):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in records) + "\n")
    return str(path.parent)


def shown(chunks):
    return [(r.session_id, r.role, r.content, r.message_index) for r in chunks.orderBy("session_id", "message_index").collect()]


def surprises(drift):
    return sorted(r.surprise for r in drift.collect())


def claude(tmp_path, *records):
    return lines(tmp_path / "-work-app" / "s1.jsonl", *records)


GOOD = [
    {"type": "human", "content": "hi", "timestamp": T.format(0)},
    {"type": "mode", "mode": "normal"},
    {"type": "assistant", "timestamp": T.format(1), "cwd": "/work/app", "gitBranch": "main", "message": {"role": "assistant", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}},
    {"type": "human", "content": "bye", "timestamp": T.format(2), "extra": {"new": 1}},
]


def test_claude_code(spark, tmp_path):
    chunks, drift = jsonl.claude_code(jsonl.read_lines(spark, claude(tmp_path, *GOOD, "", "{bad")))
    assert shown(chunks) == [("s1", "user", "hi", 0), ("s1", "assistant", "a\nb", 1), ("s1", "user", "bye", 2)]
    assert surprises(drift) == ["unreadable JSON"]
    assert [r.metadata.git_branch for r in chunks.orderBy("message_index").collect()] == [None, "main", None]


def test_claude_code_scope_and_cutoff(spark, tmp_path):
    path = claude(tmp_path, GOOD[0], GOOD[2] | {"cwd": "/work/other"}, GOOD[3])
    rows = jsonl.in_project_dirs(jsonl.read_lines(spark, path), "/work/app")
    chunks, _ = jsonl.claude_code(rows, "/work/app", F.col("exact"), F.lit("2026-05-10 10:00:01").cast("timestamp"))
    assert shown(chunks) == [("s1", "user", "bye", 1)]
    sibling = jsonl.in_project_dirs(jsonl.read_lines(spark, path), "/work")
    assert shown(jsonl.claude_code(sibling, "/work", F.col("exact"))[0]) == [("s1", "assistant", "a\nb", 0)]


@pytest.mark.parametrize("field, value", [("type", None), ("type", 7), ("content", 5), ("content", {"x": 1}), ("timestamp", None), ("timestamp", 3)])
def test_claude_code_mutations_are_loud(spark, tmp_path, field, value):
    _, drift = jsonl.claude_code(jsonl.read_lines(spark, claude(tmp_path, GOOD[0] | {field: value}, GOOD[0])))
    assert surprises(drift)


def codex_file(tmp_path, *more):
    meta = {"timestamp": T.format(0), "type": "session_meta", "payload": {"id": "c1", "cwd": "/work/app", "git": {"branch": "main", "commit_hash": "abc"}}}
    context = {"timestamp": T.format(0), "type": "turn_context", "payload": {"approval_policy": "full-auto", "sandbox_policy": {"type": "strict"}}}
    user = {"timestamp": T.format(1), "type": "event_msg", "payload": {"type": "user_message", "message": "q"}}
    said = {"timestamp": T.format(2), "type": "response_item", "payload": {"type": "message", "role": "assistant", "content": [{"type": "output_text", "text": "a"}]}}
    injected = {"timestamp": T.format(2), "type": "response_item", "payload": {"type": "message", "role": "user", "content": "context"}}
    return lines(tmp_path / "2026" / "05" / "f.jsonl", meta, context, user, injected, said, *more)


def test_codex(spark, tmp_path):
    folder = {"timestamp": T.format(3), "type": "turn_context", "payload": {"cwd": "/else"}}
    late = {"timestamp": T.format(4), "type": "event_msg", "payload": {"type": "user_message", "message": "lost"}}
    path = codex_file(tmp_path, {"type": "compacted", "timestamp": T.format(3), "payload": {"summary": "sum"}}, {"type": "odd", "payload": {}}, folder, late)
    chunks, drift = jsonl.codex(jsonl.read_lines(spark, path), "/work/app")
    assert shown(chunks) == [("c1", "user", "q", 0), ("c1", "assistant", "a", 2), ("c1", "assistant", "sum", 3)]
    m = chunks.orderBy("message_index").collect()[-1].metadata
    assert (m.git_branch, m.git_commit, m.approval_mode, m.sandboxed, m.layer) == ("main", "abc", "full-auto", True, 1)
    assert surprises(drift) == ["unlisted event: odd"]
    assert shown(jsonl.codex(jsonl.read_lines(spark, path), "/nowhere")[0]) == []


def test_copilot_cli(spark, tmp_path):
    start = {"type": "session.start", "timestamp": T.format(0), "data": {"context": {"cwd": "/work/app", "branch": "dev", "headCommit": "f00"}}}
    said = [{"type": "user.message", "timestamp": T.format(1), "data": {"content": " hello "}}, {"type": "status", "data": {}}, {"role": "assistant", "content": "old form", "timestamp": T.format(2)}, {"type": "message", "content": "who?"}]
    path = lines(tmp_path / "x1" / "events.jsonl", start, *said)
    chunks, drift = jsonl.copilot_cli(jsonl.read_lines(spark, path), "/work/app")
    assert shown(chunks) == [("x1", "user", "hello", 0), ("x1", "assistant", "old form", 1)]
    assert chunks.first().metadata.git_branch == "dev" and surprises(drift) == ["content without a role"]
    assert shown(jsonl.copilot_cli(jsonl.read_lines(spark, path), "/work/else")[0]) == []
    bare = lines(tmp_path / "y1" / "x2" / "events.jsonl", *said)
    chunks, drift = jsonl.copilot_cli(jsonl.read_lines(spark, bare), "/work/app")
    assert shown(chunks) == [] and any("project unknown" in s for s in surprises(drift))


def test_scan_equals_windows_on_any_split(spark):
    """Counts, last values and conditions over blocks are those of one window over the whole key, wherever blocks begin."""
    import random

    from skein.functions import fold

    r = random.Random(9)
    rows = []
    for key in "abc":
        cut = sorted(r.sample(range(200), 7))
        rows += [(key, sum(c <= i for c in cut), i, r.random() < 0.4, r.choice([None, None, "x", "y"]), r.random() < 0.01) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, b int, i int, takes boolean, said string, ends boolean").repartition(3)
    got = fold.scan(df, "k", "b", "i", counts={"n": F.col("takes")}, latest={"last": F.col("said")}, held={"ended": F.col("ends")})
    want = df.withColumns({"n": fold.running_index(F.col("takes"), "k", "i"), "last": fold.carried(F.col("said"), "k", "i"), "ended": fold.ever(F.col("ends"), "k", "i")})
    assert sorted(map(repr, got.select(*want.columns).collect())) == sorted(map(repr, want.collect()))


def test_one_large_file_is_read_by_many_tasks(spark, tmp_path):
    """Three sources, each from one file cut into many splits: the same chunks as from one split."""
    user = lambda i: {"timestamp": T.format(1), "type": "event_msg", "payload": {"type": "user_message", "message": f"q{i}"}}
    meta = {"type": "session_meta", "payload": {"id": "c1", "cwd": "/work/app", "git": {"branch": "main"}}}
    turn = lambda i: {"type": "turn_context", "payload": {"approval_policy": "full-auto" if i % 2 else "suggest", "cwd": "/work/app" if i < 250 else "/else"}}
    files = {
        "codex": lines(tmp_path / "a" / "f.jsonl", meta, *(user(i) if i % 50 else turn(i) for i in range(300))),
        "claude": lines(tmp_path / "b" / "s1.jsonl", *({"type": "human", "content": f"hi {i}" * (i % 7), "timestamp": T.format(0)} for i in range(300))),
        "cli": lines(tmp_path / "c" / "events.jsonl", {"type": "session.start", "data": {"context": {"cwd": "/work/app", "branch": "dev"}}}, *({"type": "user.message", "data": {"content": f"c{i}"}} for i in range(300))),
    }
    read = {"codex": lambda x: jsonl.codex(x, "/work/app"), "claude": jsonl.claude_code, "cli": lambda x: jsonl.copilot_cli(x, "/work/app")}
    rows = lambda tool: [sorted(map(repr, df.collect())) for df in read[tool](jsonl.read_lines(spark, files[tool]))]
    whole = {tool: rows(tool) for tool in files}
    assert {t: len(x[0]) for t, x in whole.items()} == {"codex": 245, "claude": 257, "cli": 300}
    keys = {"spark.sql.files.maxPartitionBytes": "2000", "spark.sql.files.openCostInBytes": "0"}
    old = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        assert all(jsonl.read_lines(spark, f).select("block").distinct().count() > 5 for f in files.values())
        assert {tool: rows(tool) for tool in files} == whole
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_files_that_are_not_read_whole_are_reported(spark, tmp_path, monkeypatch):
    """A truncated and a garbled archive and a vanished file: one drift row each, and the rest is read."""
    import gzip

    from pyspark.sql.classic.dataframe import DataFrame as Classic

    folder = tmp_path / "with space"
    path = lines(folder / "good.jsonl", *GOOD)
    (folder / "empty.jsonl").write_text("")
    (folder / "crlf.jsonl").write_bytes(b'{"type":"human","content":"x","timestamp":"2026-05-10T10:00:00Z"}\r\n' * 3)
    body = gzip.compress("\n".join(json.dumps(GOOD[0] | {"content": f"{i} {hash((i, 'x'))}"}) for i in range(5000)).encode())
    (folder / "fine.jsonl.gz").write_bytes(body)
    (folder / "cut.jsonl.gz").write_bytes(body[: len(body) // 2])
    (folder / "bad.jsonl.gz").write_bytes(b"no archive at all")
    listed = Classic.inputFiles
    monkeypatch.setattr(Classic, "inputFiles", lambda self: [*listed(self), f"file://{folder}/gone.jsonl"])
    got = {r.location.rsplit("/", 1)[1]: r for r in jsonl.unread(spark, path, "claude-code", "*.jsonl*").collect()}
    assert set(got) == {"cut.jsonl.gz", "bad.jsonl.gz", "gone.jsonl"} and got["gone.jsonl"].surprise == "file vanished" and all(r.records == 1 for r in got.values())
    read = jsonl.claude_code(jsonl.read_lines(spark, path, "*.jsonl*"))[0].groupBy("session_id").count().collect()
    assert {r.session_id: r["count"] for r in read}.items() >= {"good": 3, "crlf": 3, "fine.jsonl": 5000}.items()


def database(path, *statements):
    path.parent.mkdir(parents=True, exist_ok=True)
    db = sqlite3.connect(path)
    for sql, *args in statements:
        db.execute(sql, args)
    db.commit()
    db.close()
    return str(path.parent)


def item_table(path, key, value):
    return database(path, ("CREATE TABLE ItemTable (key TEXT PRIMARY KEY, value TEXT)",), ("INSERT INTO ItemTable VALUES (?, ?)", key, json.dumps(value)))


def test_copilot(spark, tmp_path):
    turn = lambda q, a, **k: {"message": {"parts": [{"text": q}]}, "response": [{"value": a}, {"value": "!"}], "model": "m", **k}
    good = {"sessionId": "s1", "creationDate": 1716578000000, "requests": [turn("q1", "a1"), turn("no", "no", isCanceled=True), turn("q2", "a2", agentId="x")]}
    path = item_table(tmp_path / "w" / "h1" / "state.vscdb", "interactive.sessions", {"s1": good, "s2": {"sessionId": "s2", "creationDate": 1, "turns": []}})
    (tmp_path / "w" / "h1" / "workspace.json").write_text(json.dumps({"folder": "file:///work/app"}))
    chunks, drift = sqlite.copilot(spark, path, sqlite.workspace_roots(spark, path), "/work/app")
    assert shown(chunks) == [("s1", "user", "q1", 0), ("s1", "assistant", "a1!", 1), ("s1", "user", "q2", 2), ("s1", "assistant", "a2!", 3)]
    assert [r.metadata.completion_type for r in chunks.orderBy("message_index").collect()] == ["chat", "chat", "agent", "agent"]
    assert surprises(drift) == ["no field requests, another field holds an array"]
    assert shown(sqlite.copilot(spark, path, sqlite.workspace_roots(spark, path), "/work/else")[0]) == []


def test_cursor(spark, tmp_path):
    where = item_table(tmp_path / "ws" / "h" / "state.vscdb", "composer.composerData", {"allComposers": [{"composerId": "c1"}, {"composerId": "gone"}]})
    kv = {"composerData:c1": {"fullConversationHeadersOnly": [{"bubbleId": "b1"}, {"bubbleId": "missing"}, {"bubbleId": "b2"}, {"bubbleId": "b3"}], "modelConfig": {"modelName": "m"}, "unifiedMode": "agent"}, "bubbleId:c1:b1": {"type": 1, "text": "q", "createdAt": T.format(1)}, "bubbleId:c1:b2": {"type": 2, "text": " "}, "bubbleId:c1:b3": {"type": 2, "text": "a", "createdAt": 1716578000}}
    glob = database(tmp_path / "gs" / "state.vscdb", ("CREATE TABLE cursorDiskKV (key TEXT, value TEXT)",), *(("INSERT INTO cursorDiskKV VALUES (?, ?)", k, json.dumps(v)) for k, v in kv.items()))
    chunks, drift = sqlite.cursor(spark, where, glob)
    assert shown(chunks) == [("c1", "user", "q", 0), ("c1", "assistant", "a", 2)]
    assert chunks.first().metadata.composer_mode == "agent" and surprises(drift) == ["listed conversation is not stored"]


def test_opencode(spark, tmp_path):
    msg = lambda i, role, t: ("INSERT INTO message VALUES (?, 's1', ?, ?)", i, t, json.dumps({"role": role, "modelID": "m"} if role else {"rolle": "x"}))
    part = lambda i, m, t, kind, text: ("INSERT INTO part VALUES (?, ?, ?, ?)", i, m, t, json.dumps({"type": kind, "text": text}))
    path = database(
        tmp_path / "o" / "opencode.db",
        ("CREATE TABLE session (id TEXT, directory TEXT)",), ("CREATE TABLE message (id TEXT, session_id TEXT, time_created INT, data TEXT)",), ("CREATE TABLE part (id TEXT, message_id TEXT, time_created INT, data TEXT)",),
        ("INSERT INTO session VALUES ('s1', '/work/app'), ('s2', NULL)",),
        msg("m1", "user", 1716578000000), msg("m2", None, 1716578000500), msg("m3", "assistant", 1716578001000),
        part("p2", "m1", 2, "text", "second"), part("p1", "m1", 1, "text", "first"), part("p3", "m1", 3, "reasoning", "no"), part("p4", "m3", 1, "text", "a"),
    )
    chunks, drift = sqlite.opencode(spark, path, "/work/app")
    assert shown(chunks) == [("s1", "user", "first\nsecond", 0), ("s1", "assistant", "a", 1)]
    assert surprises(drift) == ["message: no field role", "session without a directory, project unknown"]
    (tmp_path / "o" / "opencode.db").write_bytes(b"not a database at all" * 100)
    chunks, drift = sqlite.opencode(spark, path)
    assert shown(chunks) == [] and any(s.startswith("query failed") for s in surprises(drift))


def test_antigravity_artifacts(spark, tmp_path):
    folder = tmp_path / "brain" / "s1"
    folder.mkdir(parents=True)
    (folder / "plan.md").write_text("see file:///work/app/x%20y.ts\n")
    (folder / "plan.md.metadata.json").write_text(json.dumps({"artifactType": "PLAN", "summary": "sum", "updatedAt": T.format(5)}))
    (folder / "plan.md.resolved").write_text("no")
    row = artifacts.artifacts(spark, str(tmp_path / "brain"), "/work/app").first()
    assert row.content.startswith(f"Antigravity artifact: plan.md\nSource: {folder}/plan.md\nType: PLAN\nSummary: sum\n\nsee ")
    assert (row.session_id, row.role, row.metadata.referenced_files) == ("s1", "assistant", ["file:///work/app/x y.ts"])
    assert artifacts.artifacts(spark, str(tmp_path / "brain"), "/work/else").isEmpty()
    (folder / "c9.pb").write_text("x")
    (folder / "c9.db").write_text("x")
    assert [r.session_id for r in artifacts.conversation_ids(spark, str(tmp_path)).collect()] == ["c9"]


def test_antigravity_steps(spark):
    at = lambda i, kind, **k: ("t1", json.dumps({"type": f"CORTEX_STEP_TYPE_{kind}", "metadata": {"createdAt": T.format(i), "generatorModel": "g"}, **k}), ["file:///work/app"])
    diff = {"unifiedDiff": {"lines": [{"type": "UNIFIED_DIFF_LINE_TYPE_DELETE", "text": "old"}, {"type": "UNIFIED_DIFF_LINE_TYPE_INSERT", "text": "new"}, {"text": "same"}]}}
    rows = [
        at(1, "USER_INPUT", userInput={"userResponse": "do it"}), at(2, "PLANNER_RESPONSE", plannerResponse={"response": "ok"}), at(3, "CODE_ACTION", codeAction={"actionResult": {"edit": {"absoluteUri": "file:///work/app/a.ts", "diff": diff}}}),
        at(4, "RUN_COMMAND", runCommand={"commandLine": "ls", "exitCode": 0, "combinedOutput": {"full": "x"}}), at(5, "FIND", find={"query": "needle"}), at(6, "LIST_DIRECTORY", listDirectory={"path": "/d"}), at(7, "UNKNOWN"), at(8, "COMMAND_STATUS"),
    ]
    got = artifacts.steps(spark.createDataFrame(rows, "session_id string, step string, workspaces array<string>"), "/work/app").orderBy("message_index").collect()
    assert [r.content for r in got] == ["do it", "ok", "[Code Edit] file:///work/app/a.ts\nDiff:\n-old\n+new\n same", "[Command] ls\nexit_code: 0\nOutput:\nx", "needle", "/d", "[Check Command Status]"]
    assert [r.role for r in got] == ["user", "assistant"] + ["tool"] * 5 and got[1].metadata.model == "g"
    summaries = spark.createDataFrame([("a", ["file:///work/app"]), ("b", ["file:///else"]), ("c", [])], "session_id string, workspaces array<string>")
    assert sorted(r.session_id for r in artifacts.prune_trajectories(summaries, "/work/app").collect()) == ["a", "c"]


def test_configured_sources(spark, tmp_path):
    from skein.sources import registry

    got = {s.tool: s for s in registry.configured({"tools": {"codex": {"enabled": False, "storePath": f" {tmp_path} "}, "cursor": {"storePath": 3}, "copilot": "x"}}, "/home/me/", {})}
    assert set(got) == set(registry.CATALOGUE) and got["codex"].path == str(tmp_path) and not got["codex"].enabled
    assert got["cursor"].path == "/home/me/.config/Cursor/User/workspaceStorage" and got["copilot"].enabled
    assert all(s.enabled for s in registry.configured(None, "/h", {}))
    known = registry.Registry()
    for s in (registry.Source("codex", "a", "/none"), registry.Source("codex", "b", str(tmp_path)), registry.Source("cursor", "c", "/none")):
        known.register(s)
    assert [s.label for s in known.available(spark)] == ["b"]
    known.deregister("codex")
    assert known.get("codex") is None and len(known.all()) == 1


def seven_stores(home, turn):
    """Stores of all tools with turns 0 to ``turn``: each holds one session under the project /work/app."""
    said = [(i, "user" if i % 2 == 0 else "assistant", f"said {i}", T.format(i)) for i in range(turn + 1)]
    lines(home / "claude" / "-work-app" / "s.jsonl", *({"type": r, "timestamp": t, "cwd": "/work/app", "content": x} for _, r, x, t in said))
    lines(home / "claude" / "-work-elsewhere" / "z.jsonl", {"type": "user", "timestamp": T.format(0), "content": "foreign"})
    meta = {"timestamp": T.format(0), "type": "session_meta", "payload": {"id": "s", "cwd": "/work/app"}}
    message = lambda r, x, t: {"timestamp": t, "type": "event_msg", "payload": {"type": "user_message", "message": x}} if r == "user" else {"timestamp": t, "type": "response_item", "payload": {"type": "message", "role": r, "content": [{"text": x}]}}
    lines(home / "codex" / "2026" / "f.jsonl", meta, *(message(r, x, t) for _, r, x, t in said))
    lines(home / "cli" / "s" / "events.jsonl", {"type": "session.start", "timestamp": T.format(0), "data": {"context": {"cwd": "/work/app"}}}, *({"type": f"{r}.message", "timestamp": t, "data": {"content": x}} for _, r, x, t in said))
    for p in ("copilot/h/state.vscdb", "cursor/workspaceStorage/h/state.vscdb", "cursor/globalStorage/state.vscdb", "oc/opencode.db"):
        (home / p).unlink(missing_ok=True)
    requests = [{"message": {"parts": [{"text": x}]}, "response": []} for _, _, x, _ in said]
    item_table(home / "copilot" / "h" / "state.vscdb", "interactive.sessions", {"s": {"sessionId": "s", "creationDate": 1778407200000, "requests": requests}})
    item_table(home / "cursor" / "workspaceStorage" / "h" / "state.vscdb", "composer.composerData", {"allComposers": [{"composerId": "s"}]})
    for p in ("copilot/h", "cursor/workspaceStorage/h"):
        (home / p / "workspace.json").write_text(json.dumps({"folder": "file:///work/app"}))
    kv = {"composerData:s": {"fullConversationHeadersOnly": [{"bubbleId": str(i)} for i, *_ in said], "modelConfig": {}}} | {f"bubbleId:s:{i}": {"type": 1 + i % 2, "text": x, "createdAt": t} for i, _, x, t in said}
    database(home / "cursor" / "globalStorage" / "state.vscdb", ("CREATE TABLE cursorDiskKV (key TEXT, value TEXT)",), *(("INSERT INTO cursorDiskKV VALUES (?, ?)", k, json.dumps(v)) for k, v in kv.items()))
    rows = [("INSERT INTO message VALUES (?, 's', ?, ?)", f"m{i}", 1778407200000 + 1000 * i, json.dumps({"role": r})) for i, r, *_ in said] + [("INSERT INTO part VALUES (?, ?, 1, ?)", f"p{i}", f"m{i}", json.dumps({"type": "text", "text": x})) for i, _, x, _ in said]
    database(home / "oc" / "opencode.db", ("CREATE TABLE session (id TEXT, directory TEXT)",), ("CREATE TABLE message (id TEXT, session_id TEXT, time_created INT, data TEXT)",), ("CREATE TABLE part (id TEXT, message_id TEXT, time_created INT, data TEXT)",), ("INSERT INTO session VALUES ('s', '/work/app')",), *rows)
    folder = home / "brain" / "s"
    folder.mkdir(parents=True, exist_ok=True)
    for i, _, x, t in said:
        (folder / f"n{i}.md").write_text(f"{x} in file:///work/app/x")
        (folder / f"n{i}.md.metadata.json").write_text(json.dumps({"updatedAt": t}))
    return {"claude-code": "claude", "codex": "codex", "copilot-cli": "cli", "copilot": "copilot", "cursor": "cursor/workspaceStorage", "opencode": "oc/opencode.db", "antigravity": "brain"}


def test_readers_start_from_the_cursor(spark, tmp_path):
    """All seven tools by their own readers: everything, then what is newer than a cursor (and, as ever, all of copilot's)."""
    from datetime import datetime

    from skein.sources import registry

    home = tmp_path / "home"
    config = {"tools": {tool: {"storePath": str(home / place)} for tool, place in seven_stores(home, 5).items()}}
    (tmp_path / "config.yaml").write_text(json.dumps(config))
    found = registry.configured(registry.load_config(spark, str(tmp_path / "config.yaml")), str(home), project_root="/work/app")
    assert registry.load_config(spark, str(tmp_path / "none.yaml")) == {}
    since = datetime(2026, 5, 10, 10, 0, 2)
    assert {s.tool: (s.read(spark, s, None)[0].count(), s.read(spark, s, since)[0].count()) for s in found} == dict.fromkeys(registry.CATALOGUE, (6, 3)) | {"copilot": (6, 6)}


def test_refresh_stores_what_is_new(spark, tmp_path):
    """A second refresh adds new turns; turns that come again are stored once."""
    from skein.operators.store import Store
    from skein.sources import registry
    from skein.streaming import incremental

    places = seven_stores(tmp_path / "home", 3)
    known = [registry.Source(tool, tool, str(tmp_path / "home" / places[tool]), registry.READERS[tool]) for tool in ("codex", "copilot")]
    store = Store(spark, str(tmp_path / "store"))
    count = lambda: {r.tool: r["count"] for r in store.messages().groupBy("tool").count().collect()}
    assert incremental.refresh(spark, store, known) == {} and count() == {"codex": 4, "copilot": 4}
    seven_stores(tmp_path / "home", 5)
    assert incremental.refresh(spark, store, known) == {} and count() == {"codex": 6, "copilot": 6}
    assert all(r.message_count == 6 for r in store.sessions().collect())


def test_package_is_shipped_once(spark):
    from skein.session import ship

    ship(spark)
    first = spark.sparkContext._skein_shipped
    assert ship(spark).sparkContext._skein_shipped == first and first.endswith(".zip")
