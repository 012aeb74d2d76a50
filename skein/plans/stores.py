"""Queries that read ``conversations`` back through each tool's extractor, from stores made of it.

Each store is what the tool keeps: lines of JSON, SQLite databases (one for a conversation), artifacts with sidecars, steps. The ``drift_*``
queries spoil some records first and count the surprises.
"""

from __future__ import annotations

import json
import sqlite3

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import text as X
from skein.functions import variants as V
from skein.sources import artifacts, jsonl, sqlite
from skein.sources.tables import START, table

ROOT = "/work/app"


def turns(spark: SparkSession, d: str) -> DataFrame:
    """conversations with session, time and folder; two of three conversations belong to the project."""
    conv, turn = F.col("conv_id"), F.col("turn")
    return table(spark, d, "conversations").select(
        "conv_id", "turn", "role", "text",
        F.concat(F.lit("conv-"), conv.cast("string")).alias("session"),
        X.iso_time(F.timestamp_seconds(START + conv * 3600 + turn * 60)).alias("at"),
        F.when(conv % 3 == 2, "/work/other").otherwise(ROOT).alias("cwd"),
    )


def _obj(**fields: Column) -> Column:
    return F.struct(*(c.alias(n) for n, c in fields.items()))


def _lines(rows: DataFrame) -> DataFrame:
    """Rows of file, line_no and line as a reader of lines gives them."""
    return rows.select("file", "line_no", "line", V.parse(F.col("line")).alias("v"))


def _shown(chunks: DataFrame) -> DataFrame:
    m = F.col("metadata")
    return chunks.select("tool", "session_id", X.iso_time(F.col("ts")).alias("at"), "role", "message_index", F.md5("content").alias("content_md5"), m["git_branch"].alias("git_branch"), m["model"].alias("model"))


def _surprises(drift: DataFrame) -> DataFrame:
    return drift.groupBy("tool", "surprise").agg(F.count("*").alias("n"), F.sum("records").alias("lost"))


def _claude_lines(t: DataFrame) -> DataFrame:
    said = _obj(role=F.col("role"), content=F.array(_obj(type=F.lit("text"), text=F.col("text"))))
    record = F.to_json(_obj(type=F.col("role"), timestamp=F.col("at"), cwd=F.col("cwd"), gitBranch=F.when(F.col("conv_id") % 2 == 0, "main"), message=said))
    return t.select(F.concat(F.lit("/s/-work-app/"), "session", F.lit(".jsonl")).alias("file"), F.col("turn").alias("line_no"), record.alias("line"), "conv_id", "turn", "text", "at")


def source_claude_code(spark, d):
    return _shown(jsonl.claude_code(_lines(_claude_lines(turns(spark, d))), ROOT, F.lit(True))[0])


def drift_claude_code(spark, d):
    t = _claude_lines(turns(spark, d))
    spoilt = F.when(F.col("turn") == 1, F.to_json(_obj(kind=F.lit("user"), timestamp=F.col("at"), content=F.col("text")))).when(F.col("turn") == 2, F.to_json(_obj(type=F.lit("user"), timestamp=F.lit(5), content=F.lit(7)))).when(F.col("turn") == 3, F.lit("{broken"))
    return _surprises(jsonl.claude_code(_lines(t.withColumn("line", F.coalesce(spoilt, "line"))))[1])


def _codex_lines(t: DataFrame) -> DataFrame:
    file, at = F.concat(F.lit("/s/2024/"), "session", F.lit(".jsonl")).alias("file"), F.col("at")
    line = lambda type_, **payload: F.to_json(_obj(timestamp=at, type=F.lit(type_), payload=_obj(**payload)))
    first = t.filter("turn = 0")
    meta = first.select(file, F.lit(-2).cast("long").alias("line_no"), line("session_meta", id=F.col("session"), cwd=F.col("cwd"), git=_obj(branch=F.lit("main"), commit_hash=F.lit("abc"))).alias("line"), "turn")
    context = first.select(file, F.lit(-1).cast("long").alias("line_no"), line("turn_context", approval_policy=F.lit("full-auto")).alias("line"), "turn")
    user = line("event_msg", type=F.lit("user_message"), message=F.col("text"))
    item = line("response_item", type=F.lit("message"), role=F.col("role"), content=F.array(_obj(type=F.lit("output_text"), text=F.col("text"))))
    said = t.select(file, F.col("turn").alias("line_no"), F.when(F.col("role") == "user", user).otherwise(item).alias("line"), "turn")
    return meta.unionByName(context).unionByName(said)


def source_codex(spark, d):
    return _shown(jsonl.codex(_lines(_codex_lines(turns(spark, d))), ROOT)[0])


def drift_codex(spark, d):
    lines = _codex_lines(turns(spark, d))
    said = F.col("line_no") >= 0
    spoilt = F.when(said & (F.col("turn") == 1), F.lit('{"type": "event_msg", "payload": 3}')).when(said & (F.col("turn") == 2), F.lit('{"type": "event_msg", "payload": {"kind": "user_message"}}')).when(said & (F.col("turn") == 3), F.lit('{"type": "surprise", "payload": {}}')).when(said & (F.col("turn") == 4), F.lit("["))
    return _surprises(jsonl.codex(_lines(lines.withColumn("line", F.coalesce(spoilt, "line"))))[1])


def _copilot_cli_lines(t: DataFrame) -> DataFrame:
    file = F.concat(F.lit("/s/"), "session", F.lit("/events.jsonl")).alias("file")
    start = F.to_json(_obj(type=F.lit("session.start"), timestamp=F.col("at"), data=_obj(context=_obj(cwd=F.col("cwd"), branch=F.lit("dev"))))).alias("line")
    said = F.to_json(_obj(type=F.concat("role", F.lit(".message")), timestamp=F.col("at"), data=_obj(content=F.col("text")))).alias("line")
    opened = t.filter("turn = 0").select(file, F.lit(-1).cast("long").alias("line_no"), start, "turn")
    return opened.unionByName(t.select(file, F.col("turn").alias("line_no"), said, "turn"))


def source_copilot_cli(spark, d):
    return _shown(jsonl.copilot_cli(_lines(_copilot_cli_lines(turns(spark, d))), ROOT)[0])


def drift_copilot_cli(spark, d):
    lines, said = _copilot_cli_lines(turns(spark, d)), F.col("line_no") >= 0
    spoilt = F.when(said & (F.col("turn") == 1), F.lit('{"type": "message", "content": "x"}')).when(said & (F.col("turn") == 2), F.lit('{"role": "user", "content": 4}')).when(said & (F.col("turn") == 3), F.lit("7")).when(said & (F.col("turn") == 4), F.lit("nothing"))
    return _surprises(jsonl.copilot_cli(_lines(lines.withColumn("line", F.coalesce(spoilt, "line"))))[1])


def _databases(statements: DataFrame) -> DataFrame:
    """path and content of a database for each path, by the rows' statements (seq, sql, args as a JSON array)."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        db = sqlite3.connect(":memory:")
        for sql, args in rows.sort_values("seq")[["sql", "args"]].itertuples(index=False):
            db.execute(sql, json.loads(args))
        db.commit()
        return pd.DataFrame({"path": [rows.path.iloc[0]], "content": [db.serialize()]})

    return statements.select("path", "seq", "sql", "args").groupBy("path").applyInPandas(build, "path string, content binary")


def _statement(path: Column, seq: Column, sql: str, *args: Column) -> list[Column]:
    listed = F.to_json(F.array(*(a.cast("string") for a in args))) if args else F.lit("[]")
    return [path.alias("path"), seq.cast("long").alias("seq"), F.lit(sql).alias("sql"), listed.alias("args")]


def _items(t: DataFrame, folder: str, key: str, value: Column) -> DataFrame:
    """Databases with one entry of an item table for each conversation; ``value`` is an aggregate over its turns."""
    path = F.concat(F.lit(f"{folder}/"), "session", F.lit("/state.vscdb"))
    one = t.groupBy("session").agg(value.alias("value"))
    made = one.select(*_statement(path, F.lit(0), "CREATE TABLE ItemTable (key TEXT PRIMARY KEY, value TEXT)"))
    return _databases(made.unionByName(one.select(*_statement(path, F.lit(1), "INSERT INTO ItemTable VALUES (?, ?)", F.lit(key), F.col("value")))))


def _in_order(value: Column) -> Column:
    return F.transform(F.sort_array(F.collect_list(F.struct("turn", value.alias("x")))), lambda s: s["x"])


def _copilot_store(t: DataFrame, requests: str = "requests", session: str = "sessionId") -> DataFrame:
    request = _obj(message=_obj(parts=F.array(_obj(text=F.col("text")))), response=F.array(_obj(value=F.lit("re: ")), _obj(value=F.col("text"))), isCanceled=F.col("turn") % 4 == 3, model=F.lit("m1"))
    whole = F.struct(F.first("session").alias(session), (F.first("conv_id") * 3_600_000 + START * 1000).alias("creationDate"), _in_order(request).alias(requests))
    return _items(t, "/ws", "interactive.sessions", F.to_json(F.map_from_arrays(F.array(F.first("session")), F.array(whole))))


def source_copilot(spark, d):
    return _shown(sqlite.copilot(spark, _copilot_store(turns(spark, d)))[0])


def drift_copilot(spark, d):
    t = turns(spark, d)
    good, no_requests, no_id = (_copilot_store(t.filter(f"conv_id % 3 = {i}"), *names) for i, names in enumerate(((), ("asked",), ("requests", "id"))))
    return _surprises(sqlite.copilot(spark, good.unionByName(no_requests).unionByName(no_id))[1])


def _cursor_stores(t: DataFrame, headers: str = "fullConversationHeadersOnly") -> tuple[DataFrame, DataFrame]:
    listed = F.to_json(F.struct(F.array(F.struct(F.first("session").alias("composerId"))).alias("allComposers")))
    path = F.concat(F.lit("/global/"), "session", F.lit("/state.vscdb"))
    composer = F.to_json(F.struct(_in_order(_obj(bubbleId=F.col("turn").cast("string"))).alias(headers), F.struct(F.lit("m2").alias("modelName")).alias("modelConfig"), F.lit("agent").alias("unifiedMode")))
    one = t.groupBy("session").agg(composer.alias("value"))
    kind = F.when(F.col("role") == "user", 1).when(F.col("role") == "assistant", 2)
    bubble = F.to_json(_obj(type=kind, text=F.col("text"), createdAt=F.col("at")))
    insert = "INSERT INTO cursorDiskKV VALUES (?, ?)"
    made = one.select(*_statement(path, F.lit(0), "CREATE TABLE cursorDiskKV (key TEXT, value TEXT)"))
    composers = one.select(*_statement(path, F.lit(1), insert, F.concat(F.lit("composerData:"), "session"), F.col("value")))
    bubbles = t.select(*_statement(path, F.col("turn") + 2, insert, F.concat_ws(":", F.lit("bubbleId"), "session", F.col("turn").cast("string")), bubble))
    return _items(t, "/ws", "composer.composerData", listed), _databases(made.unionByName(composers).unionByName(bubbles))


def source_cursor(spark, d):
    return _shown(sqlite.cursor(spark, *_cursor_stores(turns(spark, d)))[0])


def drift_cursor(spark, d):
    t = turns(spark, d)
    good, odd = _cursor_stores(t.filter("conv_id % 2 = 0")), _cursor_stores(t.filter("conv_id % 2 = 1"), "headers")
    lost = t.filter("conv_id % 10 = 4")
    listed = good[0].unionByName(odd[0])
    stored = good[1].unionByName(odd[1]).join(lost.select(F.concat(F.lit("/global/"), "session", F.lit("/state.vscdb")).alias("path")).distinct(), "path", "left_anti")
    return _surprises(sqlite.cursor(spark, listed, stored)[1])


def _opencode_store(t: DataFrame, role: str = "role") -> DataFrame:
    path = F.concat(F.lit("/oc/"), "session", F.lit(".db"))
    first, ms = t.filter("turn = 0"), (START + F.col("conv_id") * 3600 + F.col("turn") * 60) * 1000
    tables = ("CREATE TABLE session (id TEXT, directory TEXT)", "CREATE TABLE message (id TEXT, session_id TEXT, time_created INT, data TEXT)", "CREATE TABLE part (id TEXT, message_id TEXT, time_created INT, data TEXT)")
    message = F.to_json(F.struct(F.col("role").alias(role), F.lit("m3").alias("modelID")))
    key = F.concat_ws("-", "session", F.col("turn").cast("string"))
    part = lambda n, kind, text: t.select(*_statement(path, F.lit(10), "INSERT INTO part VALUES (?, ?, ?, ?)", F.concat(key, F.lit(f"-{n}")), key, F.lit(9 - n), F.to_json(_obj(type=F.lit(kind), text=text))))
    rows = [first.select(*_statement(path, F.lit(i), sql)) for i, sql in enumerate(tables)]
    rows += [first.select(*_statement(path, F.lit(8), "INSERT INTO session VALUES (?, ?)", F.col("session"), F.when(F.col("conv_id") % 5 != 4, F.col("cwd"))))]
    rows += [t.select(*_statement(path, F.lit(9), "INSERT INTO message VALUES (?, ?, ?, ?)", key, F.col("session"), ms, message))]
    rows += [part(1, "text", F.lit("tail")), part(2, "reasoning", F.lit("no")), part(3, "text", F.col("text"))]
    whole = rows[0]
    for more in rows[1:]:
        whole = whole.unionByName(more)
    return _databases(whole)


def source_opencode(spark, d):
    return _shown(sqlite.opencode(spark, _opencode_store(turns(spark, d)), ROOT)[0])


def drift_opencode(spark, d):
    t = turns(spark, d)
    both = _opencode_store(t.filter("conv_id % 2 = 0")).unionByName(_opencode_store(t.filter("conv_id % 2 = 1"), "rolle"))
    return _surprises(sqlite.opencode(spark, both, ROOT)[1])


def source_artifacts(spark, d):
    t = turns(spark, d)
    path = F.concat(F.lit("/brain/"), "session", F.lit("/note-"), F.col("turn").cast("string"), F.lit(".md"))
    body = t.select(path.alias("path"), F.current_timestamp().alias("modificationTime"), F.col("text").cast("binary").alias("content"))
    side = F.to_json(_obj(artifactType=F.lit("NOTE"), summary=F.col("role"), updatedAt=F.col("at")))
    sides = t.select(F.concat(path, F.lit(".metadata.json")).alias("path"), F.current_timestamp().alias("modificationTime"), side.cast("binary").alias("content"))
    return _shown(artifacts.artifacts(spark, body.unionByName(sides)))


def source_steps(spark, d):
    t = turns(spark, d)
    kind = lambda name, **fields: F.to_json(_obj(type=F.lit(f"{artifacts.STEP}{name}"), metadata=_obj(createdAt=F.col("at"), generatorModel=F.lit("g")), **fields))
    run = _obj(commandLine=F.lit("ls"), cwd=F.lit("/d"), exitCode=F.lit(0), combinedOutput=_obj(full=F.col("text")))
    diff = F.array(_obj(type=F.lit("UNIFIED_DIFF_LINE_TYPE_INSERT"), text=F.col("text")), _obj(type=F.lit("UNIFIED_DIFF_LINE_TYPE_DELETE"), text=F.lit("old")))
    edit = _obj(actionResult=_obj(edit=_obj(absoluteUri=F.lit("file:///work/app/a.py"), diff=_obj(unifiedDiff=_obj(lines=diff)))))
    shapes = [
        kind("USER_INPUT", userInput=_obj(userResponse=F.col("text"))), kind("PLANNER_RESPONSE", plannerResponse=_obj(response=F.col("text"))), kind("RUN_COMMAND", runCommand=run), kind("CODE_ACTION", codeAction=edit),
        kind("FIND", find=_obj(query=F.col("text"))), kind("LIST_DIRECTORY", listDirectory=_obj(path=F.lit("/d"))), kind("UNKNOWN_STEP"), kind("SEARCH_WEB", searchWeb=_obj(query=F.lit("q"), summary=F.col("text"))),
    ]
    step = F.element_at(F.array(*shapes), (F.col("turn") % len(shapes) + 1).cast("int"))
    rows = t.select(F.col("session").alias("session_id"), step.alias("step"), F.array(F.concat(F.lit("file://"), "cwd")).alias("workspaces"))
    return _shown(artifacts.steps(rows, ROOT))


QUERIES = {n: f for n, f in list(globals().items()) if n.startswith(("source_", "drift_"))}

_TURNS = """t AS (SELECT *, 'conv-' || conv_id AS session, strftime(to_timestamp(1704067200 + conv_id * 3600 + turn * 60) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S.%gZ') AS stamp,
  conv_id % 3 <> 2 AS mine, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations)"""


def _source_sql(tool: str, content: str, where: str = "mine", branch: str = "NULL", model: str = "NULL", index: str = "i", role: str = "role", at: str = "stamp", more: str = "t") -> str:
    return f"WITH {_TURNS} SELECT '{tool}' AS tool, session AS session_id, {at} AS at, {role} AS role, ({index})::INT AS message_index, md5({content}) AS content_md5, {branch}::VARCHAR AS git_branch, {model}::VARCHAR AS model FROM {more} WHERE {where}"


def _drift_sql(tool: str, rows: str) -> str:
    return f"WITH {_TURNS} SELECT '{tool}' AS tool, surprise, count(*) AS n, sum(lost)::BIGINT AS lost FROM ({rows}) GROUP BY surprise"


_STEP = "(turn % 8)"
_STEP_CONTENT = f"""CASE {_STEP} WHEN 2 THEN '[Command] ls' || chr(10) || 'cwd: /d' || chr(10) || 'exit_code: 0' || chr(10) || 'Output:' || chr(10) || text
  WHEN 3 THEN '[Code Edit] file:///work/app/a.py' || chr(10) || 'Diff:' || chr(10) || '+' || text || chr(10) || '-old' WHEN 5 THEN '/d' WHEN 7 THEN 'q' || chr(10) || text ELSE text END"""
ORACLE_SQL = {
    "source_claude_code": _source_sql("claude-code", "text", branch="CASE WHEN conv_id % 2 = 0 THEN 'main' END"),
    "source_codex": _source_sql("codex", "CASE role WHEN 'user' THEN text ELSE trim(text) END", branch="'main'"),
    "source_copilot_cli": _source_sql("copilot-cli", "trim(text)", branch="'dev'"),
    "source_copilot": _source_sql(
        "copilot", "CASE side WHEN 0 THEN trim(text) ELSE trim('re: ' || text) END", "turn % 4 <> 3", model="'m1'", index="row_number() OVER (PARTITION BY conv_id ORDER BY turn, side) - 1",
        role="CASE side WHEN 0 THEN 'user' ELSE 'assistant' END", at="strftime(to_timestamp(1704067200 + conv_id * 3600) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S.%gZ')", more="t, (VALUES (0), (1)) s(side)",
    ),
    "source_cursor": _source_sql("cursor", "trim(text)", "true", model="'m2'"),
    "source_opencode": _source_sql("opencode", "trim(text) || chr(10) || 'tail'", "mine AND conv_id % 5 <> 4", model="'m3'"),
    "source_artifacts": _source_sql("antigravity", "'Antigravity artifact: note-' || turn || '.md' || chr(10) || 'Source: /brain/' || session || '/note-' || turn || '.md' || chr(10) || 'Type: NOTE' || chr(10) || 'Summary: ' || role || chr(10) || chr(10) || trim(text)", "true", role="'assistant'"),
    "source_steps": _source_sql("antigravity", _STEP_CONTENT, f"{_STEP} <> 6 AND (mine OR conv_id IN (SELECT conv_id FROM t WHERE turn % 8 = 3))", model=f"CASE {_STEP} WHEN 1 THEN 'g' END", index="row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1", role=f"CASE {_STEP} WHEN 0 THEN 'user' WHEN 1 THEN 'assistant' ELSE 'tool' END"),
    "drift_claude_code": _drift_sql("claude-code", """SELECT 'no field type' AS surprise, 0 AS lost FROM t WHERE turn = 1 UNION ALL SELECT 'content is of kind number', 0 FROM t WHERE turn = 2
  UNION ALL SELECT 'timestamp is of kind number', 0 FROM t WHERE turn = 2 UNION ALL SELECT 'unreadable JSON', 1 FROM t WHERE turn = 3
  UNION ALL SELECT 'x' , 0 FROM t WHERE false"""),
    "drift_codex": _drift_sql("codex", """SELECT 'event_msg: payload is of kind number' AS surprise, 1 AS lost FROM t WHERE turn = 1 UNION ALL SELECT 'event_msg: no field payload.type', 1 FROM t WHERE turn = 2
  UNION ALL SELECT 'unlisted event: surprise', 1 FROM t WHERE turn = 3 UNION ALL SELECT 'unreadable JSON', 1 FROM t WHERE turn = 4"""),
    "drift_copilot_cli": _drift_sql("copilot-cli", """SELECT 'content without a role' AS surprise, 1 AS lost FROM t WHERE turn = 1 UNION ALL SELECT 'content is of kind number', 1 FROM t WHERE turn = 2
  UNION ALL SELECT 'line is of kind number', 1 FROM t WHERE turn = 3 UNION ALL SELECT 'unreadable JSON', 1 FROM t WHERE turn = 4"""),
    "drift_copilot": _drift_sql("copilot", """SELECT DISTINCT ON (conv_id) 'no field requests, another field holds an array' AS surprise, 1 AS lost FROM t WHERE conv_id % 3 = 1
  UNION ALL SELECT DISTINCT ON (conv_id) 'no field sessionId', 1 FROM t WHERE conv_id % 3 = 2"""),
    "drift_cursor": _drift_sql("cursor", """SELECT DISTINCT ON (conv_id) 'no field fullConversationHeadersOnly, another field holds an array' AS surprise, 1 AS lost FROM t WHERE conv_id % 2 = 1
  UNION ALL SELECT DISTINCT ON (conv_id) 'listed conversation is not stored', 1 FROM t WHERE conv_id % 10 = 4"""),
    "drift_opencode": _drift_sql("opencode", """SELECT 'message: no field role' AS surprise, 1 AS lost FROM t WHERE conv_id % 2 = 1 AND mine AND conv_id % 5 <> 4
  UNION ALL SELECT DISTINCT ON (conv_id) 'session without a directory, project unknown', 1 FROM t WHERE conv_id % 5 = 4"""),
}
