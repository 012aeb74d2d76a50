"""Transcript sources kept in SQLite files: copilot, cursor and opencode.

A database file is read as binary by Spark, wherever it is stored, and queried in memory on the executor that holds
it; its rows then are an ordinary DataFrame. Files are dealt over the cluster; one file is one task's work, and a file of 2 GB or more,
which a binary value cannot hold, is left out and reported. A DataFrame of path and content stands for a folder everywhere.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.functions import variants as V
from skein.functions.text import path_in_project, to_timestamp, trim_space
from skein.sources.jsonl import COPILOT_ROLES, UNREADABLE, _emit, absent, drift_rows, lookup, metadata, odd_kind


def renamed(field: str) -> str:
    return f"{absent(field)}, another field holds an array"


#: Bytes from which a file is no binary value.
MOST_BYTES = 2**31 - 1


def database_files(spark: SparkSession, path: str | DataFrame, glob: str) -> DataFrame:
    """path and content of every database below ``path``; content is null where a file is too large."""
    if isinstance(path, DataFrame):
        return path.select("path", "content")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    small = files.filter(F.col("length") < MOST_BYTES).select("path", "content")
    return small.unionByName(files.filter(F.col("length") >= MOST_BYTES).select("path", F.lit(None).cast("binary").alias("content")))


def query_files(spark: SparkSession, path: str | DataFrame, sql: str, columns: str, glob: str = "*", fallback: str | None = None) -> DataFrame:
    """file and the result ``columns`` (all strings, in order of the query) of ``sql`` over every database below ``path``.

    A failing query is tried again as ``fallback``; a file that cannot be read gives one row with its ``error``.
    """
    names = columns.split()
    files = database_files(spark, path, glob)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch.path, batch.content, strict=True):
                rows, error = [], None
                db = sqlite3.connect(":memory:")
                try:
                    if content is None:
                        raise sqlite3.Error("file too large")
                    db.deserialize(content)
                    try:
                        rows = db.execute(sql).fetchall()
                    except sqlite3.Error:
                        if not fallback:
                            raise
                        rows = db.execute(fallback).fetchall()
                except sqlite3.Error as e:
                    error = str(e)
                finally:
                    db.close()
                text = lambda x: x.decode("utf-8", "replace") if isinstance(x, bytes) else None if x is None else str(x)
                out = [[file, *map(text, r), None] for r in rows] or ([[file, *[None] * len(names), error]] if error else [])
                yield pd.DataFrame(out, columns=["file", *names, "error"], dtype=object)

    return files.mapInPandas(run, ", ".join(f"{n} string" for n in ["file", *names, "error"]))


def _failed(rows: DataFrame, tool: str) -> DataFrame:
    return drift_rows(rows.withColumn("line_no", F.lit(0)), tool, (F.col("error").isNotNull(), F.concat(F.lit("query failed: "), F.col("error")), 0))


def copilot(spark: SparkSession, path: str | DataFrame, workspaces: DataFrame | None = None, project_root: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(chunks, drift). A map of sessions with their requests; every turn is emitted again on each run and deduplicated by id.

    ``workspaces`` (folder, root) names the project of a database's folder, from its workspace.json.
    """
    read = query_files(spark, path, "SELECT value FROM ItemTable WHERE key = 'interactive.sessions'", "value", "state.vscdb")
    read = _scoped(read, workspaces, project_root)
    v = read.filter("error IS NULL").withColumn("v", V.parse(F.col("value")))
    session = v.filter(V.kind(F.col("v")) == "object").select("file", F.explode(F.col("v").try_cast("map<string,variant>")).alias("key", "s"))
    s = F.col("s")
    created = V.at(s, "$.creationDate")
    session = session.withColumns({"session_id": V.text(s, "$.sessionId"), "ts": to_timestamp(F.coalesce(V.scalar_text(s, "$.creationDate"), F.lit("")))})
    turns = session.filter("session_id IS NOT NULL").select("file", "session_id", "ts", F.posexplode(V.items(s, "$.requests")).alias("pos", "r"))
    r = F.col("r")
    cancelled = F.coalesce(V.at(r, "$.isCanceled").try_cast("boolean"), F.lit(False))
    part = lambda path, key, sep: F.array_join(F.transform(V.items(r, path), lambda x: F.coalesce(V.text(x, f"$.{key}"), F.lit(""))), sep)
    said = F.array(F.struct(F.lit("user").alias("role"), trim_space(part("$.message.parts", "text", "\n")).alias("content")), F.struct(F.lit("assistant").alias("role"), trim_space(part("$.response", "value", "")).alias("content")))
    rows = turns.filter(~cancelled).select("file", "session_id", "ts", "pos", V.text(r, "$.model").alias("model"), F.when(V.at(r, "$.agentId").isNotNull(), "agent").otherwise("chat").alias("kind"), F.posexplode(said).alias("side", "m"))
    rows = rows.select("*", "m.role", "m.content").filter(F.length("content") > 0)
    index = F.row_number().over(Window.partitionBy("file", "session_id").orderBy("pos", "side")) - 1
    rows = rows.withColumn("message_index", index).withColumn("metadata", metadata(model=F.col("model"), completion_type=F.col("kind")))
    requests = V.at(s, "$.requests")
    other = F.exists(F.map_values(s.try_cast("map<string,variant>")), lambda x: V.kind(x) == "array")
    odd = drift_rows(
        session.withColumn("line_no", F.lit(0)), "copilot",
        (F.col("session_id").isNull(), absent("sessionId"), 1),
        (V.kind(created) != "number", odd_kind("creationDate", V.kind(created)), 0),
        (V.has(s, "requests") & (V.kind(requests) != "array"), odd_kind("requests", V.kind(requests)), 1),
        (~V.has(s, "requests") & other, renamed("requests"), 1),
    )
    bad = drift_rows(v.withColumn("line_no", F.lit(0)), "copilot", (F.col("v").isNull(), UNREADABLE, 1), (F.col("v").isNotNull() & (V.kind(F.col("v")) != "object"), odd_kind("value", V.kind(F.col("v"))), 1))
    return _emit(rows, "copilot", None), odd.unionByName(bad).unionByName(_failed(read, "copilot"))


def workspace_roots(spark: SparkSession, path: str) -> DataFrame:
    """folder and root from every workspace.json below ``path``."""
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "workspace.json")
    rows = reader.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), r"(.*)/[^/]+$", 1).alias("folder"), V.text(V.parse(F.col("value")), "$.folder").alias("root"))
    return rows.withColumn("folder", F.regexp_replace("folder", "^file:/+", "/"))


def _scoped(read: DataFrame, workspaces: DataFrame | None, project_root: str | None) -> DataFrame:
    if workspaces is None or project_root is None:
        return read
    inside = workspaces.filter(path_in_project(F.col("root"), F.lit(project_root))).select("folder")
    folder = F.regexp_replace(F.regexp_extract("file", r"(.*)/[^/]+$", 1), "^file:/+", "/")
    return read.withColumn("folder", folder).join(inside, "folder", "left_semi").drop("folder")


def cursor(spark: SparkSession, workspace_path: str | DataFrame, global_path: str | DataFrame, workspaces: DataFrame | None = None, project_root: str | None = None, since: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(chunks, drift). Workspaces list conversations; the global store holds them and their bubbles under built keys."""
    listed = _scoped(query_files(spark, workspace_path, "SELECT value FROM ItemTable WHERE key = 'composer.composerData'", "value", "state.vscdb"), workspaces, project_root)
    kv = query_files(spark, global_path, "SELECT key, value FROM cursorDiskKV WHERE key LIKE 'composerData:%' OR key LIKE 'bubbleId:%'", "key value", "state.vscdb")
    v = listed.filter("error IS NULL").withColumn("v", V.parse(F.col("value")))
    refs = v.select("file", F.explode(V.items(F.col("v"), "$.allComposers")).alias("c")).select("file", V.text(F.col("c"), "$.composerId").alias("id"), V.text(F.col("c"), "$.unifiedMode").alias("ref_mode"))
    refs = refs.filter("id IS NOT NULL").dropDuplicates(["id"])
    stored = kv.filter("error IS NULL").select("key", V.parse(F.col("value")).alias("c"))
    composers = stored.filter(F.col("key").startswith("composerData:")).select(F.substring_index("key", ":", -1).alias("id"), "c")
    found = refs.join(composers, "id", "left")
    c = F.col("c")
    headers = V.at(c, "$.fullConversationHeadersOnly")
    each = found.select("id", "ref_mode", V.text(c, "$.modelConfig.modelName").alias("model"), V.text(c, "$.unifiedMode").alias("mode"), F.posexplode(V.items(c, "$.fullConversationHeadersOnly")).alias("pos", "h"))
    each = each.withColumn("bubble", F.concat_ws(":", F.lit("bubbleId"), "id", V.text(F.col("h"), "$.bubbleId")))
    bubbles = stored.filter(F.col("key").startswith("bubbleId:")).select(F.col("key").alias("bubble"), F.col("c").alias("b"))
    b = F.col("b")
    rows = each.join(bubbles, "bubble").filter("b IS NOT NULL")
    number = F.when(V.kind(V.at(b, "$.type")) == "number", V.scalar_text(b, "$.type").try_cast("int"))
    role = F.coalesce(F.when(number == 1, "user").when(number == 2, "assistant"), lookup(COPILOT_ROLES, F.lower(V.text(b, "$.type"))), F.lit("system"))
    mode = F.when(F.coalesce(F.col("mode"), F.col("ref_mode")) == "agent", "agent").otherwise("normal")
    rows = rows.withColumns({
        "message_index": F.row_number().over(Window.partitionBy("id").orderBy("pos")) - 1,
        "session_id": F.col("id"),
        "ts": to_timestamp(F.coalesce(V.scalar_text(b, "$.createdAt"), F.lit(""))),
        "role": role,
        "content": trim_space(F.coalesce(V.text(b, "$.text"), F.lit(""))),
    })
    rows = rows.withColumn("metadata", metadata(model=F.coalesce(V.text(b, "$.modelInfo.modelName"), "model", "id"), composer_mode=mode))
    other = F.exists(F.map_values(c.try_cast("map<string,variant>")), lambda x: V.kind(x) == "array")
    at = found.withColumn("line_no", F.lit(0)).withColumn("file", F.concat_ws("#", "file", "id"))
    odd = drift_rows(
        at, "cursor",
        (c.isNull(), "listed conversation is not stored", 1),
        (V.has(c, "fullConversationHeadersOnly") & (V.kind(headers) != "array"), odd_kind("fullConversationHeadersOnly", V.kind(headers)), 1),
        (c.isNotNull() & ~V.has(c, "fullConversationHeadersOnly") & other, renamed("fullConversationHeadersOnly"), 1),
        (V.has(c, "modelConfig") & (V.kind(V.at(c, "$.modelConfig")) != "object"), odd_kind("modelConfig", V.kind(V.at(c, "$.modelConfig"))), 0),
    )
    bad = drift_rows(v.withColumn("line_no", F.lit(0)), "cursor", (F.col("v").isNull(), UNREADABLE, 1), (F.col("v").isNotNull() & (V.kind(V.at(F.col("v"), "$.allComposers")) != "array"), odd_kind("allComposers", F.coalesce(V.kind(V.at(F.col("v"), "$.allComposers")), F.lit("none"))), 1))
    return _emit(rows, "cursor", since), odd.unionByName(bad).unionByName(_failed(listed, "cursor")).unionByName(_failed(kv, "cursor"))


def opencode(spark: SparkSession, path: str | DataFrame, project_root: str | None = None, since: Column | None = None, glob: str = "*.db") -> tuple[DataFrame, DataFrame]:
    """(chunks, drift). Sessions with their messages and parts; text parts join in order of (time_created, id)."""
    sessions = query_files(spark, path, "SELECT id, directory FROM session", "id directory", glob, fallback="SELECT id, NULL FROM session")
    messages = query_files(spark, path, "SELECT id, session_id, time_created, data FROM message", "id session_id time_created data", glob)
    parts = query_files(spark, path, "SELECT id, message_id, time_created, data FROM part", "id message_id time_created data", glob)
    known = sessions.filter("error IS NULL")
    if project_root is not None:
        known = known.filter(F.coalesce(path_in_project(F.col("directory"), F.lit(project_root)), F.lit(False)))
    m = messages.filter("error IS NULL").withColumn("v", V.parse(F.col("data"))).join(known.select("file", F.col("id").alias("session_id")), ["file", "session_id"])
    v = F.col("v")
    usable = (V.kind(v) == "object") & V.text(v, "$.role").isNotNull()
    p = parts.filter("error IS NULL").withColumn("p", V.parse(F.col("data")))
    text = V.text(F.col("p"), "$.text")
    texts = p.filter((V.text(F.col("p"), "$.type") == "text") & (F.length(text) > 0)).select("file", "message_id", F.struct(F.col("time_created").try_cast("double").alias("t"), F.col("id"), text.alias("text")).alias("x"))
    texts = texts.groupBy("file", "message_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["text"]), "\n").alias("body"))
    rows = m.filter(usable).join(texts.withColumnRenamed("message_id", "id"), ["file", "id"], "left")
    order = Window.partitionBy("file", "session_id").orderBy(F.col("time_created").try_cast("double"), "id")
    rows = rows.withColumns({
        "message_index": F.row_number().over(order) - 1,
        "ts": to_timestamp(F.coalesce(V.scalar_text(v, "$.time.created"), "time_created", F.lit(""))),
        "role": F.coalesce(lookup(COPILOT_ROLES, F.lower(V.text(v, "$.role"))), F.lit("system")),
        "content": trim_space(F.coalesce("body", F.lit(""))),
    })
    either = lambda a, b: F.coalesce(V.text(v, a), V.text(v, b))
    rows = rows.withColumn("metadata", metadata(agent=V.text(v, "$.agent"), model=either("$.modelID", "$.model.modelID"), provider_id=either("$.providerID", "$.model.providerID")))
    place = lambda df, name: df.withColumn("line_no", F.lit(0)).withColumn("file", F.concat_ws("#", "file", F.concat(F.lit(f"{name}:"), F.col("id"))))
    role_kind = V.kind(V.at(v, "$.role"))
    odd = drift_rows(
        place(m, "message"), "opencode",
        (v.isNull(), f"message: {UNREADABLE}", 1),
        (v.isNotNull() & (V.kind(v) != "object"), odd_kind("message", V.kind(v)), 1),
        ((V.kind(v) == "object") & ~V.has(v, "role"), f"message: {absent('role')}", 1),
        (V.has(v, "role") & (role_kind != "string"), odd_kind("role", role_kind), 1),
    )
    broken = drift_rows(place(p, "part"), "opencode", (F.col("p").isNull(), f"part: {UNREADABLE}", 1), (F.col("p").isNotNull() & (V.kind(F.col("p")) != "object"), odd_kind("part", V.kind(F.col("p"))), 1))
    drift = odd.unionByName(broken)
    if project_root is not None:
        drift = drift.unionByName(drift_rows(place(sessions.filter("error IS NULL AND directory IS NULL"), "session"), "opencode", (F.lit(True), "session without a directory, project unknown", 1)))
    for df in (sessions, messages, parts):
        drift = drift.unionByName(_failed(df, "opencode"))
    return _emit(rows, "opencode", since), drift
