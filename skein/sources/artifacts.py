"""Sources of the tool antigravity: markdown artifacts, and pre-fetched trajectory steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.functions import variants as V
from skein.functions.text import decode_percent, referenced_files, search_text, to_timestamp, trim_space
from skein.schema import ROLES
from skein.sources.jsonl import metadata

TOOL = "antigravity"
# The head lines of an artifact's message, step types as the store names them, and the payload keys of path and plain tool steps.
HEAD = ("Antigravity artifact: ", "Source: ", "Type: ", "Summary: ")
STEP = "CORTEX_STEP_TYPE_"
PATH_STEPS = {"VIEW_FILE": ("view_file", "viewFile", ("absolutePathUri", "filePath", "path")), "LIST_DIRECTORY": ("list_dir", "listDirectory", ("directoryPath", "path"))}
PLAIN_STEPS = {"FIND": ("find", "find", ("query",)), "SEARCH_WEB": ("search_web", "searchWeb", ("query", "summary")), "READ_URL_CONTENT": ("read_url", "readUrlContent", ("url",))}


def mentions_project(x: Column, project_root: str) -> Column:
    """Path evidence: the root itself, or a playground folder of its name."""
    text, root = search_text(x), search_text(F.lit(project_root))
    name = F.regexp_extract(root, r"([^/]*)/?$", 1)
    play = F.concat(F.lit("/playground/"), name)
    return F.contains(text, root) | F.contains(text, F.concat(play, F.lit("/"))) | F.endswith(text, play)


def _finish(rows: DataFrame, since: Column | None, order: list) -> DataFrame:
    """Index by order within the session, after empty and foreign rows are gone; old rows go last. There is no epoch exception."""
    rows = rows.withColumn("message_index", F.row_number().over(Window.partitionBy("session_id").orderBy(*order)) - 1)
    rows = rows.filter(F.col("ts") > since) if since is not None else rows
    return rows.select(F.lit(TOOL).alias("tool"), "session_id", "ts", "role", "content", "message_index", "metadata")


def artifacts(spark: SparkSession, path: str | DataFrame, project_root: str | None = None, since: Column | None = None) -> DataFrame:
    """Chunks of ``<path>/<session>/*.md`` or ``.txt``; the time is the sidecar's, else the file's.

    A DataFrame of path, modificationTime and content stands for a folder.
    """
    files = path if isinstance(path, DataFrame) else spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.select(F.regexp_replace("path", "^file:/+", "/").alias("file"), "modificationTime", F.col("content").cast("string").alias("body"))
    name = F.regexp_extract("file", r"([^/]+)$", 1)
    body = files.filter(F.lower(name).rlike(r"\.(md|txt)$") & ~F.contains(name, F.lit(".resolved")) & (F.length(trim_space(F.col("body"))) > 0))
    side = files.filter(F.col("file").endswith(".metadata.json")).select(F.regexp_replace("file", r"\.metadata\.json$", "").alias("file"), V.parse(F.col("body")).alias("side"))
    rows = body.join(side, "file", "left").withColumns({"name": name, "session_id": F.regexp_extract("file", r"([^/]+)/[^/]+$", 1), "kind": V.text(F.col("side"), "$.artifactType"), "summary": V.text(F.col("side"), "$.summary")})
    stamp = V.scalar_text(F.col("side"), "$.updatedAt")
    parsed = to_timestamp(F.coalesce(stamp, F.lit("")))
    rows = rows.withColumns({"ts": F.when(parsed > F.timestamp_seconds(F.lit(0)), parsed).otherwise(F.col("modificationTime")), "refs": referenced_files(F.col("body"))})
    if project_root is not None:
        rows = rows.filter(mentions_project(F.concat_ws("\n", "file", "summary", "body", "refs"), project_root))
    header = F.concat_ws("\n", *(F.concat(F.lit(label), c) for label, c in zip(HEAD, ("name", "file", "kind", "summary"), strict=True)))
    rows = rows.withColumn("content", F.concat(header, F.lit("\n\n"), trim_space(F.col("body")))).withColumn("role", F.lit("assistant"))
    rows = rows.withColumn("metadata", metadata(artifact_type=F.col("kind"), artifact_name=F.col("name"), summary=F.col("summary"), source_path=F.col("file"), referenced_files=F.col("refs")))
    return _finish(rows, since, ["ts", "file"])


def conversation_ids(spark: SparkSession, path: str) -> DataFrame:
    """Distinct stems of the .pb and .db files below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    return files.select(F.regexp_extract("path", r"([^/]+)\.(?:pb|db)$", 1).alias("session_id")).filter("session_id <> ''").distinct()


def diff_text(v: Column, path: str) -> Column:
    """A diff as text: given as such, as unified lines, or any other object as JSON."""
    x = V.at(v, path)
    kind = V.kind(x)

    def line(y: Column) -> Column:
        mark = F.when(V.text(y, "$.type") == "UNIFIED_DIFF_LINE_TYPE_INSERT", "+").when(V.text(y, "$.type") == "UNIFIED_DIFF_LINE_TYPE_DELETE", "-").otherwise(" ")
        return F.concat(mark, F.coalesce(V.text(y, "$.text"), F.lit("")))

    lines = F.filter(V.items(x, "$.unifiedDiff.lines"), lambda y: V.kind(y) == "object")
    listed = V.kind(V.at(x, "$.unifiedDiff.lines")) == "array"
    unified = F.when(F.size(lines) > 0, F.array_join(F.transform(lines, line), "\n"))
    plain = x.try_cast("string")
    return F.when((kind == "string") & (F.length(trim_space(plain)) > 0), plain).when((kind == "object") & listed, unified).when(kind == "object", F.to_json(x))


def steps(rows: DataFrame, project_root: str | None = None, since: Column | None = None) -> DataFrame:
    """Chunks of pre-fetched steps: ``rows`` (session_id, step: JSON text, workspaces: array). Unknown step types are dropped."""
    s = F.col("s")
    t = lambda *keys: F.coalesce(*(F.when(F.length(V.text(s, f"$.{k}")) > 0, V.text(s, f"$.{k}")) for k in keys))
    labelled = lambda label, x: F.when(x.isNotNull(), F.concat(F.lit(label), x))
    step = F.regexp_replace(V.text(s, "$.type"), f"^{STEP}", "")
    active = t("userInput.activeUserState.activeDocument.absoluteUri")
    edited, command, cwd = t("codeAction.actionResult.edit.absoluteUri", "codeAction.actionSpec.createFile.path"), t("runCommand.commandLine", "runCommand.command"), t("runCommand.cwd")
    edit = F.concat_ws("\n", F.coalesce(labelled("[Code Edit] ", edited), F.lit("[Code Edit]")), t("codeAction.description"), t("codeAction.artifactMetadata.summary"), labelled("Diff:\n", diff_text(s, "$.codeAction.actionResult.edit.diff")))
    ran = F.when(command.isNotNull(), F.concat_ws("\n", F.concat(F.lit("[Command] "), command), labelled("cwd: ", cwd), labelled("exit_code: ", V.at(s, "$.runCommand.exitCode").try_cast("string")), labelled("Output:\n", t("runCommand.combinedOutput.full"))))
    choose = {"USER_INPUT": ("user", None, t("userInput.userResponse"), active), "PLANNER_RESPONSE": ("assistant", None, t("plannerResponse.modifiedResponse", "plannerResponse.response"), None), "CODE_ACTION": ("tool", "code_edit", edit, edited), "RUN_COMMAND": ("tool", "run_command", ran, cwd), "COMMAND_STATUS": ("tool", "command_status", F.lit("[Check Command Status]"), None)}
    for kind, (tool, key, fields) in PATH_STEPS.items():
        value = t(*(f"{key}.{f}" for f in fields))
        choose[kind] = ("tool", tool, value, value)
    for kind, (tool, key, fields) in PLAIN_STEPS.items():
        values = F.concat_ws("\n", *(t(f"{key}.{f}") for f in fields))
        choose[kind] = ("tool", tool, F.when(values != "", values), None)

    def pick(i: int) -> Column:
        out = F.lit(None).cast("string")
        for kind, row in choose.items():
            value = row[i]
            out = F.when(step == kind, F.lit(value) if value is None or isinstance(value, str) else value).otherwise(out)
        return out

    parsed = rows.withColumn("s", V.parse(F.col("step"))).withColumns({"role": pick(0), "tool_name": pick(1), "content": pick(2), "source_path": pick(3), "step_type": V.text(s, "$.type"), "model": F.when(step == "PLANNER_RESPONSE", t("metadata.generatorModel"))})
    parsed = parsed.filter(F.length(trim_space(F.col("content"))) > 0).withColumn("ts", to_timestamp(F.coalesce(V.scalar_text(s, "$.metadata.createdAt"), F.lit(""))))
    parsed = parsed.withColumn("role", F.when(F.col("role").isin(*ROLES), F.col("role")).otherwise("assistant"))
    refs = F.array_distinct(F.array_compact(F.concat(referenced_files(F.col("content")), F.array(F.when(step == "USER_INPUT", decode_percent(F.col("source_path")))))))
    parsed = parsed.withColumn("metadata", metadata(referenced_files=refs, tool_name=F.col("tool_name"), source_path=F.col("source_path"), event_type=F.col("step_type"), model=F.col("model")))
    if project_root is not None:
        own = mentions_project(F.concat_ws("\n", "workspaces", "content", "source_path", refs), project_root)
        parsed = parsed.withColumn("mine", F.max(own).over(Window.partitionBy("session_id"))).filter("mine")
    return _finish(parsed, since, ["ts", "content"])


def prune_trajectories(summaries: DataFrame, project_root: str) -> DataFrame:
    """Trajectories worth fetching: those that name the project or no workspace at all (session_id, workspaces)."""
    return summaries.filter((F.size("workspaces") <= 0) | F.exists("workspaces", lambda w: mentions_project(w, project_root)))
