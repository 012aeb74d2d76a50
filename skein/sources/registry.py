"""Catalogue of the seven tools with their readers, and a registry of sources; a user adds one by ``register``."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.text import global_storage_path
from skein.sources import artifacts, jsonl, sqlite

#: Reads a source from a time on (None: everything).
Read = Callable[[SparkSession, "Source", datetime | None], tuple[DataFrame, DataFrame | None]]
#: How much older than the cursor a file's last change may be for it to be read again.
SLACK = timedelta(days=1)


@dataclass(frozen=True)
class Source:
    """A tool's store: where it is, whether it is read, and how. ``read`` gives (chunks, drift).

    Options: ``project_root`` scopes to a project, ``steps`` is a folder of pre-fetched antigravity steps.
    """

    tool: str
    label: str
    path: str
    read: Read | None = None
    enabled: bool = True
    options: dict = field(default_factory=dict)


# Labels and default stores below the home folder.
CATALOGUE = {
    "claude-code": ("Claude Code", ".claude/projects"),
    "codex": ("Codex", ".codex/sessions"),
    "cursor": ("Cursor", ".config/Cursor/User/workspaceStorage"),
    "copilot": ("GitHub Copilot", ".config/Code/User/workspaceStorage"),
    "copilot-cli": ("Copilot CLI", ".copilot/session-state"),
    "opencode": ("OpenCode", ".local/share/opencode/opencode.db"),
    "antigravity": ("Antigravity", ".gemini/antigravity/brain"),
}


class Registry:
    """Sources by tool; the last one registered for a tool stands."""

    def __init__(self) -> None:
        self._by_tool: dict[str, Source] = {}

    def register(self, source: Source) -> None:
        self._by_tool[source.tool] = source

    def deregister(self, tool: str) -> None:
        self._by_tool.pop(tool, None)

    def get(self, tool: str) -> Source | None:
        return self._by_tool.get(tool)

    def all(self) -> list[Source]:
        return list(self._by_tool.values())

    def available(self, spark: SparkSession) -> list[Source]:
        """Enabled sources whose store exists."""
        return [s for s in self.all() if s.enabled and exists(spark, s.path)]


def _since(at: datetime | None):
    return F.timestamp_seconds(F.lit(0)) if at is None else F.lit(at)


def _newer(at: datetime | None) -> str | None:
    return None if at is None else (at - SLACK).strftime("%Y-%m-%dT%H:%M:%S")


def read_claude_code(spark: SparkSession, source: Source, since: datetime | None = None):
    root = source.options.get("project_root")
    folders = jsonl.project_folders(spark, source.path, root) if root else [source.path]
    if not folders:
        return jsonl.claude_code(jsonl.no_lines(spark))
    lines = jsonl.read_lines(spark, folders, newer=_newer(since))
    if root:
        lines = jsonl.in_project_dirs(lines, root)
    chunks, drift = jsonl.claude_code(lines, root, F.col("exact") if root else None, _since(since))
    return chunks, drift.unionByName(jsonl.unread(spark, folders, "claude-code", newer=_newer(since)))


def read_codex(spark: SparkSession, source: Source, since: datetime | None = None):
    chunks, drift = jsonl.codex(jsonl.read_lines(spark, source.path, newer=_newer(since)), source.options.get("project_root"), _since(since))
    return chunks, drift.unionByName(jsonl.unread(spark, source.path, "codex", newer=_newer(since)))


def read_copilot_cli(spark: SparkSession, source: Source, since: datetime | None = None):
    chunks, drift = jsonl.copilot_cli(jsonl.read_lines(spark, source.path, newer=_newer(since)), source.options.get("project_root"), _since(since))
    return chunks, drift.unionByName(jsonl.unread(spark, source.path, "copilot-cli", newer=_newer(since)))


def read_copilot(spark: SparkSession, source: Source, since: datetime | None = None):
    """The cursor is not used: turns carry their session's time, and equal messages are stored once."""
    return sqlite.copilot(spark, source.path, sqlite.workspace_roots(spark, source.path), source.options.get("project_root"))


def read_cursor(spark: SparkSession, source: Source, since: datetime | None = None):
    return sqlite.cursor(spark, source.path, global_storage_path(source.path), sqlite.workspace_roots(spark, source.path), source.options.get("project_root"), _since(since))


def read_opencode(spark: SparkSession, source: Source, since: datetime | None = None):
    return sqlite.opencode(spark, source.path, source.options.get("project_root"), _since(since))


def read_antigravity(spark: SparkSession, source: Source, since: datetime | None = None):
    """Pre-fetched steps (Parquet of session_id, step and workspaces) where they give a chunk, else artifacts."""
    root, fetched = source.options.get("project_root"), source.options.get("steps")
    if fetched and exists(spark, fetched):
        rows = spark.read.parquet(fetched)
        wanted = rows if root is None else rows.join(artifacts.prune_trajectories(rows.select("session_id", "workspaces").distinct(), root).select("session_id").distinct(), "session_id", "left_semi")
        chunks = artifacts.steps(wanted, root, _since(since))
        if not artifacts.steps(wanted, root).isEmpty():
            return chunks, None
    return artifacts.artifacts(spark, source.path, root, _since(since)), None


READERS: dict[str, Read] = {
    "claude-code": read_claude_code,
    "codex": read_codex,
    "cursor": read_cursor,
    "copilot": read_copilot,
    "copilot-cli": read_copilot_cli,
    "opencode": read_opencode,
    "antigravity": read_antigravity,
}


def load_config(spark: SparkSession, path: str) -> dict:
    """A configuration file (YAML where a parser is installed, else JSON); anything that cannot be read counts as empty."""
    try:
        text = spark.read.text(path, wholetext=True).first().value
        try:
            import yaml

            config = yaml.safe_load(text)
        except ModuleNotFoundError:
            config = json.loads(text)
    except Exception:  # a broken configuration is none
        return {}
    return config if isinstance(config, dict) else {}


def configured(config: dict | None, home: str, readers: dict[str, Read] | None = None, **options: str) -> list[Source]:
    """The catalogue's sources as a nested configuration has them: ``tools: {tool: {enabled, storePath}}``.

    Anything that isn't of the expected type counts as not given.
    """
    tools = config.get("tools") if isinstance(config, dict) else None
    readers = READERS if readers is None else readers
    out = []
    for tool, (label, place) in CATALOGUE.items():
        own = tools.get(tool) if isinstance(tools, dict) else None
        own = own if isinstance(own, dict) else {}
        path = own.get("storePath")
        path = path.strip() if isinstance(path, str) and path.strip() else f"{home.rstrip('/')}/{place}"
        out.append(Source(tool, label, path, readers.get(tool), own.get("enabled") is not False, options))
    return out


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
