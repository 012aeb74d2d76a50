"""Row types of the message model and its fixed names."""

from __future__ import annotations

from pyspark.sql import types as T

# Tool ids in catalogue order, roles, search modes, table schema version.
TOOLS = ("claude-code", "codex", "cursor", "copilot", "copilot-cli", "opencode", "antigravity")
ROLES = ("user", "assistant", "system", "tool")
MODES = ("hybrid", "keyword", "vector")
SCHEMA_VERSION = 2

_s, _i, _b, _d, _t = T.StringType(), T.IntegerType(), T.BooleanType(), T.DoubleType(), T.TimestampType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


#: Union of what the sources say about a message; absent values are null.
METADATA = _struct(
    token_estimate=_i, referenced_files=T.ArrayType(_s), layer=_i, git_branch=_s, git_commit=_s, model=_s, completion_type=_s, approval_mode=_s, sandboxed=_b,
    composer_mode=_s, agent=_s, provider_id=_s, event_type=_s, artifact_type=_s, artifact_name=_s, summary=_s, source_path=_s, tool_name=_s,
    tool_calls=T.ArrayType(_s), cost_usd=_d, session_type=_s,
)
CHUNK = _struct(tool=_s, session_id=_s, ts=_t, role=_s, content=_s, message_index=_i, metadata=METADATA)
SESSION = _struct(session_ref=_s, tool=_s, source_session_id=_s, project_root=_s, git_branch=_s, git_commit=_s, started_at=_t, last_activity_at=_t, message_count=T.LongType(), preview=_s, source_path=_s, updated_at=_t)
DRIFT = _struct(tool=_s, surprise=_s, location=_s, seq=T.LongType(), records=T.LongType())
CURSOR = _struct(tool=_s, last_timestamp=_t)
SETTING = _struct(key=_s, value=_s)
UNIT_VECTOR = _struct(unit_id=_s, model=_s, dimensions=_i, content_hash=_s, vector=T.ArrayType(T.FloatType()), created_at=_t)
