"""Codex files as a stream: the state of a file (project, session, branch, modes, index) folds over its lines from batch to batch.

``transformWithStateInPandas`` keeps it by file, a value state for what carries forward and one for the counters, in RocksDB; lines of a batch are put in order of their
place first. A stream of lines (``skein_lines``, or any with file, place and line) becomes chunks and drift by the expressions that batch reading uses: what a line alone says
is computed before the fold, what the folded state makes of it after. The state of a file (about 200 bytes) stays as long as the query's checkpoint: a transcript
can go on after any time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from skein.functions import variants as V
from skein.functions.text import trim_space
from skein.sources import jsonl

CARRIED = T.StructType([*(T.StructField(n, T.BooleanType()) for n in jsonl.CODEX_HELD), *(T.StructField(n, T.BooleanType() if n == "sandboxed" else T.StringType()) for n in jsonl.CODEX_LATEST)])
COUNTED = T.StructType([T.StructField("line_no", T.IntegerType()), T.StructField("message_index", T.LongType())])
FACTS = (*jsonl.CODEX_HELD, *jsonl.CODEX_LATEST, "takes")
FOLDED = T.StructType([T.StructField("file", T.StringType()), T.StructField("line_no", T.IntegerType()), T.StructField("line", T.StringType()), T.StructField("now_takes", T.BooleanType()), *CARRIED.fields, T.StructField("message_index", T.LongType())])


class CodexFold(StatefulProcessor):
    def __init__(self, everywhere: bool):
        self.everywhere = everywhere

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.carried = handle.getValueState("carried", CARRIED)
        self.counted = handle.getValueState("counted", COUNTED)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        lines = pd.concat(list(rows)).sort_values("place", kind="stable")  # of one file and one batch of the stream
        state = dict(zip(CARRIED.names, self.carried.get() if self.carried.exists() else (False, False, *[None] * len(jsonl.CODEX_LATEST)), strict=True))
        line_no, index = self.counted.get() if self.counted.exists() else (0, 0)
        out = []
        for row in lines.itertuples(index=False):
            for n in jsonl.CODEX_HELD:
                state[n] = bool(state[n] or _plain(getattr(row, f"now_{n}")))
            for n in jsonl.CODEX_LATEST:
                said = _plain(getattr(row, f"now_{n}"))
                state[n] = state[n] if said is None else said
            line_no += 1
            takes = bool(row.now_takes)
            out.append((key[0], line_no, row.line, takes, *state.values(), index))
            index += takes and not state["ended"] and (state["seen"] or self.everywhere)
        self.carried.update(tuple(state.values()))
        self.counted.update((line_no, int(index)))
        yield pd.DataFrame(out, columns=FOLDED.names)

    def close(self) -> None:
        pass


def _plain(x):
    return None if x is None or x is pd.NA or isinstance(x, float) and x != x else x


def fold_codex(lines: DataFrame, project_root: str | None = None) -> DataFrame:
    """A stream of lines (file, place, line) with line numbers and the folded state of their file. Needs the RocksDB state store."""
    parsed = lines.filter("line IS NOT NULL").select("file", "place", "line", V.parse(F.col("line")).alias("v"))
    facts = jsonl.codex_facts(parsed, project_root).select("file", "place", "line", *(f"now_{n}" for n in FACTS))
    return facts.groupBy("file").transformWithStateInPandas(CodexFold(project_root is None), FOLDED, "append", "none")


def codex_batch(folded: DataFrame, project_root: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(chunks, drift) of folded lines, as of a micro-batch; blank lines count, but say nothing."""
    real = folded.filter(F.length(trim_space(F.col("line"))) > 0).withColumn("v", V.parse(F.col("line")))
    return jsonl.codex_rows(real, project_root)
