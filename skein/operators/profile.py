"""Profiling of semi-structured data: shape fingerprints, their differences, canary checks."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Levels of objects below the first, elements that an array shows, and the keys that are names and not data.
DEPTH, ELEMENTS = 4, 20
NAME = re.compile(r"[A-Za-z0-9_$.:@-]{1,64}")
IDENT = re.compile(r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}|[0-9a-f]{16,}", re.I)
_TYPES = {type(None): "null", bool: "boolean", int: "number", float: "number", str: "string", dict: "object"}


def type_name(x: object) -> str:
    """The type of a JSON value; an array says which types its first elements have, arrays among them in turn."""
    if not isinstance(x, list):
        return _TYPES[type(x)]
    return f"array<{'|'.join(sorted({type_name(v) for v in x[:ELEMENTS]})) or 'empty'}>"


def shape_lines(text: str | None) -> Iterator[str]:
    """``path: type`` of every leaf of one JSON text. Keys that are data (ids, paths, long names) become a star; an empty object has no leaf."""
    try:
        value = json.loads(text or "")
    except ValueError:
        yield "$: invalid"
        return
    open_, level = [("", value)], 0
    while open_:
        inner = []
        for path, x in open_:
            if isinstance(x, dict) and level <= DEPTH:
                inner += [(".".join(filter(None, (path, k if NAME.fullmatch(k) and not IDENT.fullmatch(k) else "*"))), v) for k, v in x.items()]
            elif path:
                yield f"{path}: {type_name(x)}"
        open_, level = inner, level + 1


def fingerprint(records: DataFrame) -> DataFrame:
    """record_type and its sorted distinct shapes, of ``records`` (record_type, json).

    The recursive walk runs by Arrow batches and leaves distinct lines of its batch, so that few rows are shuffled.
    """
    def run(batches):
        for b in batches:
            lines = {(k, s) for k, j in zip(b.record_type, b.json, strict=True) for s in shape_lines(j)}
            yield pd.DataFrame(sorted(lines, key=str), columns=["record_type", "shape"])

    rows = records.mapInPandas(run, "record_type string, shape string").distinct()
    return rows.groupBy("record_type").agg(F.array_join(F.array_sort(F.collect_set("shape")), "\n").alias("shapes"))


def added_lines(before: DataFrame, after: DataFrame, most: int = 12) -> DataFrame:
    """Shapes that only ``after`` has, at most ``most`` for each record type."""
    lines = lambda df: df.select("record_type", F.explode(F.split("shapes", "\n")).alias("shape"))
    new = lines(after).join(lines(before), ["record_type", "shape"], "left_anti")
    n = F.row_number().over(Window.partitionBy("record_type").orderBy("shape"))
    return new.withColumn("n", n).filter(F.col("n") <= most).drop("n")


# Columns that count what was sampled, and names of files that SQLite keeps beside an open database.
COUNTERS = ("filesSampled", "recordsSampled")
SIDECAR = r"\.[A-Za-z0-9]+-(wal|shm|journal)$"


def lasting(files: DataFrame, name: str = "path") -> DataFrame:
    """Files without those that exist only while a database is open."""
    return files.filter(~F.col(name).rlike(SIDECAR))


def without_counters(value: object) -> object:
    """A JSON value without the counters, at any depth."""
    if isinstance(value, dict):
        return {k: without_counters(v) for k, v in value.items() if k not in COUNTERS}
    return [without_counters(v) for v in value] if isinstance(value, list) else value


def comparable_json(text: Column) -> Column:
    """Whole fingerprints as JSON, without counters and in one form: what two of them are compared by. Null where it is no JSON."""

    @F.pandas_udf("string")
    def plain(texts: pd.Series) -> pd.Series:
        def one(x: str | None) -> str | None:
            try:
                return json.dumps(without_counters(json.loads(x)), indent=2) + "\n"
            except (TypeError, ValueError):
                return None

        return texts.map(one)

    return plain(text)


def comparable(fingerprints: DataFrame) -> DataFrame:
    """Fingerprints without counts of what was sampled, and with plain line ends: what two of them are compared by."""
    kept = fingerprints.select(*(c for c in fingerprints.columns if c not in COUNTERS))
    return kept.withColumn("shapes", F.regexp_replace("shapes", "\r\n", "\n"))


def differing(before: DataFrame, after: DataFrame) -> DataFrame:
    """record_type of the fingerprints that are not the same, or that only one side has."""
    old, new = (comparable(df).select("record_type", F.col("shapes").alias(n)) for df, n in ((before, "old"), (after, "new")))
    return old.join(new, "record_type", "full").filter(~F.col("old").eqNullSafe(F.col("new"))).select("record_type")


def newest_sample(files: DataFrame, records: DataFrame, n_files: int = 30, n_records: int = 400) -> DataFrame:
    """The first records of the newest files: ``files`` (path, modified), ``records`` (path, line_no, value)."""
    chosen = files.orderBy(F.desc("modified"), "path").limit(n_files)
    n = F.row_number().over(Window.partitionBy("path").orderBy("line_no"))
    return records.join(F.broadcast(chosen.select("path")), "path", "left_semi").withColumn("n", n).filter(F.col("n") <= n_records).drop("n")


def canary(chunks: DataFrame, now: Column) -> DataFrame:
    """Per tool: rows of users and assistants, rows of the last ten minutes, and whether all three exist."""
    recent = F.count_if((F.col("ts") <= now) & (now - F.col("ts") <= F.expr("INTERVAL 10 MINUTES")))
    rows = chunks.groupBy("tool").agg(F.count_if(F.col("role") == "user").alias("users"), F.count_if(F.col("role") == "assistant").alias("assistants"), recent.alias("recent"))
    return rows.withColumn("passed", (F.col("users") > 0) & (F.col("assistants") > 0) & (F.col("recent") > 0))
