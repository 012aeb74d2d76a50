"""Typed reads of schema-free JSON: a value of another type than asked for is absent, not converted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse(x: Column) -> Column:
    return F.try_parse_json(x)


def at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def kind(v: Column) -> Column:
    """null (absent or JSON null), string, number, boolean, array or object."""
    said = F.schema_of_variant(v)
    named = F.when(said == "STRING", "string").when(said == "BOOLEAN", "boolean").when(said.startswith("ARRAY"), "array").when(said.startswith("OBJECT"), "object").when(said == "VOID", "null").otherwise("number")
    return F.when(v.isNull(), "null").otherwise(named)


def text(v: Column, path: str) -> Column:
    """The string at ``path``, if it is one."""
    x = at(v, path)
    return F.when(kind(x) == "string", x.try_cast("string"))


def scalar_text(v: Column, path: str) -> Column:
    """String or number at ``path`` as text."""
    x = at(v, path)
    return F.when(kind(x).isin("string", "number"), x.try_cast("string"))


def has(v: Column, key: str) -> Column:
    """Whether an object has the key, be it null."""
    return at(v, f"$.{key}").isNotNull()


def items(v: Column, path: str) -> Column:
    """The array at ``path``; empty if it is none."""
    x = at(v, path)
    return F.when(kind(x) == "array", x.try_cast("array<variant>")).otherwise(F.array().cast("array<variant>"))


def joined_texts(v: Column, path: str, keys: tuple[str, ...] = ("text",), plain: bool = True, sep: str = "\n") -> Column:
    """Texts of an array's items (strings, or the first string among ``keys`` of objects), joined."""

    def one(x: Column) -> Column:
        inner = F.coalesce(*(text(x, f"$.{k}") for k in keys), F.lit(""))
        return F.when(kind(x) == "string", x.try_cast("string") if plain else F.lit("")).when(kind(x) == "object", inner).otherwise("")

    return F.array_join(F.filter(F.transform(items(v, path), one), lambda s: s != ""), sep)
