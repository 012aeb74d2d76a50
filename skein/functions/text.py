"""Text, time, path and hash functions. Lengths count code points."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as scripts understand it: Unicode white space and the byte order mark.
SPACE = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"

# Limits of previews, messages, echoed queries and embedding segments.
PREVIEW_CHARS, MESSAGE_CHARS, ECHO_CHARS, SEGMENT_CHARS = 240, 16_000, 200, 1024


def _foldings() -> tuple[str, str, str]:
    """(letters, what they fold to, marks that are dropped) as the document tokeniser has them, from the Unicode tables.

    A letter folds to its case-folded form, and further to an ASCII letter where it is one with a single mark; the marks of such letters are dropped wherever
    they stand. Letters with two marks keep them. Lower case is taken before, so that only forms that it leaves need an entry.
    """
    letters, plain, marks = [], [], set()
    for c in range(0x80, 0x10000):
        ch = chr(c)
        if not ch.isalpha() or ch.lower() != ch:
            continue
        form = ch.casefold() if len(ch.casefold()) == 1 and ch.casefold().islower() else ch
        parts = unicodedata.decomposition(form).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            base, mark = (chr(int(x, 16)) for x in parts)
            if base.isascii() and base.isalpha() and unicodedata.combining(mark):
                form = base
                marks.add(mark)
        if form != ch:
            letters.append(ch)
            plain.append(form)
    return "".join(letters), "".join(plain), "".join(sorted(marks))


_LETTERS, _PLAIN, _MARKS = _foldings()


def trim_space(x: Column) -> Column:
    return F.regexp_replace(x, f"^{SPACE}+|{SPACE}+$", "")


def inline_safe(x: Column) -> Column:
    """One line: white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(x, f"{SPACE}+", " "))


def preview_text(x: Column) -> Column:
    return F.substring(inline_safe(x), 1, PREVIEW_CHARS)


def truncate_content(x: Column, most: int = MESSAGE_CHARS) -> Column:
    marked = F.concat(F.substring(x, 1, most), F.lit("\n…[truncated "), (F.length(x) - most).cast("string"), F.lit(" chars]"))
    return F.when(F.length(x) <= most, x).otherwise(marked)


def truncate_echo(x: Column, most: int = ECHO_CHARS) -> Column:
    return F.when(F.length(x) <= most, x).otherwise(F.concat(F.substring(x, 1, most), F.lit("…")))


def fence_for(x: Column) -> Column:
    """Tildes that no line of tildes in ``x`` can close."""
    runs = F.regexp_extract_all(x, F.lit(r"(?m)^(~{3,})\s*$"), F.lit(1))
    longest = F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(2))
    return F.repeat(F.lit("~"), (longest + 1).cast("int"))


def round_score(x: Column) -> Column:
    """Three places, halves upwards."""
    return F.floor(x * 1000 + 0.5) / 1000


def hash_parts(*parts: Column) -> Column:
    """SHA-256 of the parts, each followed by a NUL."""
    return F.sha2(F.concat(*(p for part in parts for p in (part.cast("string"), F.lit("\x00")))), 256)


def iso_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def to_timestamp(x: Column) -> Column:
    """From the text of a number (seconds, or milliseconds above 1e10) or of a date; else the epoch."""
    number = x.try_cast("double")
    millis = F.when(number > 1e10, number).otherwise(number * 1000)
    return F.coalesce(F.timestamp_millis(millis.try_cast("long")), x.try_cast("timestamp"), F.timestamp_seconds(F.lit(0)))


def record_timestamp(x: Column) -> Column:
    return F.coalesce(x.try_cast("timestamp"), F.timestamp_seconds(F.lit(0)))


def estimate_tokens(x: Column) -> Column:
    symbols = F.regexp_count(x, F.lit(r"[{}\[\]();=+\-*&|<>!]"))
    return F.coalesce(F.ceil(F.length(x) / 4) + F.ceil(symbols / 2), F.lit(0)).cast("int")


def decode_percent(x: Column) -> Column:
    """Percent escapes decoded; the text itself where an escape is broken. A plus sign stays."""
    return F.coalesce(F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))), x)


def normalize_path(x: Column) -> Column:
    path = trim_space(x)
    path = decode_percent(F.regexp_replace(path, r"(?i)^file:(?://(?:localhost(?=/))?)?(?=/|[A-Za-z]:)", ""))
    path = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^/([a-zA-Z]:/)", "$1")
    return F.lower(F.regexp_replace(F.regexp_replace(path, "/+", "/"), "/$", ""))


def path_in_project(path: Column, root: Column) -> Column:
    a, b = normalize_path(path), normalize_path(root)
    return (a == b) | F.startswith(a, F.concat(b, F.lit("/")))


def encode_path(x: Column) -> Column:
    """The folder name that stands for a project root."""
    return F.regexp_replace(F.regexp_replace(x, r"[:\\/]", "-"), "-+$", "")


def search_text(x: Column) -> Column:
    """Decoded, with plain slashes, in lower case: for finding a root inside text."""
    return F.lower(F.regexp_replace(F.replace(decode_percent(x), F.lit("\\"), F.lit("/")), "/+", "/"))


#: Absolute Windows and POSIX paths; what stands before a POSIX path is kept.
_WINDOWS_PATH, _POSIX_PATH = r"[A-Za-z]:[\\/][^\s'\"`]+", r"(^|[\s'\"`(])/[^\s'\"`):]+"


def sanitize_error(x: Column) -> Column:
    """Absolute Windows and POSIX paths replaced."""
    return F.regexp_replace(F.regexp_replace(x, _WINDOWS_PATH, "<path>"), _POSIX_PATH, "$1<path>")


def sanitize_text(x: str) -> str:
    """``sanitize_error`` of a string at hand, without its file URLs."""
    x = re.sub(r"file:/+[^\s'\"`]+", "<path>", x)
    return re.sub(_POSIX_PATH, r"\1<path>", re.sub(_WINDOWS_PATH, "<path>", x))


def file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def referenced_files(x: Column) -> Column:
    found = F.regexp_extract_all(x, F.lit(r"""(file:///[^\s"'<>)\]]+)"""), F.lit(1))
    return F.array_distinct(F.transform(found, decode_percent))


def global_storage_path(x: str) -> str:
    """The global database beside a folder of workspaces."""
    return re.sub(r"[/\\]workspaceStorage(?:[/\\].*)?$", "/globalStorage/state.vscdb", x)


def document_terms(x: Column) -> Column:
    """Terms in order: lower case, accents folded (also those that are characters of their own), split where neither letter nor digit stands."""
    plain = F.translate(F.lower(x), _LETTERS + _MARKS, _PLAIN)
    return F.filter(F.split(plain, r"[^\p{L}\p{N}\p{Co}]+"), lambda t: t != "")


def query_phrases(query: str) -> list[str]:
    """ASCII search terms of a query, each once; a term with punctuation is a phrase."""
    return list(dict.fromkeys(re.findall(r"[a-z0-9_./:-]{2,}", query.lower())))


def split_segments(text: str, most: int = SEGMENT_CHARS) -> list[str]:
    """Segments of at most ``most`` characters: whole lines packed greedily, long lines cut.

    Runs per text inside an Arrow UDF; a text of line breaks alone has no segment.
    """
    if len(text) <= most:
        return [text]
    out: list[str] = []
    open_lines: list[str] = []
    room = most
    for line in text.split("\n"):
        if open_lines and len(line) + 1 > room or len(line) > most:
            out += ["\n".join(open_lines)] if open_lines else []
            open_lines, room = [], most
        if len(line) > most:
            out += [line[i : i + most] for i in range(0, len(line), most)]
        elif line or open_lines:
            room -= len(line) + bool(open_lines)
            open_lines.append(line)
    return out + (["\n".join(open_lines)] if open_lines else [])


def segments(x: Column) -> Column:
    """``split_segments`` of every text: the one function here that runs Python, by Arrow batches."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(split_segments)

    return cut(x)
