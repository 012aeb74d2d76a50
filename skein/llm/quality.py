"""Quality rules: cross-document line frequency beside plain document statistics.

Every line is normalised (ASCII lower case, digits to 0, white space collapsed) and hashed; the hash is
counted per host over the distinct documents that hold it. Lines above ``limit`` documents of a host are
boilerplate: they are removed, and a document that loses over ``depleted`` of its words is rejected.

A document is a distinct text of a host, however often it is repeated. Texts that are the same but for a few words are one document, so that the
copies of a page don't make its own lines frequent. Whether they are is looked up in their words, for texts with over ``SUSPECT`` of their words in lines that over ``limit``
texts of the host hold: their five-word shingles are counted over these texts, and one with under a ``OWN``-th of shingles that ``limit`` texts or fewer hold is known
by the set of its other shingles. Two texts of one set have a similarity above 0.96. A menu of 40 lines beside one line of one's own makes no copies; pages that differ in
less than that share are taken for copies.

One Arrow pass reads the texts (a second one those of suspects) and leaves 16 bytes of text hash, counts and the line hashes. Contents
are made distinct before their lines are exploded, counts are pre-aggregated before each shuffle, and
only hashes move; a line that a third of all documents share is one pre-aggregated group. ``clean`` reads the texts a second time and cuts
the frequent lines where they lie: up to ``LINES_IN_TASK`` of them go to every task, beyond that a join brings each text its own.

Defined results: a null or empty text has zero words and fails the base rules; a null host is a host of its
own; repeated rows get equal verdicts, one row each; an empty table gives an empty result; lines without a
word are neither counted nor removed; further columns are ignored by ``verdicts`` and kept by ``clean``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.common import byte_texts, map_batches, materialize, spare, text_slices

MIN_WORDS = 20
REPEAT_WINDOW = 8
MAX_REPEAT_PERCENT = 30
#: Distinct documents of one host that may share a line.
LINE_LIMIT = 20
#: Share of a text's words in lines that over the limit of texts hold, beyond which it may be a copy of another.
SUSPECT = 0.85
#: A copy has fewer own shingles than one in so many: similarity of two copies (OWN - 1) / (OWN + 1).
OWN, SHINGLE = 64, 5
#: Suspects (of 40 bytes) that are sent to every task; more of them are joined.
SUSPECTS_IN_TASK = 200_000
#: Share of a document's words that it may lose.
DEPLETED = 0.7
#: Frequent lines that are sent to every task; more of them are joined.
LINES_IN_TASK = 200_000

_NORMAL = bytes.maketrans(bytes(range(65, 91)) + b"0123456789", bytes(range(97, 123)) + b"0" * 10)
_SYMBOLS = re.compile(rb"[#*$%&|<>]")
_CONTINUATION = bytes(range(0x80, 0xC0))
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[bytes], window: int = REPEAT_WINDOW) -> int:
    """Words covered by windows that occur at least twice in the text."""
    n = len(words)
    if n <= window:
        return 0
    seen: dict[bytes, int] = {}
    ranks = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    if len(seen) == n:
        return 0
    width = 1
    while width < window:  # ranks of windows of 1, 2, 4, 8 words: exact, two ranks make one number
        step = min(width, window - width)
        left, right = ranks[: len(ranks) - step], ranks[step:]
        ranks = np.unique(left * (int(ranks.max()) + 1) + right, return_inverse=True)[1]
        width += step
    again = np.bincount(ranks)[ranks] > 1
    if not again.any():
        return 0
    cover = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + window, -1)
    return int((np.cumsum(cover[:n]) > 0).sum())


def base_counts(text: bytes | None) -> tuple[int, ...]:
    """The BASE counts of one text."""
    text = text or b""
    words = text.split()
    raw = [x for x in text.split(b"\n") if x and not x.isspace()]
    chars = sum(map(len, words)) - sum(len(w) - len(w.translate(None, _CONTINUATION)) for w in words if not w.isascii())
    return len(words), chars, len(_SYMBOLS.findall(text)), len(raw) - len(set(raw)), repeated_words(words)


def line_hash(words: list[bytes]) -> int:
    """Hash, as a signed number, of a line with these normalised words."""
    return int.from_bytes(hashlib.md5(b" ".join(words)).digest()[:8], "big", signed=True)


def normal_words(line: bytes) -> list[bytes]:
    return line.translate(_NORMAL).split()


def line_counts(text: bytes | None) -> dict[int, int]:
    """Words of each line hash of a text."""
    counts: dict[int, int] = {}
    for line in (text or b"").split(b"\n"):
        if words := normal_words(line):
            key = line_hash(words)
            counts[key] = counts.get(key, 0) + len(words)
    return counts


def cut_lines(text: bytes, lost: set[int]) -> tuple[bytes, int]:
    """The text without the lines of ``lost``, and the number of words that it lost."""
    kept, gone = [], 0
    for line in text.split(b"\n"):
        words = normal_words(line)
        if words and line_hash(words) in lost:
            gone += len(words)
        else:
            kept.append(line)
    return (b"\n".join(kept), gone) if gone else (text, 0)


def features(docs: DataFrame, host: str = "source", base: bool = True) -> DataFrame:
    """doc_id, host, text_hash, lines and line_words of every row, and its BASE counts."""
    ids = docs.select("doc_id", F.col(host).alias("host"), "text")
    counts = BASE if base else ()
    more = [*((c, T.LongType(), pa.int64()) for c in counts), ("text_hash", T.BinaryType(), pa.binary()), ("lines", T.ArrayType(T.LongType()), pa.list_(pa.int64())), ("line_words", T.ArrayType(T.IntegerType()), pa.list_(pa.int32()))]
    out = T.StructType([ids.schema["doc_id"], ids.schema["host"], *(T.StructField(n, t) for n, t, _ in more)])

    def describe(text: bytes | None) -> tuple:
        lines = line_counts(text)
        return (*(base_counts(text) if base else ()), hashlib.md5(text or b"").digest(), list(lines), list(lines.values()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                columns = zip(*map(describe, byte_texts(part, "text")), strict=True)
                yield pa.record_batch([part.column(0), part.column(1), *(pa.array(c, kind) for c, (_, _, kind) in zip(columns, more, strict=True))], out.names)

    return map_batches(ids, run, out)


def _same(left: str, right: str):
    return F.col(left).eqNullSafe(F.col(right))


def _lines(feats: DataFrame) -> DataFrame:
    """host, text_hash, total, line and words of the lines of every distinct text of a host."""
    held = feats.select("host", "text_hash", "lines", "line_words")
    contents = materialize(held.groupBy("host", "text_hash").agg(F.first("lines").alias("lines"), F.first("line_words").alias("line_words")))
    total = F.aggregate("line_words", F.lit(0).cast("long"), lambda a, x: a + x)
    each = contents.select("host", "text_hash", total.alias("total"), F.explode(F.arrays_zip("lines", "line_words")).alias("x"))
    return each.select("host", "text_hash", "total", F.col("x.lines").alias("line"), F.col("x.line_words").alias("words"))


def _above(counted: DataFrame, limit: int) -> DataFrame:
    return counted.filter(F.col("n") > limit).select(F.col("host").alias("h"), F.col("line").alias("l"))


def shingle_hashes(text: bytes | None) -> list[int]:
    """Hashes of the distinct shingles of a text's normalised words."""
    words = normal_words(text or b"")
    n = max(1, len(words) - SHINGLE + 1)
    return list({xxhash.xxh64_intdigest(b" ".join(words[i : i + SHINGLE])) - (1 << 63) for i in range(n)})


def _shingles(texts: DataFrame) -> DataFrame:
    """h, t and shingles of ``texts`` (h, t, text)."""
    out = T.StructType([texts.schema["h"], texts.schema["t"], T.StructField("shingles", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                yield pa.record_batch([part.column(0), part.column(1), pa.array(map(shingle_hashes, byte_texts(part, "text")), pa.list_(pa.int64()))], out.names)

    return map_batches(texts, run, out)


def _documents(docs: DataFrame, suspects: DataFrame, limit: int, host: str) -> DataFrame:
    """h, t and document of the ``suspects`` (h, t) that are copies of others."""
    texts = docs.select(F.col(host).alias("host"), F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("hash"), "text")
    if suspects.limit(SUSPECTS_IN_TASK + 1).count() <= SUSPECTS_IN_TASK:
        suspects = F.broadcast(suspects)
    found = _shingles(texts.join(suspects, _same("host", "h") & (F.col("hash") == F.col("t"))).select("h", "t", "text"))
    each = materialize(found.groupBy("h", "t").agg(F.first("shingles").alias("shingles"))).select("h", "t", F.explode("shingles").alias("shingle"))
    common = each.groupBy(F.col("h").alias("ch"), F.col("shingle").alias("c")).agg(F.count("*").alias("n")).filter(F.col("n") > limit).drop("n")
    known = each.join(common, _same("h", "ch") & (F.col("shingle") == F.col("c")), "left")
    # the set of a text's common shingles, whatever their order: their number and two sums of 64-bit hashes
    sums = [F.sum(F.when(F.col("c").isNotNull(), F.xxhash64(F.lit(i), "c").cast("decimal(20)"))).alias(f"s{i}") for i in (1, 2)]
    sets = known.groupBy("h", "t").agg(F.count("*").alias("n"), F.count("c").alias("n_common"), *sums)
    return sets.filter((F.col("n") - F.col("n_common")) * OWN < F.col("n")).select("h", "t", F.concat_ws(" ", "n_common", "s1", "s2").cast("binary").alias("document"))


def frequent_lines(docs: DataFrame, feats: DataFrame, limit: int = LINE_LIMIT, host: str = "source") -> tuple[DataFrame, DataFrame]:
    """Lines (h, l) that over ``limit`` documents of a host hold, and the rows of lines that over ``limit`` texts hold."""
    rows = _lines(feats)
    many = materialize(_above(rows.groupBy("host", "line").agg(F.count("*").alias("n")), limit))
    held = materialize(rows.join(many, _same("host", "h") & (F.col("line") == F.col("l"))).drop("h", "l"))
    inside = held.groupBy(F.col("host").alias("h"), F.col("text_hash").alias("t")).agg(F.sum("words").alias("inside"), F.first("total").alias("total"))
    suspects = materialize(inside.filter(F.col("inside") > F.col("total") * SUSPECT).select("h", "t"))
    if suspects.isEmpty():
        return many, held
    copies = materialize(_documents(docs, suspects, limit, host))
    named = held.join(copies, _same("host", "h") & (F.col("text_hash") == F.col("t")), "left")
    # a line's documents: its texts that are no copies, and the distinct names of copies
    names = named.filter("document IS NOT NULL").groupBy("host", "line", "document").agg(F.lit(1).alias("n"))
    single = named.filter("document IS NULL").groupBy("host", "line").agg(F.count("*").alias("n"))
    counted = single.unionByName(names.select("host", "line", "n")).groupBy("host", "line").agg(F.sum("n").alias("n"))
    return materialize(_above(counted, limit)), held


def _removed(docs: DataFrame, feats: DataFrame, limit: int, host: str) -> tuple[DataFrame, DataFrame]:
    """The frequent lines, and h, t, removed (hashes) and removed_words of each text of a host that holds some."""
    over, held = frequent_lines(docs, feats, limit, host)
    hit = held.join(over, _same("host", "h") & (F.col("line") == F.col("l")))
    return over, hit.groupBy(F.col("host").alias("h"), F.col("text_hash").alias("t")).agg(F.collect_set("line").alias("removed"), F.sum("words").alias("removed_words"))


def verdicts(docs: DataFrame, host: str = "source", limit: int = LINE_LIMIT, depleted: float = DEPLETED) -> DataFrame:
    """The counts of every row, base_failed, removed_words and kept."""
    feats = materialize(features(docs, host))
    found = _removed(docs, feats, limit, host)[1].drop("removed")
    rows = feats.drop("lines", "line_words").join(found, _same("host", "h") & (F.col("text_hash") == F.col("t")), "left")
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    removed = F.coalesce("removed_words", F.lit(0))
    return rows.select("doc_id", *BASE, failed.alias("base_failed"), removed.alias("removed_words"), (~failed & (removed <= F.col("n_words") * depleted)).alias("kept"))


def clean(docs: DataFrame, host: str = "source", limit: int = LINE_LIMIT, depleted: float = DEPLETED, lines_in_task: int = LINES_IN_TASK) -> DataFrame:
    """The kept rows of ``docs`` without their frequent lines; columns stay, n_chars follows the text."""
    feats = materialize(features(docs, host, base=False))
    over, of_text = _removed(docs, feats, limit, host)
    host_at, lost_at = spare(docs, "host"), spare(docs, "lost")
    rows = docs.withColumn(host_at, F.col(host))
    by_host: dict = {}
    if joined := over.limit(lines_in_task + 1).count() > lines_in_task:
        h, t = spare(docs, "h"), spare(docs, "t")
        found = materialize(of_text.select(F.col("h").alias(h), F.lower(F.hex("t")).alias(t), F.col("removed").alias(lost_at)))
        rows = rows.join(found, _same(host_at, h) & (F.md5(F.coalesce("text", F.lit(""))) == F.col(t)), "left").drop(h, t)
    else:
        for r in over.collect():
            by_host.setdefault(r.h, set()).add(r.l)

    def kept(text: bytes | None, lost: set[int]) -> bytes | None:
        n_words, *_, again = base_counts(text)
        if n_words < MIN_WORDS or again * 100 > n_words * MAX_REPEAT_PERCENT:
            return None
        left, gone = cut_lines(text, lost)
        return left if gone <= n_words * depleted else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                names = part.schema.names
                hosts = part.column(names.index(host_at)).to_pylist()
                lost = [set(x or ()) for x in part.column(names.index(lost_at)).to_pylist()] if joined else [by_host.get(h, ()) for h in hosts]
                texts = list(map(kept, byte_texts(part, "text"), lost))
                stay = pa.array([t is not None for t in texts])
                columns = [part.column(i) for i in range(len(docs_schema))]
                at = names.index("text")
                columns[at] = pa.array(texts, pa.binary()).cast(columns[at].type)
                yield pa.record_batch(columns, names[: len(columns)]).filter(stay)

    docs_schema = docs.schema
    out = map_batches(rows, run, docs_schema)
    return out.withColumn("n_chars", F.length("text").cast(docs_schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
word AS (SELECT r, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM w),
win AS (
  SELECT r, i, word || chr(10) || string_agg(word, chr(10)) OVER x AS eight, count(*) OVER x AS n
  FROM word WINDOW x AS (PARTITION BY r ORDER BY i ROWS BETWEEN 1 FOLLOWING AND {REPEAT_WINDOW - 1} FOLLOWING)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, eight) AS c FROM win WHERE n = {REPEAT_WINDOW - 1}) WHERE c > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM again, range({REPEAT_WINDOW}) t(k) GROUP BY r),
raw AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
line AS (SELECT r, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS ws FROM raw),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM line WHERE len(ws) > 0 GROUP BY r),
norm AS (
  SELECT r, regexp_replace(translate(array_to_string(ws, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]', '0', 'g') AS h, sum(len(ws)) AS n
  FROM line WHERE len(ws) > 0 GROUP BY ALL),
held AS (SELECT DISTINCT source, text, h, n FROM norm JOIN d USING (r)),
many AS (SELECT source, h FROM held GROUP BY source, h HAVING count(*) > {LINE_LIMIT}),
inside AS (SELECT held.* FROM held JOIN many ON many.h = held.h AND many.source IS NOT DISTINCT FROM held.source),
total AS (SELECT source, text, sum(n) AS total FROM held GROUP BY source, text),
suspect AS (
  SELECT i.source, i.text FROM (SELECT source, text, sum(n) AS n FROM inside GROUP BY ALL) i JOIN total t ON t.text = i.text AND t.source IS NOT DISTINCT FROM i.source
  WHERE i.n > t.total * {SUSPECT}),
plain AS (
  SELECT source, text, regexp_extract_all(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]', '0', 'g'), '[^\x20\x09-\x0D]+') AS ws FROM suspect),
shingle AS (SELECT DISTINCT source, text, array_to_string(ws[k + 1 : k + {SHINGLE}], ' ') AS s FROM (SELECT *, unnest(range(greatest(1, len(ws) - {SHINGLE - 1}))) AS k FROM plain)),
known AS (SELECT *, count(*) OVER (PARTITION BY source, s) > {LINE_LIMIT} AS common FROM shingle),
copy AS (
  SELECT source, text, string_agg(s, chr(10) ORDER BY s) FILTER (common) AS document FROM known
  GROUP BY source, text HAVING count(*) FILTER (NOT common) * {OWN} < count(*)),
freq AS (
  SELECT i.source, i.h FROM inside i LEFT JOIN copy c ON c.text = i.text AND c.source IS NOT DISTINCT FROM i.source
  GROUP BY i.source, i.h HAVING count(DISTINCT coalesce('copy ' || c.document, 'text ' || i.text)) > {LINE_LIMIT}),
lost AS (SELECT r, sum(n) AS removed_words FROM norm JOIN d USING (r) JOIN freq ON freq.h = norm.h AND freq.source IS NOT DISTINCT FROM d.source GROUP BY r),
base AS (
  SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(removed_words, 0) AS removed_words
  FROM d JOIN w USING (r) LEFT JOIN covered USING (r) LEFT JOIN dup USING (r) LEFT JOIN lost USING (r))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed, removed_words::BIGINT AS removed_words, NOT base_failed AND removed_words <= n_words * {DEPLETED} AS kept
FROM (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM base)
"""
