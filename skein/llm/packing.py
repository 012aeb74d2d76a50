"""Best-fit packing of tokenised documents into sequences of fixed capacity.

Bounded-space online best-fit: a task keeps a fixed number of open bins in a bitset keyed by free space. A
piece goes to the bin with the least free space that still holds it (the lowest set bit at or above its
length); where a new bin is needed and all are open, the fullest one closes first.

Pieces are written once without their text, dealt evenly over tasks of about ``rows_per_task`` pieces, and
fed in order of falling length, so that small pieces fill what large ones leave. A task holds counters
of its open bins alone, whatever the number of pieces. Tokens come from a word cache: the tokenizer never joins
across ASCII white space nor across the parts that it splits words into, so that the ids of a text are
those of its words' parts in a row (tested against the tokenizer on whole texts).

Defined results: a null or empty text is one piece with the end id alone; a null doc_id is kept; each of
several equal rows is packed for itself; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import functools
import gc
import itertools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.common import byte_texts, keep_cache, map_batches, materialize, release_memory, text_slices

CAPACITY = 4096
END_ID = 1
OPEN_BINS = 1 << 14
ROWS_PER_TASK = 50_000
TOKENIZER = "word_bpe_49k.json"
#: Words that a worker remembers (about 200 bytes each), and half as many parts of words.
CACHE_WORDS = 800_000
#: Bytes of text that are split into words at a time; a word list takes about ten times its text.
SPLIT_BYTES = 1 << 18

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
# The parts that this tokenizer splits lower-case text into.
_PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Letters below U+0100 have no accents to compose and fold to one letter each; other words go whole to the tokenizer.
_PLAIN = regex.compile(r"[\x00-\xFF]*")


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def _cuts(text: bytes, most: int) -> Iterator[bytes]:
    """The text in pieces of about ``most`` bytes, cut at white space; a longer word stays whole."""
    at = 0
    while len(text) - at > most and (space := _SPACE.search(text, at + most)):
        yield text[at : space.start()]
        at = space.end()
    yield text[at:] if at else text


class WordTokens:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, from bounded caches of words and of their parts.

    New parts go to the tokenizer's own merges in one call; a token that ends a part carries the end-of-word mark.
    """

    def __init__(self, file: str, cache_words: int = CACHE_WORDS):
        self.most_words, self.most_parts = cache_words, cache_words // 2
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.merges = Tokenizer.from_file(file), Tokenizer.from_file(file)
        self.merges.normalizer, self.merges.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.special = regex.compile("|".join(regex.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()))
        self.letters = _byte_letters()
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _learn_parts(self, new: list[str]) -> None:
        for i in range(0, len(new), 4096):
            some = new[i : i + 4096]
            shown = [p if p.isascii() and p.isprintable() else p.encode().decode("latin-1").translate(self.letters) for p in some]
            ids = np.array(self.merges.encode_batch_fast([" ".join(shown)], add_special_tokens=False)[0].ids, "<u4")
            cuts, raw = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist(), ids.tobytes()
            for p, a, b in zip(some, [0, *cuts[:-1]], cuts, strict=True):
                self.parts[p] = raw[a:b]

    def _learn(self, new: set[bytes]) -> None:
        words, find = list(new), _PARTS.findall
        texts = [w.decode() for w in words]
        if not _PLAIN.fullmatch(whole := "".join(texts)) or self.special.search(whole):
            odd = [i for i, t in enumerate(texts) if not _PLAIN.fullmatch(t) or self.special.search(t)]
            for i in reversed(odd):
                self.words[words.pop(i)] = np.array(self.tokenizer.encode(texts.pop(i), add_special_tokens=False).ids, "<u4").tobytes()
        split = [find(t.lower()) for t in texts]
        wanted = set(itertools.chain.from_iterable(split))
        if len(self.parts) + len(wanted) > self.most_parts:
            self.parts.clear()
        self._learn_parts(list(wanted.difference(self.parts)))
        known = self.parts
        self.words.update(zip(words, [known[p[0]] if len(p) == 1 else b"".join([known[x] for x in p]) for p in split], strict=True))

    def _encode(self, texts: list[bytes]) -> list[bytes]:
        split = [t.split() for t in texts]
        new = set(itertools.chain.from_iterable(split)).difference(self.words)
        if len(self.words) + len(new) > self.most_words:
            self.words.clear()
            new = set(itertools.chain.from_iterable(split))
        collects = gc.isenabled()
        gc.disable()  # the caches hold no cycles, and looking through them again and again takes half the time
        try:
            self._learn(new)
        finally:
            if collects:
                gc.enable()
        return [b"".join(map(self.words.__getitem__, ws)) for ws in split]

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """Ids of each text; words are listed for about ``SPLIT_BYTES`` of text at a time, whatever the texts' sizes."""
        ids: list[list[bytes]] = [[] for _ in texts]
        rows, some, held = [], [], 0

        def flush() -> None:
            for i, x in zip(rows, self._encode(some), strict=True):
                ids[i].append(x)

        for i, t in enumerate(texts):
            for piece in _cuts(t or b"", SPLIT_BYTES):
                if held and held + len(piece) > SPLIT_BYTES:
                    flush()
                    rows, some, held = [], [], 0
                rows.append(i)
                some.append(piece)
                held += len(piece)
        flush()
        return [x[0] if len(x) == 1 else b"".join(x) for x in ids]


@functools.cache
def word_tokens(file: str, cache_words: int = CACHE_WORDS) -> WordTokens:
    """One encoder for each worker process, kept from task to task."""
    encoder = WordTokens(file, cache_words)
    release_memory()  # reading the file takes about as much again
    return encoder


def tokens(docs: DataFrame, file: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False, cache_words: int = CACHE_WORDS) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece; with ``keep_ids`` its ids, too."""
    file = file or public_tokenizers.path(TOKENIZER)
    ids = docs.select("doc_id", "text")
    fields = [("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType())]
    out = T.StructType([ids.schema["doc_id"], *(T.StructField(*f) for f in fields), *([T.StructField("ids", T.BinaryType())] if keep_ids else [])])
    end, width = np.array([end_id], "<u4").tobytes(), 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_tokens(file, cache_words)
        keep_cache(owner, word_tokens)
        for batch in batches:
            for part in text_slices(batch, "text"):
                whole = [x + end for x in encoder.encode(byte_texts(part, "text"))]
                rows = [(i, p, at // 4, x[at : at + width]) for i, x in enumerate(whole) for p, at in enumerate(range(0, len(x), width))]
                row, piece, start, cut = (list(c) for c in zip(*rows, strict=True))
                columns = [part.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array([len(c) // 4 for c in cut], pa.int64()), pa.array(map(zlib.crc32, cut), pa.int64())]
                yield pa.record_batch(columns + [pa.array(cut, pa.binary())] * keep_ids, out.names)

    owner = run.__qualname__
    return map_batches(ids, run, out)


class OpenBins:
    """Open bins of one task; ``put`` gives the bin and the offset of a piece."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most, self.open, self.made = capacity, most, 0, 0
        self.bits = 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, length: int) -> tuple[int, int]:
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            bins = self.by_free[free]
            one = bins.pop()
            if not bins:
                self.bits ^= 1 << free
        else:
            if self.open == self.most:
                fullest = (self.bits & -self.bits).bit_length() - 1
                self.by_free[fullest].pop()
                if not self.by_free[fullest]:
                    self.bits ^= 1 << fullest
                self.open -= 1
            one, free = self.made, self.capacity
            self.made += 1
            self.open += 1
        left = free - length
        if left:
            self.by_free[left].append(one)
            self.bits |= 1 << left
        else:
            self.open -= 1
        return one, self.capacity - free


def pack(pieces: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``pieces`` (a written table with ``length``) with sequence_id and offset."""
    tasks = max(1, -(-pieces.count() // rows_per_task))
    out = T.StructType([*pieces.schema, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, first = OpenBins(capacity, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            placed = [bins.put(n) for n in batch.column(batch.schema.get_field_index("length")).to_pylist()]
            yield pa.record_batch([*batch.columns, pa.array([first + b for b, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())], out.names)

    order = [F.desc("length"), *(F.col(c) for c in pieces.columns if c in ("doc_id", "piece"))]
    return map_batches(pieces.repartition(tasks).sortWithinPartitions(*order), run, out)


def pack_documents(docs: DataFrame, file: str | None = None, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, keep_ids: bool = False, cache_words: int = CACHE_WORDS) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    return pack(materialize(tokens(docs, file, capacity, keep_ids=keep_ids, cache_words=cache_words)), capacity, open_bins)
