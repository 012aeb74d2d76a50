"""SentencePiece encoding (byte-pair merges with byte fallback) and decoding in vectorised merge rounds.

The words of a batch that are not known yet are laid out as one flat array of symbols. In every round each word's smallest pair
rank is found (a segmented minimum), all pairs of that rank are merged at once, leftmost first where they overlap, and the arrays are
compacted; words without a pair to merge leave. The library merges one pair at a time: the results agree as long as a
merge gives rise to no pair that goes before or with the round's own. Where one does (runs of spaces, of one letter), the word is
set aside and its pairs are merged one by one from a priority queue.

Words are cut where no piece of the vocabulary can reach across: before a space mark that follows something else, around characters that lie in
no piece of two or more, and at character pairs that no piece contains. Ids of words are kept from batch to batch in a bounded table. A text is
encoded and decoded whole, row by row of Arrow batches; nothing is shuffled.

Defined results: a null or empty text gives the begin and end ids alone and decodes to the empty text; a null doc_id is kept; each of several
equal rows has its row; an empty table gives an empty result; further columns are ignored. U+2581 in a text stands for a space, as in the library.
"""

from __future__ import annotations

import functools
import gc
import hashlib
import heapq
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from skein.llm.common import keep_cache, map_batches, text_slices

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Words that a worker remembers (about 250 bytes each).
CACHE_WORDS = 600_000
#: A rank that no pair has.
NONE = np.iinfo(np.int64).max

# Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE = 1, 2, 3, 4, 6


class Pieces:
    """The vocabulary of one model file as arrays."""

    def __init__(self, file: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(file, "rb") as f:
            model.ParseFromString(f.read())
        spec, kinds = model.normalizer_spec, {p.type for p in model.pieces}
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or not kinds <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("this encoder takes byte-pair models with byte fallback, without normalisation and own symbols")
        self.prefix = spec.add_dummy_prefix
        normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        letters = sorted({c for p in normal for c in p})
        # Symbols are pieces by their id; letters that are no piece themselves get numbers beyond them.
        self.symbols = normal | {c: len(model.pieces) + i for i, c in enumerate(c for c in letters if c not in normal)}
        self.n_symbols = len(model.pieces) + len(letters) + 1
        codes = np.array([ord(c) for c in letters], np.int64)
        self.letter_codes, self.letter_ids = codes, np.array([self.symbols[c] for c in letters], np.int64)

        scores = {s: r for r, s in enumerate(sorted({model.pieces[i].score for i in normal.values()}, reverse=True))}
        pairs = {(self.symbols[p[:k]], self.symbols[p[k:]]): (scores[model.pieces[i].score], i) for p, i in normal.items() for k in range(1, len(p)) if p[:k] in self.symbols and p[k:] in self.symbols}
        self.pairs = pairs
        keys = np.array([a * self.n_symbols + b for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.pair_keys, found = keys[order], np.array(list(pairs.values()), np.int64)[order]
        self.pair_ranks, self.pair_ids = found[:, 0].copy(), found[:, 1].copy()
        self.bigrams = np.unique([(ord(a) << 21) | ord(b) for p in normal for a, b in itertools.pairwise(p)])

        self.bytes = np.zeros(256, np.int64)
        for i, p in enumerate(model.pieces):
            if p.type == BYTE:
                self.bytes[int(p.piece[3:5], 16)] = i
        self.byte_of = {int(i): b for b, i in enumerate(self.bytes)}
        unknown = model.trainer_spec.unk_surface.encode()
        self.texts = [b"" if p.type == CONTROL else unknown if p.type == UNKNOWN else bytes([self.byte_of[i]]) if p.type == BYTE else p.piece.replace(SPACE, " ").encode() for i, p in enumerate(model.pieces)]
        self.controls = {i for i, p in enumerate(model.pieces) if p.type == CONTROL}
        self.spaced = {i for p, i in normal.items() if p.startswith(SPACE)}
        self.begin, self.end = (next(i for i, p in enumerate(model.pieces) if p.piece == x) for x in (model.trainer_spec.bos_piece, model.trainer_spec.eos_piece))
        inside = {c for p in normal if len(p) > 1 for c in p}
        apart = "".join(c for c in "\t\n\r" if c not in inside)
        stop = re.escape(SPACE + apart)
        self.word = re.compile(f"{SPACE}*[^{stop}]+|{SPACE}+" + (f"|[{re.escape(apart)}]+" if apart else ""))
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in normal):
            raise ValueError("a piece goes on after a space")
        self.words: dict[str, bytes] = {}

    # encoding

    def _lookup(self, left: np.ndarray, right: np.ndarray, same: np.ndarray | bool) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged id of each pair; NONE where there is none or the two lie in different words."""
        keys = np.where(same & (left >= 0) & (right >= 0), left * self.n_symbols + right, -1)
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        hit = self.pair_keys[at] == keys
        return np.where(hit, self.pair_ranks[at], NONE), self.pair_ids[at]

    def merge(self, symbols: np.ndarray, segment: np.ndarray) -> tuple[list[np.ndarray], set[int]]:
        """Final symbols of every segment (``segment`` numbers them in ascending order), and the segments whose rounds don't give the library's order."""
        n, symbols = int(segment[-1]) + 1 if len(segment) else 0, symbols.copy()
        done: list[np.ndarray] = [np.empty(0, np.int64)] * n
        serial: set[int] = set()
        rank, merged = np.full(len(symbols), NONE), np.zeros(len(symbols), np.int64)  # of each symbol with its next
        touched = np.arange(len(symbols))
        while len(symbols):
            pair = touched[touched < len(symbols) - 1]
            rank[touched] = NONE
            rank[pair], merged[pair] = self._lookup(symbols[pair], symbols[pair + 1], segment[pair] == segment[pair + 1])
            starts = np.flatnonzero(np.append(True, segment[1:] != segment[:-1]))
            least = np.minimum.reduceat(rank, starts)
            lengths = np.diff(np.append(starts, len(symbols)))
            over = least == NONE
            for i in np.flatnonzero(over).tolist():
                done[segment[starts[i]]] = symbols[starts[i] : starts[i] + lengths[i]]
            # Leftmost of overlapping pairs: every second one of a run of neighbouring pairs.
            at = np.flatnonzero((rank != NONE) & (rank == np.repeat(least, lengths)))
            first = np.maximum.accumulate(np.where(np.append(True, np.diff(at) != 1)[: len(at)], np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - first) % 2 == 0]
            symbols[at] = merged[at]
            fresh, stay = np.zeros(len(symbols), bool), ~np.repeat(over, lengths)
            fresh[at] = True
            stay[at + 1] = False
            several, was = np.bincount(segment[at], minlength=n) > 1, np.full(n, -1)
            was[segment[starts]] = least
            symbols, segment, rank, merged, fresh = symbols[stay], segment[stay], rank[stay], merged[stay], fresh[stay]
            touched = np.flatnonzero(fresh | np.append(fresh[1:], False))
            # A new pair that goes before the round's other merges, or with them: the order of single merges matters.
            pair = touched[:-1] if len(touched) and touched[-1] == len(symbols) - 1 else touched
            pair = pair[several[segment[pair]] & (segment[pair] == segment[pair + 1])]
            odd = np.unique(segment[pair][self._lookup(symbols[pair], symbols[pair + 1], True)[0] <= was[segment[pair]]])
            if len(odd):
                serial.update(odd.tolist())
                keep = ~np.isin(segment, odd)
                touched = (np.cumsum(keep) - 1)[touched[keep[touched]]]
                symbols, segment, rank, merged = symbols[keep], segment[keep], rank[keep], merged[keep]
        return done, serial

    def merge_one_by_one(self, symbols: list[int]) -> list[int]:
        """Best pair first, leftmost of equals, from a priority queue over a linked list."""
        n, ids = len(symbols), list(symbols)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = [(r[0], i, ids[i], ids[i + 1], r[1]) for i in range(n - 1) if (r := self.pairs.get((ids[i], ids[i + 1])))]
        heapq.heapify(queue)
        while queue:
            _, i, a, b, merged = heapq.heappop(queue)
            j = right[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = merged, -2
            right[i] = right[j]
            if right[i] >= 0:
                left[right[i]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y >= 0 and (r := self.pairs.get((ids[x], ids[y]))):
                    heapq.heappush(queue, (r[0], x, ids[x], ids[y], r[1]))
        return [x for x in ids if x != -2]

    def _learn(self, new: list[str]) -> None:
        codes = np.frombuffer("".join(new).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        lengths = np.fromiter(map(len, new), np.int64, len(new))
        word = np.repeat(np.arange(len(new)), lengths)
        at = np.minimum(np.searchsorted(self.letter_codes, codes), len(self.letter_codes) - 1)
        symbols = np.where(self.letter_codes[at] == codes, self.letter_ids[at], -1 - codes)
        cut = np.append(True, (word[1:] != word[:-1]) | ~np.isin((codes[:-1] << 21) | codes[1:], self.bigrams))
        segment = np.cumsum(cut) - 1
        done, serial = self.merge(symbols, segment)
        bounds = np.append(np.flatnonzero(cut), len(symbols))
        for s in serial:
            done[s] = np.array(self.merge_one_by_one(symbols[bounds[s] : bounds[s + 1]].tolist()), np.int64)
        n_done = np.fromiter(map(len, done), np.int64, len(done))
        flat, of = np.concatenate(done), np.repeat(word[np.flatnonzero(cut)], n_done)
        lost = np.flatnonzero((flat < 0) | (flat >= len(self.texts)))
        if len(lost):  # bytes in place of characters that are no piece
            names = {v: k for k, v in self.symbols.items() if v >= len(self.texts)}
            spelt = [self.bytes[list((chr(-1 - x) if x < 0 else names[x]).encode("utf-8", "replace"))] for x in flat[lost].tolist()]
            wide = np.ones(len(flat), np.int64)
            wide[lost] = [len(b) for b in spelt]
            out = np.repeat(flat, wide)
            out[np.repeat((flat < 0) | (flat >= len(self.texts)), wide)] = np.concatenate(spelt)
            flat, of = out, np.repeat(of, wide)
        raw, to = flat.astype("<u4").tobytes(), np.append(0, 4 * np.cumsum(np.bincount(of, minlength=len(new)))).tolist()
        self.words.update((w, raw[a:b]) for w, a, b in zip(new, to[:-1], to[1:], strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of whole texts, begin and end included, as little-endian unsigned 32-bit integers."""
        marked = [((SPACE if self.prefix else "") + t.replace(" ", SPACE)) if t else "" for t in texts]
        split = list(map(self.word.findall, marked))
        new = set(itertools.chain.from_iterable(split)).difference(self.words)
        if len(self.words) + len(new) > CACHE_WORDS:
            self.words.clear()
            new = set(itertools.chain.from_iterable(split))
        collects = gc.isenabled()
        gc.disable()
        try:
            if new:
                self._learn(list(new))
        finally:
            if collects:
                gc.enable()
        a, z = (np.array([x], "<u4").tobytes() for x in (self.begin, self.end))
        return [a + b"".join(map(self.words.__getitem__, ws)) + z for ws in split]

    # decoding

    def decode(self, ids: bytes) -> str:
        """The text of the ids. Bytes that are no UTF-8 in their run of byte pieces become U+FFFD each."""
        numbers = np.frombuffer(ids, "<u4").tolist()
        whole = b"".join(map(self.texts.__getitem__, numbers))
        try:
            text = whole.decode("ascii" if self.controls.intersection(numbers[1:-1]) else "utf-8")
        except UnicodeDecodeError:
            text = "".join(_utf8_or_marks(b"".join(map(self.texts.__getitem__, run))) if is_byte else b"".join(map(self.texts.__getitem__, run)).decode() for is_byte, run in itertools.groupby(numbers, self.byte_of.__contains__))
        first = next((i for i in numbers if self.texts[i]), None)
        return text[1:] if self.prefix and first in self.spaced else text


def _utf8_or_marks(run: bytes) -> str:
    out, i = [], 0
    while i < len(run):
        for n in (1, 2, 3, 4):
            try:
                out.append(run[i : i + n].decode())
                i += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out)


@functools.cache
def pieces(file: str) -> Pieces:
    """One vocabulary for each worker process, kept from task to task."""
    return Pieces(file)


def encode_documents(docs: DataFrame, file: str | None = None) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit, begin and end included) and decoded of every row."""
    return _encode(docs, file, [("ids", T.BinaryType(), pa.binary()), ("decoded", T.StringType(), pa.string())], lambda ids, text: (ids, text))


def digests(docs: DataFrame, file: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row: what ``encode_documents`` gives, as digests made where the ids are."""

    def digest(ids: bytes, text: str) -> tuple:
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest()

    return _encode(docs, file, [("n_tokens", T.LongType(), pa.int64()), ("ids_sha256", T.StringType(), pa.string()), ("decoded_sha256", T.StringType(), pa.string())], digest)


def _encode(docs: DataFrame, file: str | None, fields: list, of) -> DataFrame:
    file = file or public_tokenizers.path(MODEL)
    rows = docs.select("doc_id", "text")
    out = T.StructType([rows.schema["doc_id"], *(T.StructField(n, t) for n, t, _ in fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pieces(file)
        keep_cache(owner, pieces)
        for batch in batches:
            for part in text_slices(batch, "text"):
                columns = zip(*(of(ids, vocabulary.decode(ids)) for ids in vocabulary.encode(part.column("text").to_pylist())), strict=True)
                yield pa.record_batch([part.column(0), *(pa.array(c, kind) for c, (_, _, kind) in zip(columns, fields, strict=True))], out.names)

    owner = run.__qualname__
    return map_batches(rows, run, out)
