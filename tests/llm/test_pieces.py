"""Encoding and decoding against the sentencepiece library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from conftest import DATA
from skein.llm import pieces, queries

FILE = public_tokenizers.path(pieces.MODEL)
LETTERS = ["a", "b", "t", "h", "e", " ", "  ", "\n", "\t", "\r", "=", "-", "_", "é", "ß", "漢", "字", "😀", "▁", "\x00", "<s>", "</s>", "<0x41>", "<unk>", "}", ";", "in", "er", "the", " the", "0", "́", "Ω", "и", "​", "�", "___"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=FILE)


@pytest.fixture(scope="module")
def own():
    return pieces.Pieces(FILE)


def agree(library, own, texts):
    for text, got in zip(texts, own.encode(texts), strict=True):
        want = library.encode(text or "", add_bos=True, add_eos=True)
        assert np.frombuffer(got, "<u4").tolist() == want, text
        assert own.decode(got) == library.decode(want), text


def test_invented_texts(library, own):
    r = random.Random(5)
    agree(library, own, ["".join(r.choice(LETTERS[: r.randint(1, len(LETTERS))]) for _ in range(r.randint(0, 60))) for _ in range(3000)])
    agree(library, own, ["".join(chr(c) for c in (r.randrange(0x110000) for _ in range(30)) if not 0xD800 <= c < 0xE000) for _ in range(500)])


def test_any_pieces_in_a_row(library, own):
    r = random.Random(6)
    names = [library.id_to_piece(i).replace("▁", " ") for i in range(259, library.vocab_size())]
    agree(library, own, ["".join(r.choice(names) for _ in range(r.randint(1, 20))) for _ in range(3000)])


@pytest.mark.parametrize("text", ["", None, " ", "a" * 50_000, " " * 50_000 + "x", "=" * 50_000, "ab" * 50_000, "\n \n" * 999])
def test_long_and_empty(library, own, text):
    agree(library, own, [text])


def test_rounds_equal_single_merges(own):
    """Where rounds are taken, they give what merging one pair at a time gives."""
    r, taken = random.Random(7), 0
    for _ in range(300):
        symbols = [own.symbols[c] for c in "".join(r.choice(["th", "e", "in", "g", "▁", "an", "d", "a", "aa"]) for _ in range(r.randint(1, 30)))]
        done, serial = own.merge(np.array(symbols), np.zeros(len(symbols), np.int64))
        if not serial:
            taken += 1
            assert done[0].tolist() == own.merge_one_by_one(symbols)
    assert taken > 100


def test_decoding_of_any_ids(library, own):
    r = random.Random(8)
    for _ in range(3000):
        ids = [r.choice([r.randrange(3, 259), r.randrange(library.vocab_size()), 29871, 1, 2, 0]) for _ in range(r.randint(0, 8))]
        assert own.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids), ids


def test_words_are_kept_in_bounds(own, monkeypatch):
    monkeypatch.setattr(pieces, "CACHE_WORDS", 50)
    first = own.encode([f"word{i} of many" for i in range(40)])
    own.encode([f"other{i}" for i in range(40)])
    assert len(own.words) <= 90 and own.encode([f"word{i} of many" for i in range(40)]) == first


def test_query_equals_the_library(spark, library):
    rows = [(None, "no id"), (1, None), (2, ""), (3, "same"), (3, "same"), *((r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect())]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("n_tokens", "ids", "decoded", "ids_sha256")})
    want = []
    for doc_id, text in rows:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        want.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    order = lambda rows: sorted(map(tuple, rows), key=str)
    got = pieces.digests(docs)
    assert got.dtypes == [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    assert order(got.collect()) == order(want)
    assert order(queries.op12_sentencepiece(spark, DATA).collect()) == order(want[5:])
    whole = {(r.doc_id, bytes(r.ids), r.decoded) for r in pieces.encode_documents(docs).collect()}
    assert {(r[0], r[2]) for r in want} == {(i, hashlib.sha256(x).hexdigest()) for i, x, _ in whole}
    assert pieces.digests(docs.limit(0)).collect() == []
