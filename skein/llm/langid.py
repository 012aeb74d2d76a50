"""Language identification by a bidirectional gated recurrent network over bytes.

The network labels every byte of a text; a document gets the mean of its bytes' probabilities. It is
trained in numpy by backpropagation through time on the driver, on about ``train_docs`` documents chosen by
hash, as many of each language as it has up to an equal share (a rare language gives all it has), ``SEGMENTS`` segments each: a documented bound that no other step has. Texts are
cut into segments of ``SEGMENT`` bytes at whose ends the state starts anew, so that thousands of segments
advance together and a text of any length costs memory for its bytes alone; every byte of every text is labelled.

Defined results: a null text or one without a letter is ``und`` with score 0; without training rows every
text is; equal rows get equal results; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.common import byte_texts, map_batches, text_slices

HIDDEN = 10
SEGMENT = 128
SEGMENTS = 2
TRAIN_DOCS = 2000
#: Languages whose counts are broadcast at most.
MOST_LANGS = 10_000
EPOCHS = 5
BATCH = 256
RATE = 0.02
#: Segments that advance together when texts are labelled.
WIDTH = 2048
_LETTER = regex.compile(r"\p{L}")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def segments_of(text: bytes) -> np.ndarray:
    """The bytes as rows of SEGMENT symbols; 256 fills the last row."""
    n = -(-len(text) // SEGMENT)
    out = np.full(n * SEGMENT, 256, np.int16)
    out[: len(text)] = np.frombuffer(text, np.uint8)
    return out.reshape(n, SEGMENT)


class ByteGRU:
    """Weights of both directions: x (3H, 257) per symbol, u (3H, H), and the output layer v, c."""

    def __init__(self, classes: int, hidden: int = HIDDEN, seed: int = 7):
        rng, self.h = np.random.default_rng(seed), hidden
        f = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
        self.p = {"x0": f(3 * hidden, 257), "u0": f(3 * hidden, hidden), "x1": f(3 * hidden, 257), "u1": f(3 * hidden, hidden), "v": f(classes, 2 * hidden), "c": np.zeros((classes, 1), np.float32)}

    def states(self, symbols: np.ndarray, d: int, tape: list | None = None) -> np.ndarray:
        """(time, H, rows): the states of direction ``d`` after each symbol; (time, rows) symbols."""
        h, x, u = self.h, self.p[f"x{d}"], self.p[f"u{d}"]
        steps, rows = symbols.shape
        out, state = np.empty((steps, h, rows), np.float32), np.zeros((h, rows), np.float32)
        padded = (symbols == 256).any(1)
        for t in range(steps) if not d else range(steps - 1, -1, -1):
            gate, add = x.take(symbols[t], axis=1), u @ state
            zr = _sigmoid(gate[: 2 * h] + add[: 2 * h])
            z, r = zr[:h], zr[h:]
            n = np.tanh(gate[2 * h :] + r * add[2 * h :])
            new = n + z * (state - n)
            keep = None
            if padded[t]:
                keep = (symbols[t] != 256).astype(np.float32)
                new *= keep
            if tape is not None:
                tape.append((t, state, z, r, n, add[2 * h :], keep))
            out[t] = state = new
        return out

    def position_probabilities(self, symbols: np.ndarray) -> np.ndarray:
        """(time, classes, rows)."""
        both = np.concatenate([self.states(symbols, 0), self.states(symbols, 1)], axis=1)
        return self.softmax(np.matmul(self.p["v"], both) + self.p["c"])

    @staticmethod
    def softmax(x: np.ndarray) -> np.ndarray:
        x -= x.max(1, keepdims=True)
        np.exp(x, out=x)
        x /= x.sum(1, keepdims=True)
        return x

    def gradients(self, symbols: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over all positions and its gradients, back through time in both directions."""
        p, h = self.p, self.h
        tapes: list[list] = [[], []]
        both = np.concatenate([self.states(symbols, d, tapes[d]) for d in (0, 1)], axis=1)
        q = self.softmax(np.matmul(p["v"], both) + p["c"])
        real = (symbols != 256).astype(np.float32)
        total, rows = real.sum(), np.arange(len(label))
        loss = -(np.log(q[:, label, rows] + 1e-9) * real).sum() / total
        q[:, label, rows] -= 1
        q *= real[:, None, :] / total
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["v"], g["c"] = np.einsum("tkb,thb->kh", q, both, optimize=True), q.sum((0, 2))[:, None]
        back = np.matmul(p["v"].T, q)
        for d in (0, 1):
            u, dh, gx = p[f"u{d}"], np.zeros_like(back[0, :h]), g[f"x{d}"].T.copy()
            for t, before, z, r, n, un, keep in reversed(tapes[d]):
                dh = dh + back[t, d * h : (d + 1) * h]
                if keep is not None:
                    dh = dh * keep
                dn = dh * (1 - z) * (1 - n * n)
                dz = dh * (before - n) * z * (1 - z)
                dr = dn * un * r * (1 - r)
                da = np.concatenate([dz, dr, dn * r])
                g[f"u{d}"] += da @ before.T
                np.add.at(gx, symbols[t], np.concatenate([dz, dr, dn]).T)
                dh = dh * z + u.T @ da
            g[f"x{d}"] = gx.T
        return float(loss), g

    def fit(self, rows: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, batch: int = BATCH, rate: float = RATE, seed: int = 11) -> ByteGRU:
        """Adam over shuffled batches of segments, with a falling rate."""
        rng, step = np.random.default_rng(seed), 0
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        last = epochs * -(-len(rows) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for i in range(0, len(order), batch):
                at = order[i : i + batch]
                _, g = self.gradients(np.ascontiguousarray(rows[at].T), labels[at])
                norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
                step += 1
                now = rate * (1 - 0.95 * step / last)
                for k, x in g.items():
                    x = x * min(1.0, 1.0 / max(norm, 1e-9))
                    m[k] = 0.9 * m[k] + 0.1 * x
                    v[k] = 0.99 * v[k] + 0.01 * x * x
                    self.p[k] -= now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        return self

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """(texts, classes): mean probability over the bytes of each text."""
        parts = [segments_of(t) for t in texts]
        owner = np.repeat(np.arange(len(texts)), [len(x) for x in parts])
        sums = np.zeros((len(texts), len(self.p["c"])))
        rows = np.concatenate(parts) if parts else np.empty((0, SEGMENT), np.int16)
        full = rows[:, -1] != 256
        for pick in (np.flatnonzero(full), np.flatnonzero(~full)):
            for i in range(0, len(pick), WIDTH):
                at = pick[i : i + WIDTH]
                symbols = np.ascontiguousarray(rows[at].T)
                real = symbols != 256
                steps = int(real.any(1).sum())
                q = self.position_probabilities(symbols[:steps])
                np.add.at(sums, owner[at], np.einsum("tkb,tb->bk", q, real[:steps].astype(np.float32)))
        return sums / np.maximum([len(t) for t in texts], 1)[:, None]


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS, hidden: int = HIDDEN, epochs: int = EPOCHS) -> tuple[list[str], ByteGRU | None]:
    """Languages and network learnt from the text and non-null lang of ``docs``."""
    rows = docs.filter(F.col("lang").isNotNull() & (F.length("text") > 0)).select("doc_id", "lang", "text")
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))
    share = F.lit(train_docs / max(counts.count(), 1)) / F.col("n")
    # a share of the hash space for each language: every task filters for itself
    picks = F.shiftrightunsigned(F.xxhash64(F.lit(17), "doc_id"), 11) < (F.least(share, F.lit(1.0)) * F.lit(float(1 << 53))).cast("long")
    rows = rows.join(F.broadcast(counts) if counts.count() <= MOST_LANGS else counts, "lang").filter(picks).withColumn("key", F.xxhash64("text"))
    cut = [F.substring(F.col("text"), F.pmod(F.xxhash64("key", F.lit(i)), F.length("text")).cast("int") + 1, F.lit(SEGMENT)) for i in range(SEGMENTS)]
    picked = rows.select("lang", F.array(*cut).alias("cut")).orderBy("lang", "cut").collect()
    langs = sorted({r.lang for r in picked})
    if not langs:
        return [], None
    parts = [(segments_of(c.encode())[:1], langs.index(r.lang)) for r in picked for c in r.cut]
    symbols, labels = np.concatenate([x for x, _ in parts]), np.array([k for _, k in parts])
    most = max(np.bincount(labels))
    again = np.concatenate([np.resize(np.flatnonzero(labels == k), most) for k in range(len(langs))])  # languages weigh alike
    return langs, ByteGRU(len(langs), hidden).fit(symbols[again], labels[again], epochs)


def identify(docs: DataFrame, langs: list[str], net: ByteGRU | None, *keep: Column) -> DataFrame:
    """doc_id, the columns ``keep``, lang_pred and score of every row."""
    ids = docs.select("doc_id", *keep, "text")
    out = T.StructType([*ids.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                texts = byte_texts(part, "text")
                said = [i for i, t in enumerate(texts) if net is not None and t and _LETTER.search(t.decode())]
                names, scores = ["und"] * len(texts), np.zeros(len(texts))
                if said:
                    mean = net.documents([texts[i] for i in said])
                    best = mean.argmax(1)
                    scores[said] = np.clip(mean.max(1), 0, 1)
                    for i, k in zip(said, best.tolist(), strict=True):
                        names[i] = langs[k]
                yield pa.record_batch([*part.columns[:-1], pa.array(names), pa.array(scores)], out.names)

    return map_batches(ids, run, out)
