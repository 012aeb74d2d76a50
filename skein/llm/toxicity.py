"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context-window scores.

The lexicon is learnt from labelled rows: words that far more toxic than other texts hold, and stems (written
with a final ~) of which toxic texts hold several words. Its trie is
intersected with the Levenshtein automaton (insertions, deletions, substitutions, swaps of neighbours); the product is
made deterministic as words ask for it, so that a word costs one table step per character and most words end
in the dead state after a few. Longer terms allow more edits. Every hit is then seen in its window of words:
quotation marks around it and reporting words tell quotation from abuse, words of address tell abuse.
A logistic regression on these counts gives the score.

The lexicon counts run in Spark over about ``train_docs`` labelled rows chosen by hash (a documented bound). A term enters the lexicon
when at least ``LEAST`` toxic texts hold it and the likelihood ratio against chance is above ``SURE``, however few of all toxic texts that
is; no number of terms is set. Scoring is one Arrow pass over all rows without a shuffle.

Defined results: a null or empty text scores as a text without words; without labelled rows of both classes
there is no lexicon and every score is the regression's intercept alone (on the side of the one class, and drawn towards 0.5 where rows are few; 0 without labels); quotation marks are looked for
within 80 characters of a hit; equal rows get equal results; an empty table
gives an empty result; columns that share a name with a result are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.common import bounded_rows, map_batches, materialize, text_slices

TRAIN_DOCS = 20_000
WINDOW = 5
#: Toxic texts that hold a term of the lexicon at least, its log odds, and its likelihood ratio (G squared; 25 is a chance of 6 in ten million).
LEAST, ODDS, SURE = 4, 2.5, 25.0
_WORD = re.compile(r"[^\W_]+(?:[*@$][^\W_]+)*")
_OPEN, _CLOSE = re.compile(r"[\"“„«][^\"”“»]*$"), re.compile(r"^[^\"“„«]*[\"”“»]")

# Words that report speech and words of address, in the languages of the corpus.
REPORTING = frozenset("said says wrote writes called calls quoted quote term word dit écrit appelé mot sagte schrieb nannte wort dijo escribió llamó palabra".split())
ADDRESS = frozenset("you your yours u tu toi vous votre du dich dir ihr euch tú usted vosotros eres are es bist".split())


def allowed_edits(term: str) -> int:
    return 0 if len(term) < 5 or term.endswith("~") else 1 if len(term) < 9 else 2


class TrieAutomaton:
    """The Levenshtein automaton over a lexicon trie, made deterministic on demand.

    A set of (node, edits, owed character) stands for all readings of a prefix; an owed character ends a swap.
    """

    MOST_STATES = 100_000

    def __init__(self, terms: Iterable[str], edits: list[int] | None = None):
        self.terms = list(terms)
        self.allowed = edits or [allowed_edits(t) for t in self.terms]
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[int] = [-1]
        self.stems: dict[int, int] = {}
        self.room: list[int] = [0]
        for i, term in enumerate(self.terms):
            at, edits = 0, self.allowed[i]
            self.room[0] = max(self.room[0], edits)
            for c in term.removesuffix("~"):
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(-1)
                    self.room.append(0)
                at = self.children[at][c]
                self.room[at] = max(self.room[at], edits)
            if term.endswith("~"):
                self.stems[at] = i
            else:
                self.ends[at] = i
        self._reset()

    def _reset(self) -> None:
        self.ids: dict[frozenset, int] = {frozenset(): 0}
        self.sets: list[frozenset] = [frozenset()]
        self.accepts: list[tuple[int, int] | None] = [None]
        self.steps: list[dict[str, int]] = [{}]
        self.stem_of: list[int] = [-1]
        self.start = self._state({(0, 0, "")})

    def _state(self, readings: set[tuple[int, int, str]]) -> int:
        todo, least = list(readings), {}
        while todo:  # deletions read nothing; only the cheapest reading of a place counts
            node, e, owed = todo.pop()
            if e > self.room[node] or least.get((node, owed), 9) <= e:
                continue
            least[node, owed] = e
            if not owed:
                todo.extend((child, e + 1, "") for child in self.children[node].values())
        key = frozenset((n, e, o) for (n, o), e in least.items())
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            found = [(e, self.ends[n]) for n, e, o in key if not o and self.ends[n] >= 0 and e <= self.allowed[self.ends[n]]]
            self.accepts.append(min(found) if found else None)
            self.stem_of.append(max((self.stems.get(n, -1) for n, e, o in key if not e and not o), default=-1))
        return self.ids[key]

    def _step(self, state: int, c: str) -> int:
        out = set()
        for node, e, owed in self.sets[state]:
            if owed:
                if c == owed:
                    out.add((node, e, ""))
                continue
            out.add((node, e + 1, ""))
            for x, child in self.children[node].items():
                out.add((child, e + (x != c), ""))
                if x != c and (after := self.children[child].get(c)) is not None:
                    out.add((after, e + 1, x))
        self.steps[state][c] = to = self._state(out)
        return to

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, term) of the nearest term within reach of ``word``."""
        if len(self.sets) > self.MOST_STATES:
            self._reset()
        state, steps, stem = self.start, self.steps, -1
        for c in word:
            to = steps[state].get(c)
            state = self._step(state, c) if to is None else to
            if not state:
                break
            stem = max(stem, self.stem_of[state])
        return self.accepts[state] or ((0, stem) if stem >= 0 else None)


@dataclass
class Model:
    terms: list[str]
    odds: list[float]
    edits: list[int]
    weights: np.ndarray


class Scorer:
    """Features of texts; one per task."""

    CACHE = 400_000
    N = 13

    def __init__(self, terms: list[str], odds: list[float], edits: list[int]):
        self.automaton, self.odds = TrieAutomaton(terms, edits), odds
        self.known: dict[str, tuple[int, int] | None] = {}

    def hits(self, text: str) -> tuple[int, list[tuple[str, int, int, int, bool, bool, bool]]]:
        """Number of words, and (term, edits, start, end, quoted, reported, addressed) of every hit."""
        # words are lowered one by one: lowering may change a text's length, and places are those of the text
        words, known = [w.lower() for w in _WORD.findall(text)], self.known
        if len(known) > self.CACHE:
            known.clear()
        distinct = set(words)
        for w in distinct.difference(known):
            known[w] = self.automaton.match(w)
        bad = {w for w in distinct if known[w] is not None}
        found = []
        if bad:
            for i, m in enumerate(_WORD.finditer(text)):
                if words[i] in bad:
                    edits, term = known[words[i]]
                    near = words[max(0, i - WINDOW) : i] + words[i + 1 : i + 1 + WINDOW]
                    quoted = bool(_OPEN.search(text, max(0, m.start() - 80), m.start()) and _CLOSE.search(text[m.end() : m.end() + 80]))
                    found.append((self.automaton.terms[term], edits, m.start(), m.end(), quoted, not REPORTING.isdisjoint(near), not ADDRESS.isdisjoint(near), self.odds[term]))
        return len(words), found

    def features(self, text: str | None) -> list[float]:
        n, found = self.hits(text or "")
        stems = [text[h[2] : h[3]].lower() for h in found if h[0].endswith("~")]
        found = [h for h in found if not h[0].endswith("~")]
        exact, fuzzy, far = (sum(h[1] == k for h in found) for k in (0, 1, 2))
        plain = sum(not h[4] for h in found)
        return [1.0, float(exact > 0), math.log1p(exact), math.log1p(fuzzy), math.log1p(far), math.log1p(plain), math.log1p(sum(h[4] for h in found)), math.log1p(sum(h[5] for h in found)), math.log1p(sum(h[6] for h in found)), len(found) / (n + 20.0) * 10, max([h[7] / (1 + h[1]) for h in found], default=0.0), math.log1p(len(stems)), float(len(set(stems)) > 1)]


def learn_lexicon(rows: DataFrame) -> tuple[list[str], list[float]]:
    """Terms of (text, toxic) ``rows`` with their log odds, copies of a text counted once."""
    once = rows.groupBy(F.md5(F.coalesce("text", F.lit(""))).alias("h")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))
    once = materialize(once)
    n = once.agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("n")).first()
    if not n.p or not n.n:
        return [], []
    words = once.select("h", "toxic", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]{2,}+)"), F.lit(1)))).alias("word"))
    stems = words.select("h", "toxic", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(4), F.lit(8)), lambda k: F.substring("word", F.lit(1), k)))).alias("word"))
    stems = stems.filter(F.length("word") > 3).groupBy("h", "toxic", "word").count().filter("count > 1")
    odds = F.log((F.col("p") + 0.5) / (n.p + 1)) - F.log((F.col("n") + 0.5) / (n.n + 1))
    rate, both = n.p / (n.p + n.n), F.col("p") + F.col("n")
    part = lambda seen, share: F.when(F.col(seen) > 0, F.col(seen) * F.log(F.col(seen) / (both * share))).otherwise(0.0)
    ratio = 2 * (part("p", rate) + part("n", 1 - rate))

    def best(rows: DataFrame) -> list:
        counts = rows.groupBy("word").agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("n")).withColumn("odds", odds)
        sure = (F.col("p") >= LEAST) & (F.col("odds") >= ODDS) & (ratio >= SURE)
        return counts.filter(sure).orderBy(F.desc(F.col("odds") * F.col("p")), "word").collect()

    terms, values, roots = [], [], []
    for r in best(words):
        terms.append(r.word)
        values.append(r.odds)
    for r in best(stems):
        if not any(r.word.startswith(x) or x.startswith(r.word) for x in [*roots, *terms]):
            roots.append(r.word)
            values.append(r.odds)
    return [*terms, *(f"{x}~" for x in roots)], values


def misspelt(x: np.ndarray) -> np.ndarray:
    """Features that rows with exact hits would have if every term were misspelt by one edit."""
    twin = x[x[:, 1] > 0].copy()
    twin[:, 3] = np.log1p(np.expm1(twin[:, 2]) + np.expm1(twin[:, 3]))
    twin[:, 1:3] = 0
    twin[:, 10] /= 2
    return twin


def edit_budgets(rows: DataFrame, terms: list[str], odds: list[float], most: float = 0.001) -> list[int]:
    """Edits that each term allows: none where texts that aren't toxic hold its near spellings."""
    edits = [allowed_edits(t) for t in terms]
    clean = rows.filter("toxic = 0").select(F.lit(None).cast("long").alias("doc_id"), "text")
    near = spans(clean, Model(terms, odds, edits, np.zeros(0))).filter("edits > 0").groupBy("term").count().collect() if terms else []
    limit = most * clean.count()
    common = {r.term for r in near if r["count"] > limit}
    return [0 if t in common else e for t, e in zip(terms, edits, strict=True)]


#: Where the weights are drawn to: hits in quotation marks or near reporting words speak less for abuse.
PRIOR = np.array([0, 0, 0, 0, 0, 0, -1.5, -0.5, 0, 0, 0, 0, 0])


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps, with toxic rows also in misspelt form."""
    twins = misspelt(x[y > 0])
    x, y = np.concatenate([x, twins]), np.concatenate([y, np.ones(len(twins))])
    w = PRIOR.copy()
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (q * (1 - q))) @ x + ridge * np.eye(len(w)), x.T @ (q - y) + ridge * (w - PRIOR))
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _features(docs: DataFrame, terms: list[str], odds: list[float], edits: list[int], keep: list[str]) -> DataFrame:
    rows = docs.select(*keep, "text")
    out = T.StructType([*rows.schema.fields[:-1], T.StructField("x", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(terms, odds, edits)
        for batch in batches:
            for part in text_slices(batch, "text"):
                x = [scorer.features(t) for t in part.column(part.num_columns - 1).to_pylist()]
                yield pa.record_batch([*part.columns[:-1], pa.array(x, pa.list_(pa.float64()))], out.names)

    return map_batches(rows, run, out)


def train(rows: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """Lexicon and weights from (doc_id, text, toxic) ``rows``."""
    rows = rows.filter(F.col("toxic").isin(0, 1)).select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"))
    rows = materialize(bounded_rows(rows, train_docs, "doc_id"))
    terms, odds = learn_lexicon(rows)
    edits = edit_budgets(rows, terms, odds)
    got = _features(rows, terms, odds, edits, ["doc_id", "toxic"]).orderBy("doc_id").collect()
    if not got:
        return Model([], [], [], np.r_[-30.0, np.zeros(Scorer.N - 1)])
    return Model(terms, odds, edits, fit(np.array([r.x for r in got]), np.array([float(r.toxic) for r in got])))


def score(docs: DataFrame, model: Model, *keep: Column) -> DataFrame:
    """doc_id, the columns ``keep``, score and predicted of every row."""
    rows = docs.select("doc_id", *keep, "text")
    out = T.StructType([*rows.schema.fields[:-1], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.terms, model.odds, model.edits)
        for batch in batches:
            for part in text_slices(batch, "text"):
                x = np.array([scorer.features(t) for t in part.column(part.num_columns - 1).to_pylist()]).reshape(-1, Scorer.N)
                q = 1 / (1 + np.exp(-np.clip(x @ model.weights, -30, 30)))
                yield pa.record_batch([*part.columns[:-1], pa.array(q), pa.array((q >= 0.5).astype(np.int32))], out.names)

    return map_batches(rows, run, out)


def spans(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, term, edits, start, end, quoted, reported and addressed of every hit (code points)."""
    ids = docs.select("doc_id", "text")
    fields = [("term", T.StringType()), ("edits", T.IntegerType()), ("start", T.LongType()), ("end", T.LongType()), ("quoted", T.BooleanType()), ("reported", T.BooleanType()), ("addressed", T.BooleanType())]
    out = T.StructType([ids.schema["doc_id"], *(T.StructField(*f) for f in fields)])
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.terms, model.odds, model.edits)
        for batch in batches:
            for part in text_slices(batch, "text"):
                rows = [(i, *h[:7]) for i, t in enumerate(part.column(1).to_pylist()) for h in scorer.hits(t or "")[1]]
                row, *columns = zip(*rows, strict=True) if rows else [()] * 8
                yield pa.record_batch([part.column(0).take(pa.array(row, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], out.names)

    return map_batches(ids, run, out)
