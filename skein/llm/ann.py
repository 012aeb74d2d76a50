"""Approximate nearest neighbours by largest inner product: a hierarchical k-means tree, best-bin-first.

The tree is fitted on about ``sample`` vectors chosen by hash (a documented bound); every row descends to its leaf. A
query walks the tree through a priority queue: the node whose centre has the largest inner product comes first, with what its spread
lets hope for (on unit vectors this is the order of distances), and a leaf is visited when it is popped. How many leaves to visit is calibrated: bounded many of the given queries
are searched exactly against all rows, in blocks, and visits widen until their recall reaches
the target; if need be until all leaves are visited, where the search is exact.

Equal vectors are one candidate with its k + 1 smallest ids, which is all that k results can hold, and equal
queries are searched once: a vector that a third of all rows share costs one row. The tree has a leaf for 2,000 vectors, up to a
sixteenth of the sample (3,125); beyond six million vectors leaves grow, and with them the blocks that a visit compares. Leaves meet their queries in blocks of
bounded size on both sides, so that neither a full leaf nor a favoured one ends up in one task.

Defined results: vectors that are null, zero, of another length than most, or that hold null or non-finite components take no part;
a null id takes no part; repeated ids are candidates each; fewer candidates than k give fewer results; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.llm.common import bounded_rows, map_batches, materialize

K = 20
SAMPLE = 50_000
RECALL = 0.93
CALIBRATION = 200
BRANCH = 16
#: Vectors and queries that one block holds on average.
BLOCK = 8192
#: Query vectors that one task walks.
WALK = 256


class KMeansTree:
    """Centres of a tree; ``children`` of a node, empty for a leaf; ``leaf`` numbers the leaves."""

    def __init__(self, x: np.ndarray, leaves: int, branch: int = BRANCH, seed: int = 3):
        self.rng, self.branch = np.random.default_rng(seed), branch
        self.centres, self.children, self.spread = [x.mean(0)], [[]], [((x - x.mean(0)) ** 2).sum(1).mean()]
        self._split(0, x, max(1.0, len(x) / leaves))
        self.leaf = {n: i for i, n in enumerate(k for k, c in enumerate(self.children) if not c)}
        self.centres = np.array(self.centres)
        self.spread = np.array(self.spread) / (2 * max(math.sqrt((x**2).sum(1).mean()), 1e-300))

    def _split(self, node: int, x: np.ndarray, size: float) -> None:
        k = min(self.branch, math.ceil(len(x) / size))
        if len(x) <= 1.5 * size or k < 2:
            return
        centres = x[self.rng.choice(len(x), k, replace=False)]
        for _ in range(10):
            near = self._nearest(x, centres)
            centres = np.array([x[near == j].mean(0) if (near == j).any() else centres[j] for j in range(k)])
        near = self._nearest(x, centres)
        parts = [x[near == j] for j in range(k) if (near == j).any()]
        if len(parts) < 2:
            return
        for part in parts:
            self.children[node].append(len(self.centres))
            self.centres.append(part.mean(0))
            self.spread.append(((part - self.centres[-1]) ** 2).sum(1).mean())
            self.children.append([])
        for child, part in zip(list(self.children[node]), parts, strict=True):
            self._split(child, part, size)

    @staticmethod
    def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
        return ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row."""
        out, todo = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node in self.leaf:
                out[rows] = self.leaf[node]
            elif len(rows):
                near = self._nearest(x[rows], self.centres[self.children[node]])
                todo += [(c, rows[near == j]) for j, c in enumerate(self.children[node])]
        return out

    def visits(self, queries: np.ndarray, most: int) -> list[list[int]]:
        """The first ``most`` leaves of each query, best bin first."""
        out = []
        for q in queries:
            score = -(self.centres @ q + math.sqrt(q @ q) * self.spread)
            heap, seen = [(score[0], 0)], []
            while heap and len(seen) < most:
                _, node = heapq.heappop(heap)
                if node in self.leaf:
                    seen.append(self.leaf[node])
                for c in self.children[node]:
                    heapq.heappush(heap, (score[c], c))
            out.append(seen)
        return out


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of the rows that take part."""
    x = F.col("embedding")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False))).select("vec_id", x.cast("array<double>").alias("embedding"))
    common = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("embedding") == (common.n if common else 0))


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def distinct_vectors(rows: DataFrame, most: int) -> DataFrame:
    """embedding and ids (the ``most`` smallest) of every distinct vector; first is the smallest id."""
    ranked = rows.withColumn("n", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))).filter(F.col("n") <= most)
    return ranked.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("first", F.col("ids")[0])


def _with_leaf(vectors: DataFrame, tree: KMeansTree) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(batch.schema.get_field_index("embedding")))
                yield pa.record_batch([*batch.columns, pa.array(tree.assign(x), pa.int64())], [*batch.schema.names, "leaf"])

    return map_batches(vectors, run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema) + ", leaf long")


def best(q: np.ndarray, v: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns and scores of the k largest inner products of each row of ``q``, ties to the smaller id.

    The products choose with some room for their rounding; the final scores are summed in one order for every pair, and they decide.
    """
    rough = q @ v.T
    k = min(k, len(v))
    edge = -np.partition(-rough, k - 1, 1)[:, k - 1]
    edge -= 1e-12 * np.sqrt((q**2).sum(1) * (v**2).sum(1).max())
    columns, scores = np.empty((len(q), k), np.int64), np.empty((len(q), k))
    for i, row in enumerate(rough):
        at = np.flatnonzero(row >= edge[i])
        fine = (q[i] * v[at]).sum(1)
        order = np.lexsort((ids[at], -fine))[:k]
        columns[i], scores[i] = at[order], fine[order]
    return columns, scores


def exact_best(vectors: DataFrame, queries: np.ndarray, k: int) -> DataFrame:
    """query (row number), leaf, first and score of each query's k best vectors, by blocks against all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty((len(queries), 0)), np.empty((len(queries), 0), np.int64), np.empty((len(queries), 0), np.int64)]
        for batch in batches:
            if not batch.num_rows:
                continue
            x, first, leaf = matrix(batch.column(0)), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            at, score = best(queries, x, first, k)
            new = [score, first[at], leaf[at]]
            held = [np.concatenate(p, 1) for p in zip(held, new, strict=True)]
            order = np.argsort(-held[0], 1, "stable")[:, :k]
            held = [np.take_along_axis(h, order, 1) for h in held]
        n = held[0].shape[1]
        yield pa.record_batch([pa.array(np.repeat(np.arange(len(queries)), n)), pa.array(held[2].ravel()), pa.array(held[1].ravel()), pa.array(held[0].ravel())], ["query", "leaf", "first", "score"])

    found = map_batches(vectors.select("embedding", "first", "leaf"), run, "query long, leaf long, first long, score double")
    return found.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "first"))).filter(F.col("n") <= k)


def calibrate(tree: KMeansTree, vectors: DataFrame, queries: np.ndarray, k: int, recall: float) -> int:
    """Leaves to visit so that the mean recall over ``queries`` reaches ``recall``."""
    leaves = len(tree.leaf)
    if not len(queries):
        return leaves
    order = [{leaf: i + 1 for i, leaf in enumerate(v)} for v in tree.visits(queries, leaves)]
    true = exact_best(vectors, queries, k).select("query", "leaf").collect()
    need, total = np.array([order[r["query"]][r["leaf"]] for r in true]), len(true)
    reached = np.cumsum(np.bincount(need, minlength=leaves + 1)) / max(total, 1)
    return max(1, int(np.argmax(reached >= recall)))


def search(vectors: DataFrame, is_query: Column, k: int = K, recall: float = RECALL, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest found of every row that ``is_query`` holds for."""
    rows = materialize(usable(vectors))
    plain = materialize(distinct_vectors(rows, k + 1))
    n = plain.count()
    picked = bounded_rows(plain.select("embedding", "first"), sample, "first").orderBy("first").collect()
    x = np.array([r.embedding for r in picked]) if picked else np.zeros((1, 1))
    leaves = int(max(1, min(max(256, n / 2_000), len(x) / 16, n / 8)))
    tree = KMeansTree(x, leaves)
    placed = materialize(_with_leaf(plain, tree))
    asked = rows.filter(is_query).withColumnRenamed("vec_id", "query_id")
    asked = materialize(asked.groupBy("embedding").agg(F.min("query_id").alias("rep")).join(asked, "embedding"))
    once = asked.filter("query_id = rep").dropDuplicates(["rep"]).select("rep", "embedding")
    trial = np.array([r.embedding for r in bounded_rows(once, CALIBRATION, "rep", seed=29).collect()])
    most = calibrate(tree, placed, trial, k, recall)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                seen = tree.visits(matrix(part.column(1)), most)
                row = np.repeat(np.arange(part.num_rows), [len(s) for s in seen])
                yield pa.record_batch([part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)), pa.array(np.concatenate(seen).astype(np.int64))], ["rep", "embedding", "leaf"])

    once = materialize(once)
    dealt = once.repartition(max(1, -(-once.count() // WALK)))  # small rows, large work: not by size
    walked = materialize(map_batches(dealt, walk, "rep long, embedding array<double>, leaf long"))
    # blocks of both sides, by counts of the leaves
    parts = lambda df, name: df.groupBy("leaf").agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    blocks = materialize(parts(placed, "v").join(parts(walked, "q"), "leaf"))
    salt = lambda key, of: F.pmod(F.xxhash64(key), F.col(of)).cast("int")
    left = walked.join(blocks, "leaf").select("rep", "embedding", "leaf", salt("rep", "q").alias("sq"), F.explode(F.sequence(F.lit(0), F.col("v") - 1)).alias("sv"))
    right = placed.join(blocks, "leaf").select("first", "embedding", "leaf", salt("first", "v").alias("sv"), F.explode(F.sequence(F.lit(0), F.col("q") - 1)).alias("sq"))

    def meet(queries: pa.Table, against: pa.Table) -> pa.Table:
        if not queries.num_rows or not against.num_rows:
            return pa.table({"rep": pa.array([], pa.int64()), "first": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        q, v = (matrix(t["embedding"].combine_chunks()) for t in (queries, against))
        first, rep = against["first"].to_numpy(), queries["rep"].to_numpy()
        got = []
        for at in range(0, len(q), 256):
            cols, score = best(q[at : at + 256], v, first, k + 1)
            got.append((np.repeat(rep[at : at + 256], cols.shape[1]), first[cols].ravel(), score.ravel()))
        return pa.table({n: np.concatenate(c) for n, c in zip(("rep", "first", "score"), zip(*got, strict=True), strict=True)})

    keys = ["leaf", "sv", "sq"]
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "rep long, first long, score double")
    top = met.withColumn("n", F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("score"), "first"))).filter(F.col("n") <= k + 1)
    named = materialize(top.select("rep", "first", "score").join(placed.select("first", "ids"), "first"))
    # per query vector the k + 1 best ids, then every query leaves out its own
    ids = named.select("rep", "score", F.explode("ids").alias("vec_id"))
    ids = ids.withColumn("n", F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("score"), "vec_id"))).filter(F.col("n") <= k + 1)
    listed = materialize(ids.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score"))).alias("found")))
    own = asked.select("query_id", "rep").join(listed, "rep")
    others = F.slice(F.filter("found", lambda f: f["vec_id"] != F.col("query_id")), 1, k)
    return own.select("query_id", F.posexplode(others).alias("pos", "f")).select("query_id", (F.col("pos") + 1).alias("rank"), "f.vec_id", "f.score")
