"""Conversation prefix trie: which beginnings conversations share, and what sharing them saves.

Every conversation takes the first turns of the head of its hundred (``rebuilt`` below), then its own. A node is a distinct
sequence of first turns. It is known by a polynomial hash of its turns' digests modulo 2^127 - 1, which two stretches of a conversation
can be joined by, so that a conversation need not lie in one task.

Turns are dealt by ranges of (conv_id, turn). A task folds its range, in order, into a partial trie: a table of nodes with
members added up and, for each node, the list of the conversations that end there, already ascending; only that table leaves it. The turns at a task's start
that go on with a conversation of an earlier task stay relative to it; one line a task goes to the driver, which carries hashes from task to task, and
then these turns become nodes as well. Partial tries are merged by node in rounds of ``FAN_IN`` tasks: members are summed, the smallest one kept, lists kept as
chunks, which one stream hashes in ascending order. The rollup goes bottom-up by doubling: in round k every node hands its sum over fewer
than 2^k levels to its ancestor 2^k levels up, so that it takes as many rounds as the depth has binary digits and adds up before it shuffles.

Defined results: rows with a null conv_id belong to no conversation; null role or text is empty; equal turns of a conversation go by the digest of
role and text; repeated rows are turns of their own; a conversation without turns is a member of the root and ends there; an empty table has
no node, not even a root; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from skein.llm.common import map_batches, materialize
from skein.llm.resampling import CRC32_SQL, crc32_sql

#: Conversations that share a head, and heads' turns that one can take (fewer than this).
FAMILY, HEAD_TURNS = 100, 6
#: Partial tries that one round merges.
FAN_IN = 64
#: Nodes, and conversations in lists, that a task holds before it hands them on.
NODES_HELD, ENDS_HELD = 50_000, 200_000

MODULUS = (1 << 127) - 1
BASE = 0x5DEECE66D_9E3779B97F4A7C15_2545 % MODULUS

NODE, ENDS, OPEN, PART = range(4)
PARTIAL = "kind int, part int, key binary, parent binary, depth long, cp long, n_convs long, conv_id long, ids string"
_ARROW = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("key", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("cp", pa.int64()), ("n_convs", pa.int64()), ("conv_id", pa.int64()), ("ids", pa.string())])


def own_turns(conv_id: int) -> int:
    """How many turns a conversation takes from its head, and drops of its own."""
    return zlib.crc32(str(conv_id).encode()) % HEAD_TURNS


def _add(key: int, digest: int) -> int:
    return (key * BASE + digest) % MODULUS


def _bytes(key: int | None) -> bytes | None:
    return None if key is None else key.to_bytes(16, "big")


class PartialTrie:
    """The trie of one range of turns, fed in order."""

    def __init__(self, part: int):
        self.part, self.rows = part, []
        self.nodes: dict[int, list] = {}
        self.ends: dict[int, list[str]] = {}
        self.n_ends = 0
        #: The conversation at hand: its number, hash and depth, and turns of its own yet to drop.
        self.conv, self.key, self.depth, self.skip, self.known = None, 0, 0, 0, False
        #: Turns before the first head: how many, their hash, and the hashes after the first of them.
        self.n_open, self.open_key, self.open_first, self.open_conv = 0, 0, [], None

    def _visit(self, parent: int | None, cp: int) -> None:
        node = self.nodes.get(self.key)
        if node:
            node[3] += 1
        else:
            self.nodes[self.key] = [parent, self.depth, cp, 1, self.conv]

    def _go(self, digest: bytes, cp: int) -> None:
        parent, self.key = self.key, _add(self.key, int.from_bytes(digest, "big"))
        self.depth += 1
        self._visit(parent, cp)

    def head(self, conv_id: int, before: list[dict]) -> None:
        """Begin a conversation with the turns of its head."""
        if self.known:
            self.ends.setdefault(self.key, []).append(str(self.conv))
            self.n_ends += 1
            if len(self.nodes) >= NODES_HELD or self.n_ends >= ENDS_HELD:
                self.flush()
        self.conv, self.key, self.depth, self.known = conv_id, 0, 0, True
        self.skip = own_turns(conv_id)
        self._visit(None, 0)
        for turn in before[: self.skip]:
            self._go(turn["digest"], turn["cp"])

    def turn(self, conv_id: int, digest: bytes, cp: int) -> None:
        if not self.known:
            before, self.open_key = self.open_key, _add(self.open_key, int.from_bytes(digest, "big"))
            self.n_open += 1
            self.open_conv = conv_id
            if self.n_open < HEAD_TURNS:
                self.open_first.append(self.open_key)
            self.rows.append((OPEN, self.part, _bytes(self.open_key), _bytes(before), self.n_open, cp, 1, conv_id, None))
        elif self.skip:
            self.skip -= 1
        else:
            self._go(digest, cp)
            if len(self.nodes) >= NODES_HELD:
                self.flush()

    def flush(self) -> None:
        self.rows += [(NODE, self.part, _bytes(k), _bytes(parent), depth, cp, n, conv, None) for k, (parent, depth, cp, n, conv) in self.nodes.items()]
        self.rows += [(ENDS, self.part, _bytes(k), None, None, None, None, int(ids[0]), ",".join(ids)) for k, ids in self.ends.items()]
        self.nodes, self.ends, self.n_ends = {}, {}, 0

    def finish(self) -> None:
        self.flush()
        last = [self.conv, self.key, self.depth, self.skip] if self.known else None
        if self.n_open or last:
            self.rows.append((PART, self.part, None, None, None, None, None, None, json.dumps([self.n_open, self.open_key, self.open_first, self.open_conv, last])))

    def take(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)] if rows else [pa.array([], f.type) for f in _ARROW], schema=_ARROW)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    trie = PartialTrie(TaskContext.get().partitionId())
    for batch in batches:
        for conv_id, is_turn, digest, cp, before in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "is_turn", "digest", "cp", "before")), strict=True):
            if is_turn:
                trie.turn(conv_id, digest, cp)
            else:
                trie.head(conv_id, before or [])
        if trie.rows:
            yield trie.take()
    trie.finish()
    if trie.rows:
        yield trie.take()


def turn_digest(role: Column, text: Column) -> Column:
    """16 bytes for a turn; the length of the role keeps role and text apart."""
    return F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """A row for every conversation with its head's first turns (``before``), then a row for every turn of its own."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = materialize(conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", turn_digest(role, text).alias("digest"), F.length(text).cast("long").alias("cp")))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "digest")
    first = turns.filter(F.col("conv_id") % FAMILY == 0).withColumn("i", F.row_number().over(order)).filter(F.col("i") < HEAD_TURNS)
    heads = first.groupBy(F.col("conv_id").alias("head")).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "digest", "cp"))), lambda x: F.struct(x.digest.alias("digest"), x.cp.alias("cp"))).alias("before"))
    ids = turns.groupBy("conv_id").agg(F.lit(False).alias("is_turn")).withColumn("head", F.col("conv_id") - F.col("conv_id") % FAMILY)
    begun = ids.join(heads, "head", "left").drop("head")
    return begun.unionByName(turns.withColumn("is_turn", F.lit(True)), allowMissingColumns=True)


def partial_tries(rows: DataFrame) -> DataFrame:
    """The partial tries of ranges of conversations, written."""
    order = ["conv_id", "is_turn", F.asc_nulls_first("turn"), "digest"]
    ranged = materialize(rows).repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(map_batches(ranged.select("conv_id", "is_turn", "digest", "cp", "before"), _fold, PARTIAL))


def carry(parts: list[tuple[int, str]]) -> tuple[dict[int, tuple], list[tuple[int, int]]]:
    """What the turns at the start of each task go on with, and (conversation, last node) of those at the edges of tasks.

    ``parts`` is one line a task. A carry is the hash and depth before the task, how many of its first turns are dropped, and the relative hash after those.
    """
    carries, ends, at = {}, [], None
    for part, line in sorted(parts):
        n_open, open_key, open_first, _, last = json.loads(line)
        if n_open:
            conv, key, depth, skip = at
            dropped = min(skip, n_open)
            base = [0, *open_first][dropped]
            carries[part] = (key, depth, dropped, base)
            at = (conv, _shifted(carries[part], n_open, open_key), depth + n_open - dropped, skip - dropped)
        if last:
            if at:
                ends.append((at[0], at[1]))
            at = tuple(last)
    return carries, ends + ([(at[0], at[1])] if at else [])


def _shifted(carried: tuple, n: int, relative: int) -> int:
    """The hash after ``n`` open turns, whose hash from the task's start is ``relative``."""
    key, _, dropped, base = carried
    return (relative + (key - base) * pow(BASE, n - dropped, MODULUS)) % MODULUS


def _settle(rows: DataFrame, carries: dict[int, tuple]) -> DataFrame:
    """Nodes of the open turns. ``carries`` has one entry a task at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for part, key, parent, n, cp, conv in zip(*(batch.column(c).to_pylist() for c in ("part", "key", "parent", "depth", "cp", "conv_id")), strict=True):
                c = carries[part]
                if n > c[2]:
                    out.append((NODE, part, _bytes(_shifted(c, n, int.from_bytes(key, "big"))), _bytes(_shifted(c, n - 1, int.from_bytes(parent, "big"))), c[1] + n - c[2], cp, 1, conv, None))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _ARROW, strict=True)], schema=_ARROW)

    return map_batches(rows, run, PARTIAL)


def merge_tries(nodes: DataFrame, n_parts: int, fan_in: int = FAN_IN) -> DataFrame:
    """key, parent, depth, cp, n_convs and conv_id of every node: partial tries merged ``fan_in`` at a time."""
    while True:
        n_parts = -(-n_parts // fan_in)
        group = ["key"] + ["part"] * (n_parts > 1)
        nodes = nodes.withColumn("part", F.floor(F.col("part") / fan_in).cast("int")).groupBy(*group).agg(*(F.min(c).alias(c) for c in ("parent", "depth", "cp", "conv_id")), F.sum("n_convs").alias("n_convs"))
        if n_parts <= 1:
            return materialize(nodes)


def hash_ends(chunks: DataFrame) -> DataFrame:
    """key and ends_sha256 of the nodes where conversations end: chunks of a node follow each other by their first conversation in one stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, hashlib.sha256()
        for batch in batches:
            done = []
            for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if k == key:
                    state.update(b"," + ids.encode())
                else:
                    if key is not None:
                        done.append((key, state.hexdigest()))
                    key, state = k, hashlib.sha256(ids.encode())
            yield pa.record_batch([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], ["key", "ends_sha256"])
        if key is not None:
            yield pa.record_batch([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], ["key", "ends_sha256"])

    return map_batches(chunks.repartition("key").sortWithinPartitions("key", "conv_id").select("key", "ids"), run, "key binary, ends_sha256 string")


def roll_up(nodes: DataFrame, sums: list[str]) -> DataFrame:
    """key and ``sums`` added up over every node's subtree, its own included; ``nodes`` has key, parent, depth and ``sums``."""
    depth = nodes.agg(F.max("depth")).head()[0] or 0
    totals = nodes.select("key", *sums)
    jumps = nodes.filter(F.col("depth") >= 1).select("key", "depth", F.col("parent").alias("up"))
    span = 1
    while span <= depth:
        handed = jumps.join(totals, "key").groupBy(F.col("up").alias("key")).agg(*(F.sum(c).alias(c) for c in sums))
        totals = materialize(totals.unionByName(handed).groupBy("key").agg(*(F.sum(c).alias(c) for c in sums)))
        span *= 2
        if span <= depth:
            far = jumps.filter(F.col("depth") >= span)
            jumps = materialize(far.join(jumps.select(F.col("key").alias("up"), F.col("up").alias("further")), "up").select("key", "depth", F.col("further").alias("up")))
    return totals


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of every node."""
    spark: SparkSession = conversations.sparkSession
    partial = partial_tries(rebuilt(conversations))
    parts = [(r.part, r.ids) for r in partial.filter(F.col("kind") == PART).select("part", "ids").collect()]  # one row a task
    carries, edges = carry(parts)
    nodes = partial.filter(F.col("kind") == NODE).unionByName(_settle(partial.filter(F.col("kind") == OPEN), carries))
    tree = merge_tries(nodes, max((p for p, _ in parts), default=0) + 1)

    more = spark.createDataFrame([(bytearray(_bytes(k)), c, str(c)) for c, k in edges], "key binary, conv_id long, ids string")
    ended = hash_ends(partial.filter(F.col("kind") == ENDS).select("key", "conv_id", "ids").unionByName(more))
    children = tree.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    known = tree.join(children, "key", "left").join(ended, "key", "left")
    known = materialize(known.select("key", "parent", "depth", "conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"), F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("cp")).alias("saved_tokens")))
    sums = roll_up(known, ["n_leaves", "saved_tokens"])

    root = known.filter(F.col("depth") == 0).select("conv_id").head()
    above = known.filter((F.col("depth") >= 1) & (F.col("n_children") > 0)).select(F.col("key").alias("parent"), F.col("conv_id").alias("above"))
    parent = F.when(F.col("depth") == 1, F.lit(root[0] if root else None)).otherwise(F.col("above"))
    placed = known.drop("n_leaves", "saved_tokens").join(sums, "key")
    # Only nodes below the first level look their parent up: the root would be the parent of too many.
    deep = placed.filter(F.col("depth") > 1).join(above, "parent", "left")
    shallow = placed.filter(F.col("depth") <= 1).withColumn("above", F.lit(None).cast("long"))
    return shallow.unionByName(deep).select("conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


ORACLE_SQL = f"""
WITH {CRC32_SQL},
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (
  SELECT conv_id, md5(length(role) || ':' || role || text) AS h, length(text) AS cp,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS i FROM t),
c AS (SELECT conv_id, {crc32_sql("name")} % {HEAD_TURNS} AS taken FROM (SELECT DISTINCT conv_id, conv_id::VARCHAR AS name FROM t), crc_table),
r AS (
  SELECT c.conv_id, 0 AS own, i, h, cp FROM c JOIN o ON o.conv_id = c.conv_id - c.conv_id % {FAMILY} AND i <= taken
  UNION ALL SELECT c.conv_id, 1, i, h, cp FROM c JOIN o ON o.conv_id = c.conv_id AND i > taken),
n AS (SELECT conv_id, row_number() OVER x AS d, string_agg(h, '') OVER x AS path, cp FROM r WINDOW x AS (PARTITION BY conv_id ORDER BY own, i ROWS UNBOUNDED PRECEDING)),
p AS (SELECT * FROM n UNION ALL SELECT conv_id, 0, '', 0 FROM c),
node AS (SELECT path, d, any_value(cp) AS cp, count(*) AS n_convs, min(conv_id) AS conv_id FROM p GROUP BY path, d),
ended AS (SELECT path, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, arg_max(path, d) AS path FROM p GROUP BY conv_id) GROUP BY path),
kids AS (SELECT left(path, 32 * (d - 1)) AS path, count(*) AS n FROM node WHERE d > 0 GROUP BY 1),
f AS (SELECT node.*, coalesce(kids.n, 0) AS n_children, (n_convs - 1) * cp AS saved FROM node LEFT JOIN kids USING (path)),
s AS (SELECT left(path, 32 * k) AS path, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM (SELECT *, unnest(range(d + 1)) AS k FROM f) GROUP BY 1)
SELECT f.conv_id, f.d::BIGINT AS depth, up.conv_id AS parent_conv_id, f.n_convs::BIGINT AS n_convs, f.n_children::BIGINT AS n_children,
  s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM f JOIN s USING (path) LEFT JOIN ended USING (path) LEFT JOIN node up ON f.d > 0 AND up.path = left(f.path, 32 * (f.d - 1))
"""
