"""The prefix trie against a plain one, with conversations that lie in several tasks."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from conftest import DATA
from skein.llm import queries, trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16], (role, text)))
    own = {c: [x[3] for x in sorted(t)] for c, t in turns.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        seq = (*own.get(c - (abs(c) % 100) * (1 if c >= 0 else -1), [])[:h], *mine[h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
        ends[seq].append(c)
    children, leaves, saved = Counter(n[:-1] for n in members if n), Counter(), Counter()
    for n, m in members.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += n not in children
            saved[n[:d]] += (len(m) - 1) * len(n[-1][1]) if n else 0
    return Counter((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), children[n], leaves[n], saved[n], hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest()) for n, m in members.items())


def run(spark, rows, parts=4):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({c: F.lit("clash") for c in ("key", "part", "head", "before", "is_turn", "digest", "cp", "kind", "up", "ids")})
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = trie.prefix_trie(docs)
        assert got.dtypes == [(c, "string" if c == "ends_sha256" else "bigint") for c in COLUMNS]
        return Counter(map(tuple, got.collect()))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def edges():
    rows = [(None, 0, "user", "of no conversation"), (7, None, None, None), (7, None, "user", "null turn"), (7, 1, "user", "ü😀"), (7, 1, "user", "ü😀"), (7, 1, "a", "tie"), (-3, 0, "user", "negative"), (-103, 2, "", "x")]
    r = random.Random(3)
    for c in [*range(100, 140), *range(200, 260, 3), 305, 399]:
        rows += [(c, t, r.choice(["user", None]), r.choice(["hello", "yes", "", None])) for t in range(r.randint(1, 8))]
    return rows


@pytest.mark.parametrize("parts", [1, 9])
def test_trie_equals_a_plain_one(spark, parts, monkeypatch):
    monkeypatch.setattr(trie, "FAN_IN", 2)
    assert run(spark, edges(), parts) == plain(edges())


def test_hot_conversation_and_hot_copies(spark):
    """One conversation with a third of all turns lies in several tasks; half of the others are copies of each other."""
    rows = [(500, t, "user", f"long {t % 40}") for t in range(150)]
    rows += [(c, t, "user", f"hi {t}") for c in range(600, 640) for t in range(3)]
    rows += [(c, t, "user", f"own {c} {t}") for c in range(300, 330) for t in range(1 + c % 7)]
    want = plain(rows)
    assert run(spark, rows, 11) == want
    assert max(n[1] for n in want) > 140


def test_edges_of_tasks_cut_anywhere():
    """Folding a range of turns task by task gives the same nodes, wherever tasks end."""
    r = random.Random(11)
    stream = []
    for c in (100, 101, 102, 205):
        stream.append((c, None))
        stream += [(c, hashlib.md5(f"{c} {i}".encode()).digest()) for i in range(r.randint(0, 9))]
    before = [{"digest": hashlib.md5(f"head {i}".encode()).digest(), "cp": 1} for i in range(3)]

    def fold(cuts):
        nodes, ends, rows, parts = Counter(), [], [], []
        for p, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(stream)], strict=True)):
            t = trie.PartialTrie(p)
            for c, digest in stream[a:b]:
                t.head(c, before) if digest is None else t.turn(c, digest, 5)
            t.finish()
            rows += t.rows
        parts = [(x[1], x[8]) for x in rows if x[0] == trie.PART]
        carries, edge = trie.carry(parts)
        for kind, part, key, _, depth, _, n, _, ids in rows:
            if kind == trie.NODE:
                nodes[(key, depth)] += n
            elif kind == trie.ENDS:
                ends += [(int(c), key) for c in ids.split(",")]
            elif kind == trie.OPEN and depth > carries[part][2]:
                nodes[(trie._shifted(carries[part], depth, int.from_bytes(key, "big")).to_bytes(16, "big"), carries[part][1] + depth - carries[part][2])] += 1
        return nodes, sorted(ends + [(c, k.to_bytes(16, "big")) for c, k in edge])

    want = fold([])
    for _ in range(200):
        assert fold(sorted(r.sample(range(len(stream) + 1), r.randint(1, 6)))) == want


def test_trie_without_rows(spark):
    assert trie.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    assert trie.prefix_trie(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA)).collect() == []


def test_tables_are_handed_on_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "NODES_HELD", 3)
    monkeypatch.setattr(trie, "ENDS_HELD", 2)
    t = trie.PartialTrie(0)
    for c in range(100, 140):
        t.head(c, [])
    t.finish()
    assert sum(len(r[8].split(",")) for r in t.rows if r[0] == trie.ENDS) == 39 and max(len(r[8].split(",")) for r in t.rows if r[0] == trie.ENDS) == 2


def test_trie_sql(spark):
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW conversations AS SELECT * FROM '{DATA}/conversations.parquet'")
        want = db.sql(trie.ORACLE_SQL)
        assert Counter(map(tuple, queries.op13_prefix_trie(spark, DATA).select(*want.columns).collect())) == Counter(want.fetchall())
