"""SimHash near-duplicate detection by deletion-variant signatures.

A 64-bit fingerprint is cut into two segments of 32 bits. When two fingerprints differ in at most three
bits, one of the segments differs in at most one bit, so the two share a signature made of that segment
with one bit wildcarded. Every distinct fingerprint is indexed under its 2 x 32 signatures, an equality
shuffle on the signature brings candidates together, and the Hamming distance verifies them.

Groups stay small by construction: exact copies collapse to one fingerprint before the index, a bucket
gives a spanning forest instead of its pairs, and a bucket of over ``BUCKET`` fingerprints is indexed once
more by signatures of its other segment (two halves of 16 bits, one wildcard), after which at most 2**18
fingerprints can share a bucket.

``deduplicate`` links texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more. Two sets that much
alike differ in about 15 of 100 fingerprint bits, so that its fingerprints are longer: as many segments of log2(texts) + 6 bits as give a pair at 0.8 a chance of 0.99 to have one that differs by at most one
bit; nearer pairs have more. The segments' one-wildcard variants bring candidates together. Texts that meet no near one there leave the
variant (64 bits tell, with a wide margin), so that what goes on follows the near copies and not the chance meetings, which grow faster than the texts. All bits thin the rest out, the exact
similarity of the two texts decides. A variant holds at most two segment values, which are found in groups of half a segment
(bounded by the number of its values, not of texts). Every two texts that share a variant are compared unless they are linked already.

Defined results: a null text, an empty text or one of white space alone has no word and fingerprint zero, and such texts are copies of each other;
a null doc_id keeps its row (component_id is then the smallest doc_id that is reachable, null if none);
repeated rows keep one row each in ``near_duplicates``, one of them stays in ``deduplicate``; an empty table gives an empty
result; further columns are ignored or kept.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from skein.llm.common import byte_texts, map_batches, materialize, scratch, spare, text_slices

DISTANCE = 3
SHINGLE = 3
SEED = 42
#: Fingerprints that one bucket compares directly.
BUCKET = 4096
#: Shingle hashes whose bits are counted at a time.
BLOCK = 1 << 15
#: Words of a shingle, least similarity, and chance of finding a pair just there, of ``deduplicate``.
WIDE_SHINGLE, SIMILARITY, FOUND = 5, 0.8, 0.99
#: Deviations of the bits that a pair differs in, above their number at the least similarity, beyond which it isn't compared.
MARGIN = 3
#: The same for the 64 bits by which a bucket keeps its texts, and texts of a bucket that are compared so; larger buckets keep all.
THIN_MARGIN, HELD = 4, 256
#: Rows that are broadcast at most (16 bytes each), the factor by which hubs of a bucket grow with each round, and hubs that a task holds at most.
FEW, HUBS, MOST_HUBS = 1_000_000, 8, 4096


def simhash_bytes(text: bytes | None, shingle: int = SHINGLE) -> bytes:
    """The fingerprint of one text as eight bytes, most significant first."""
    words = (text or b"").lower().split()
    n = len(words)
    if not n:
        return bytes(8)
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    if n <= shingle:
        hashes = [digest(joined, SEED)]
    else:
        lengths = np.fromiter(map(len, words), np.int64, n)
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths)[: n - shingle + 1].tolist()
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)]
    votes = np.zeros(64, np.int64)
    for i in range(0, len(hashes), BLOCK):
        bits = np.frombuffer(b"".join(hashes[i : i + BLOCK]), np.uint8)
        votes += np.unpackbits(bits).reshape(-1, 64).sum(0, dtype=np.int32)
    return np.packbits(2 * votes > len(hashes)).tobytes()


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The columns of ``docs`` before its text, and fp (the 64 bits as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                fps = b"".join(simhash_bytes(t, shingle) for t in byte_texts(part, "text"))
                yield pa.record_batch([*part.columns[:-1], pa.array(np.frombuffer(fps, ">i8").astype(np.int64))], out.names)

    ids = docs.select(*(c for c in docs.columns if c != "text"), "text")
    out = T.StructType([*ids.schema.fields[:-1], T.StructField("fp", T.LongType())])
    return map_batches(ids, run, out)


def forest(fps: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (root, member) of the links among distinct fingerprints."""
    roots, members = [], []
    rest = np.sort(fps)
    while len(rest) > 1:
        root, queue, rest = rest[0], [rest[:1]], rest[1:]
        while queue and len(rest):
            for x in queue.pop():
                near = np.bitwise_count(rest ^ x) <= distance
                if near.any():
                    new = rest[near]
                    roots.append(np.full(len(new), root))
                    members.append(new)
                    queue.append(new)
                    rest = rest[~near]
                if not len(rest):
                    break
    if not roots:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return np.concatenate(roots), np.concatenate(members)


def _bucket_links(most: int | None):
    """Links of the sorted buckets of a partition; buckets over ``most`` come back as rows of kind 1."""

    def pairs(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
        sizes = np.diff(np.r_[at, len(keys)])
        two = at[sizes == 2]
        near = np.bitwise_count(fps[two] ^ fps[two + 1]) <= DISTANCE
        a, b = [fps[two][near]], [fps[two + 1][near]]
        for i, n in zip(at[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            r, m = forest(fps[i : i + n])
            a.append(r)
            b.append(m)
        return np.concatenate(a), np.concatenate(b)

    def rows(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(np.full(len(a), kind, np.int32)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["kind", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps, hot = np.empty(0, np.int64), np.empty(0, np.uint64), None
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while (p := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[p]
            return x

        def new_links(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            """Only links that join what this partition has not joined yet."""
            keep = np.zeros(len(a), bool)
            for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
                if (x := find(x)) != (y := find(y)):
                    parent[max(x, y)], keep[i] = min(x, y), True
            return rows(0, a[keep], b[keep])

        for batch in batches:
            k = batch.column(0).to_numpy()
            f = batch.column(1).to_numpy().view(np.uint64)
            if hot is not None:  # the rest of a bucket that is known to be large
                n = int(np.searchsorted(k, hot, "right"))
                yield rows(1, k[:n].view(np.uint64), f[:n])
                k, f = k[n:], f[n:]
                if not len(k):
                    continue
                hot = None
            keys, fps = np.concatenate([keys, k]), np.concatenate([fps, f])
            cut = int(np.searchsorted(keys, keys[-1]))  # the last bucket may go on
            if most and len(keys) - cut > most:
                hot = keys[-1]
                yield rows(1, keys[cut:].view(np.uint64), fps[cut:])
                done, keys, fps = (keys[:cut], fps[:cut]), keys[:0], fps[:0]
            else:
                done, keys, fps = (keys[:cut], fps[:cut]), keys[cut:], fps[cut:]
            yield new_links(*pairs(*done))
        yield new_links(*pairs(keys, fps))

    return run


def _signatures(df: DataFrame) -> DataFrame:
    """64 one-wildcard signatures of each fingerprint: which segment and bit, and the other 31 bits."""
    i = F.col("i")
    segment = F.when(i < 32, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp").bitwiseAND(0xFFFFFFFF))
    wild = F.expr("~shiftleft(1L, cast(i % 32 as int))")
    key = F.shiftleft(i.cast("long"), 32).bitwiseOR(segment.bitwiseAND(wild))
    return df.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i")).select(key.alias("key"), "fp")


def _second_signatures(df: DataFrame) -> DataFrame:
    """Signatures of the other segment, inside the bucket: two halves of 16 bits with one wildcard each."""
    other = F.expr("case when shiftright(key, 32) < 32 then fp & 4294967295L else shiftrightunsigned(fp, 32) end")
    half = F.expr("case when j < 16 then shiftrightunsigned(other, 16) else other & 65535L end & ~shiftleft(1L, cast(j % 16 as int))")
    key = F.expr("shiftleft(key, 21) | shiftleft(cast(j as bigint), 16)").bitwiseOR(half)
    return df.withColumn("other", other).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(31)))).select(key.alias("key"), "fp")


def _links(signed: DataFrame, most: int | None) -> DataFrame:
    dealt = signed.repartition("key").sortWithinPartitions("key")
    return materialize(map_batches(dealt, _bucket_links(most), "kind int, a long, b long"))


def links(distinct_fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) whose components are those of all pairs at DISTANCE bits or less."""
    first = _links(_signatures(distinct_fps), bucket)
    edges = first.filter("kind = 0")
    hot = first.filter("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("fp"))
    if hot.isEmpty():
        return edges.select("a", "b").distinct()
    second = _links(_second_signatures(hot), None)
    return edges.unionByName(second).select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root (smallest node of its component) for every node that has a link.

    Alternating large-star and small-star rounds; each round is written to the shared folder, and the loop
    ends when a round changes nothing.
    """

    def summary(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def relink(pairs: DataFrame, keep: str) -> DataFrame:
        """pairs (u, v): every v (of those that ``keep`` holds for) gets the smallest neighbour of u."""
        # written, so that both sides of the join are plain shuffles and a hub's rows can be split
        least = materialize(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        return pairs.filter(keep).join(least, "u")

    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    said = summary(now)
    while said[0]:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = relink(both, "v > u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = relink(large, "true")
        small = small.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(small.select(F.col("u").alias("a"), F.col("m").alias("b")))
        now = materialize(small.filter("a <> b").distinct())
        if (then := summary(now)) == said:
            break
        said = then
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""
    prints = materialize(fingerprints(docs.select("doc_id", "text"), shingle))
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    edges = links(distinct.select("fp"), bucket)
    roots = components(edges).select(F.col("node").alias("fp"), "root")
    least = materialize(distinct.join(roots, "fp").groupBy("root").agg(F.min("first_id").alias("least_id")))
    linked = roots.join(least, "root").select("fp", "least_id")
    of = materialize(distinct.join(linked, "fp", "left").select("fp", F.coalesce("least_id", "first_id").alias("component_id")))
    return prints.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")




# near copies by similarity


def segmentation(n: int, similarity: float = SIMILARITY, found: float = FOUND) -> tuple[int, int]:
    """Bits of a segment (even) and number of segments for ``n`` texts."""
    bits = max(20, math.ceil(math.log2(max(n, 2))) + 6)
    bits += bits % 2
    differ = math.acos(2 * similarity / (1 + similarity)) / math.pi
    near = (1 - differ) ** bits + bits * differ * (1 - differ) ** (bits - 1)
    return bits, math.ceil(math.log(1 - found) / math.log(1 - near))


def shingle_set(text: bytes | None, shingle: int = WIDE_SHINGLE) -> set[bytes]:
    words = (text or b"").lower().split()
    joined, at, starts = b" ".join(words), 0, [0]
    for w in words:
        at += len(w) + 1
        starts.append(at)
    n = max(1, len(words) - shingle + 1)
    return {joined[a : b - 1] for a, b in zip(starts[:n], starts[min(shingle, len(words)) :], strict=True)} if words else {b""}


def jaccard(a: set[bytes], b: set[bytes]) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both)


@functools.cache
def multipliers(words: int) -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 1 << 63, words, np.uint64) * np.uint64(2) + np.uint64(1)


def wide_bits(texts: list[bytes | None], columns: int) -> np.ndarray:
    """(texts, columns) of zeros and ones: the long fingerprints. A shingle's XXH64 is mixed anew for each 64 bits."""
    digest, mix = xxhash.xxh64_intdigest, multipliers(-(-columns // 64))
    out = np.empty((len(texts), len(mix) * 64), np.uint8)
    for k, text in enumerate(texts):
        shingles = shingle_set(text)
        hashes = np.fromiter((digest(x, SEED) for x in shingles), np.uint64, len(shingles))
        votes = np.zeros(out.shape[1], np.int64)
        for i in range(0, len(hashes), 255):  # sums of up to 255 bits stay bytes
            x = hashes[i : i + 255, None] * mix
            x ^= x >> np.uint64(32)
            x *= mix[::-1]
            x ^= x >> np.uint64(29)
            votes += np.unpackbits(x.view(np.uint8), axis=1).sum(0, dtype=np.uint8)
        out[k] = 2 * votes > len(hashes)
    return out[:, :columns]


def wide_fingerprints(docs: DataFrame, bits: int, segments: int) -> DataFrame:
    """The columns of ``docs`` before its text, print (the bits, in longs) and segments (number and value of each, in one long)."""
    ids = docs.select(*(c for c in docs.columns if c != "text"), "text")
    out = T.StructType([*ids.schema.fields[:-1], T.StructField("print", T.ArrayType(T.LongType())), T.StructField("segments", T.ArrayType(T.LongType()))])
    weights = 1 << np.arange(bits, dtype=np.int64)
    numbers = np.arange(segments, dtype=np.int64) << bits
    words = -(-bits * segments // 64)

    def listed(x: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                found = wide_bits(byte_texts(part, "text"), 64 * words)
                prints = np.packbits(found, axis=1).view(">i8").astype(np.int64)
                values = found[:, : bits * segments].reshape(-1, segments, bits) @ weights + numbers
                yield pa.record_batch([*part.columns[:-1], listed(prints), listed(values)], out.names)

    return map_batches(ids, run, out)


def _shared_variants(values: DataFrame, bits: int) -> DataFrame:
    """(v, key): the one-wildcard variants of segment values ``v`` that two values share; the equal value is one where n > 1."""
    half = bits // 2
    ones = (1 << half) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty(0, np.int64)

        def variants(group: np.ndarray, final: bool) -> tuple[pa.RecordBatch, np.ndarray]:
            """Keys of whole half-segment groups among sorted values, and the group that may go on."""
            cut = len(group) if final else int(np.searchsorted(group, group[-1] >> half << half))
            group, rest = group[:cut], group[cut:]
            at, keys = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for i in range(half) if len(group) else ():
                to = group ^ (1 << i)
                place = np.minimum(np.searchsorted(group, to), len(group) - 1)
                mine = group[group[place] == to]
                at.append(mine)
                keys.append((mine & ~np.int64(1 << i)) << 5 | i)
            return pa.record_batch([pa.array(np.concatenate(at)), pa.array(np.concatenate(keys))], ["p", "key"]), rest

        for batch in batches:
            if batch.num_rows:
                found, held = variants(np.concatenate([held, batch.column(0).to_numpy()]), False)
                yield found
        if len(held):
            yield variants(held, True)[0]

    # each value twice: with its low half last, and with its high half last
    v = F.col("v")
    number, value = F.shiftright(v, bits), v.bitwiseAND((1 << bits) - 1)
    swapped = F.shiftleft(value.bitwiseAND(ones), half).bitwiseOR(F.shiftright(value, half))
    turned = F.shiftleft(number * 2 + F.col("turn"), bits).bitwiseOR(F.when(F.col("turn") == 0, value).otherwise(swapped))
    both = values.select("v", F.explode(F.array(F.lit(0), F.lit(1))).alias("turn")).select(turned.alias("p"))
    dealt = both.repartition(F.shiftright("p", half)).sortWithinPartitions("p")
    p = F.col("p")
    value = p.bitwiseAND((1 << bits) - 1)
    back = F.when(F.shiftright(p, bits).bitwiseAND(1) == 0, value).otherwise(F.shiftleft(value.bitwiseAND(ones), half).bitwiseOR(F.shiftright(value, half)))
    near = map_batches(dealt, run, "p long, key long").select(F.shiftleft(F.shiftright(p, bits + 1), bits).bitwiseOR(back).alias("v"), "key")
    return near.unionByName(values.filter("n > 1").select("v", (-1 - v).alias("key")))


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts are as similar; ``texts`` (t, text) may hold a text several times, and only those of pairs travel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, set()
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep = []
            for i, (left, right) in enumerate(zip(byte_texts(batch, "left"), byte_texts(batch, "right"), strict=True)):
                if a[i] != last:
                    last, held = a[i], shingle_set(left)
                if jaccard(held, shingle_set(right)) >= similarity:
                    keep.append(i)
            yield pa.record_batch([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], ["a", "b"])

    with scratch(pairs.sparkSession):
        wanted = materialize(pairs.select(F.col("a").alias("t")).unionByName(pairs.select(F.col("b").alias("t"))).distinct())
        texts = materialize(texts.join(_few(wanted), "t").groupBy("t").agg(F.first("text").alias("text")))
        # written, so that both sides of the second join are plain shuffles and the rows of a hub can be split
        right = materialize(pairs.join(texts.select(F.col("t").alias("b"), F.col("text").alias("right")), "b"))
        both = right.join(texts.select(F.col("t").alias("a"), F.col("text").alias("left")), "a").select("a", "b", "left", "right")
        return materialize(map_batches(both, run, "a long, b long"), stay=True)


def bound(bits: int, similarity: float = SIMILARITY, margin: float = MARGIN) -> int:
    """Bits of ``bits`` that a pair may differ in to be compared: ``margin`` deviations more than a pair at ``similarity`` does."""
    differ = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.ceil(bits * differ + margin * math.sqrt(bits * differ * (1 - differ)))


def _segment_rows(prints: DataFrame, bits: int, segments: int) -> DataFrame:
    """t, thin and v of every segment; ``thin`` is a word of the print half a print away from it, as texts that share a segment are near in its own bits."""
    words = -(-bits * segments // 64)
    word = F.expr(f"cast((i * {bits} div 64 + {words // 2}) % {words} as int)")
    return prints.select("t", "print", F.posexplode("segments").alias("i", "v")).select("t", F.col("print")[word].alias("thin"), "v")


def _alive(entries: DataFrame, similarity: float) -> DataFrame:
    """The (key, t) of ``entries`` (key, t, thin) that the bits ``thin`` find near another text of their bucket, and those of buckets of over HELD texts."""
    most = bound(64, similarity, THIN_MARGIN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, keys, ts, thins = None, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)

        def chosen(n: int) -> pa.RecordBatch:
            """Rows of the first ``n``, which end with a bucket or in the midst of one of over HELD rows."""
            k = keys[:n]
            starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if n else np.empty(0, np.int64)
            sizes = np.diff(np.r_[starts, n])
            whole = (sizes > HELD) | (k[starts] == last) if n else sizes > HELD
            keep = np.repeat(whole, sizes)
            for size in np.unique(sizes[~whole & (sizes > 1)]).tolist():  # buckets of a size at once, each row against the others
                at = starts[~whole & (sizes == size)][:, None] + np.arange(size)
                near = np.bitwise_count((thins[at][:, :, None] ^ thins[at][:, None, :]).view(np.uint64)) <= most
                near[:, range(size), range(size)] = False
                keep[at] = near.any(2)
            return pa.record_batch([pa.array(k[keep]), pa.array(ts[:n][keep])], ["key", "t"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, ts, thins = (np.concatenate([x, batch.column(i).to_numpy()]) for i, x in enumerate((keys, ts, thins)))
            cut = int(np.searchsorted(keys, keys[-1]))
            if len(keys) - cut > HELD:  # a bucket that stays, whatever follows
                cut = len(keys)
            yield chosen(cut)
            last = keys[-1] if cut == len(keys) else None
            keys, ts, thins = keys[cut:], ts[cut:], thins[cut:]
        yield chosen(len(keys))

    return map_batches(entries.select("key", "t", "thin").repartition("key").sortWithinPartitions("key"), run, "key long, t long")


def _met(near: DataFrame, order: list, first: int, hubs: int, most: int) -> DataFrame:
    """t, a (a hub of one of its buckets, of another label), the hub's degree and the bits in which they differ.

    Hubs of a bucket are its rows ``first`` to ``first + hubs`` in ``order``; they meet each other and all later rows. Buckets are streamed:
    a task holds the hubs of one.
    """
    rows = near.select(F.explode("keys").alias("key"), "t", "label", "degree", "print", *(c.alias(f"o{i}") for i, c in enumerate(order)))
    dealt = rows.repartition("key").sortWithinPartitions("key", *(f"o{i}" for i in range(len(order))), "t").select("key", "t", "label", "degree", "print")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, seen = None, 0
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, t, label, degree = (batch.column(i).to_numpy() for i in range(4))
            prints = batch.column(4).flatten().to_numpy().view(np.uint64).reshape(batch.num_rows, -1)
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            out: list[tuple[np.ndarray, ...]] = []
            for i, j in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows], strict=True):
                if keys[i] != key:
                    key, seen, held = keys[i], 0, []
                low, high = max(i, i + first - seen), min(j, i + first + hubs - seen)
                seen += j - i
                if low < high:  # new hubs meet those before them
                    held.append((t[low:high], label[low:high], degree[low:high], prints[low:high]))
                if not held or low >= j:
                    continue
                hub_t, hub_label, hub_degree, hub_prints = held[0] if len(held) == 1 else (np.concatenate(x) for x in zip(*held, strict=True))
                for at in range(low, j, 512):
                    some = slice(at, min(at + 512, j))
                    for h in range(len(hub_t)):
                        bits = np.bitwise_count(prints[some] ^ hub_prints[h]).sum(1)
                        near = np.flatnonzero((bits <= most) & (label[some] != hub_label[h]))
                        if len(near):
                            n = len(near)
                            out.append((t[some][near], np.full(n, hub_t[h]), np.full(n, hub_degree[h]), bits[near].astype(np.int64)))
            columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 4
            yield pa.record_batch([pa.array(c.astype(np.int64)) for c in columns], ["t", "a", "degree", "bits"])

    return map_batches(dealt, run, "t long, a long, degree long, bits long")


def similar_links(entries: DataFrame, prints: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame | None:
    """Links (a, b) that join all similar texts among ``entries`` (key, t, thin) that share a key; None without candidates.

    ``prints`` are t and print. Two texts whose long fingerprints differ in more bits than ``bound`` aren't compared.
    First every text is compared with the one that has most shared keys among its hubs (the original of a group of copies shares more than
    they do among each other), then, while that links more, with the hub of another group that its fingerprint is nearest to. At last each
    bucket of several groups compares its texts, those of small groups first and some more in every round, with the texts of all other groups,
    until those of its last group alone are left.
    """
    pair = lambda df: df.select(F.least("a", "t").alias("a"), F.greatest("a", "t").alias("b")).distinct()
    keys = _alive(entries, similarity).groupBy("t").agg(F.collect_list("key").alias("keys"))
    near = materialize(keys.join(prints.select("t", "print"), "t").select("t", "print", "keys", F.size("keys").cast("long").alias("degree"), F.col("t").alias("label"), F.lit(1).cast("long").alias("size")))
    one = near.first()
    if one is None:
        return None
    most, asked, edges = bound(64 * len(one.print), similarity), None, None

    def compared(pairs: DataFrame) -> bool:
        """Ask for the pairs that are new, and relabel the texts; whether that linked any."""
        nonlocal asked, edges, near
        pairs = materialize(pairs if asked is None else pairs.join(asked, ["a", "b"], "left_anti"))
        asked = pairs if asked is None else asked.unionByName(pairs)
        found = None if pairs.isEmpty() else _verified(pairs, texts, similarity)
        if found is None or found.isEmpty():
            return False
        edges = edges.unionByName(found) if edges else found
        roots = materialize(components(edges).withColumnsRenamed({"node": "t", "root": "r"}))
        sizes = roots.groupBy("r").agg(F.count("*").alias("n"))
        near = near.join(roots.join(sizes, "r"), "t", "left").withColumns({"label": F.coalesce("r", "label"), "size": F.coalesce("n", "size")}).drop("r", "n")
        near = materialize(near)
        return True

    def narrowed() -> int:
        """Leave the buckets of one group; of the others, the most texts that come before those of the last group by size and label."""
        nonlocal near
        rows = near.select(F.explode("keys").alias("key"), "t", "label", "size")
        counts = rows.groupBy("key", "size", "label").agg(F.count("*").alias("n"))
        rest = F.sum("n") - F.max_by("n", F.struct("size", "label"))
        several = materialize(counts.groupBy("key").agg(rest.alias("rest")).filter("rest > 0"))
        keys = rows.join(_few(several.select("key")), "key").groupBy("t").agg(F.collect_list("key").alias("keys"))
        near = materialize(near.drop("keys").join(keys, "t").select(near.columns))
        return several.agg(F.max("rest")).first()[0] or 0

    best = F.struct(F.col("degree"), F.col("a"))
    while compared(pair(_met(near, [-F.col("degree")], 0, 1, most).groupBy("t").agg(F.max(best).alias("best")).select("t", "best.a"))):
        best = F.struct(-F.col("bits"), F.col("a"))
        narrowed()
    left, first, hubs = narrowed(), 0, HUBS
    near = near.withColumns({"was": F.col("size"), "of": F.col("label")})
    while first < left:
        compared(pair(_met(near, [F.col("was"), F.col("of")], first, hubs, most)))
        first, hubs = first + hubs, min(hubs * HUBS, MOST_HUBS)
    return edges


def _few(df: DataFrame) -> DataFrame:
    """``df`` (of 16 bytes a row) with a broadcast hint if it has few rows."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def deduplicate(docs: DataFrame, shingle: int = WIDE_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each group of near copies: the one with the smallest doc_id (nulls last, ties by hash).

    Texts are read where they lie; those of candidates travel, and the keys of the rows that go.
    """
    k, t = spare(docs, "k"), spare(docs, "t")
    hashes = [F.xxhash64("doc_id", "text").alias(k), F.xxhash64(F.coalesce("text", F.lit("")), F.lit(1)).alias(t)]
    keyed = docs.select("*", *hashes)
    with scratch(docs.sparkSession):
        ids = materialize(docs.select("doc_id", hashes[0].alias("k"), hashes[1].alias("t")))
        of_text = materialize(ids.groupBy("t").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "k", "t")).alias("one")))
        bits, segments = segmentation(of_text.count(), similarity)
        prints = wide_fingerprints(docs.select(hashes[1].alias("t"), "text"), bits, segments)
        prints = materialize(prints.groupBy("t").agg(F.first("print").alias("print"), F.first("segments").alias("segments")))
        rows = _segment_rows(prints, bits, segments)
        values = materialize(rows.groupBy("v").agg(F.count("*").alias("n")))
        shared = materialize(_shared_variants(values, bits))
        entries = rows.join(shared, "v").select("key", "t", "thin")
        texts = docs.select(hashes[1].alias("t"), F.coalesce("text", F.lit("")).alias("text"))
        edges = similar_links(entries, prints, texts, similarity)
        kept = of_text.select("t", "one")
        if edges is not None:
            roots = components(edges).select(F.col("node").alias("t"), "root")
            kept = kept.join(roots, "t", "left").groupBy(F.coalesce("root", "t").alias("root")).agg(F.min("one").alias("one"))
        kept = materialize(kept.select("one.k", "one.t"))
        lost = materialize(ids.select("k", "t").join(kept, ["k", "t"], "left_anti").distinct(), stay=True)
        twice = materialize(ids.join(kept, ["k", "t"]).groupBy("k", "t").count().filter("count > 1").select("k", "t"), stay=True)
    away = _few(lost.unionByName(twice).withColumnsRenamed({"k": k, "t": t}))
    single = keyed.join(away, [k, t], "left_anti")
    if twice.isEmpty():
        return single.select(*docs.columns)
    again = keyed.join(_few(twice.withColumnsRenamed({"k": k, "t": t})), [k, t]).dropDuplicates([k, t])
    return single.unionByName(again).select(*docs.columns)
