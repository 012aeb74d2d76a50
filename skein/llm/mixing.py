"""Temperature mixing of sources, realised as budgeted block permutations.

Shares of the sources' tokens are raised to an exponent and normalised. The exponent is bisected: the largest one
whose weights reach the target entropy and repeat no source over ``max_repeats`` times (at 1 sources keep
their shares, at 0 all weigh alike). Entropies come from the driver for up to ``FEW_SOURCES`` sources, beyond that from one aggregation a step;
weights are columns of the table of sources, which is never collected whole. The budget is one full pass over the source that is wanted least beyond
its share, so that every document appears at least once; a source that weighs more is
repeated in whole epochs and one part epoch, each in its own hashed order.

A source's stream of tokens is spread evenly over ``blocks`` blocks, so that every block holds the target mixture.
The running token count of a document within its source and epoch takes two levels: sums of hash buckets (a small
table), then a window inside each bucket, so that a source with a third of all rows is dealt over as many tasks as
it has buckets. Token counts are words (one per match of the word pattern).

Defined results: a null source is a source of its own; a null or empty text has no token and appears once; a null
doc_id is kept; equal rows share one place and appear equally often; one source or an empty table is left as it is; columns of ``docs`` are kept by ``mix``.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.llm.common import WORD, materialize, scratch, spare

#: Target entropy as a share of the largest possible one.
ENTROPY = 0.9
MAX_REPEATS = 4.0
BLOCKS = 64
#: Cuts of sources into blocks that are sent to every task; more of them are joined.
MOST_CUTS = 1_000_000
#: Sources whose token counts the driver holds at most.
FEW_SOURCES = 100_000
#: Rows that one bucket of a source holds on average.
BUCKET_ROWS = 1000


def tempered(tokens: list[float], exponent: float) -> list[float]:
    """Normalised powers of the token shares."""
    total = sum(tokens)
    powers = [(t / total) ** exponent for t in tokens]
    return [x / sum(powers) for x in powers]


def entropy(weights: list[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w > 0)


def repeats(tokens: list[float], weights: list[float]) -> list[float]:
    """Passes over each source when the least repeated source is passed once."""
    total = sum(tokens)
    ratio = [w * total / t for w, t in zip(weights, tokens, strict=True)]
    return [r / min(ratio) for r in ratio]


def bisect(holds: Callable[[float], bool]) -> float:
    """Where ``holds`` turns false between 0 and 1; it holds at the low end."""
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if holds(mid) else (low, mid)
    return low


def solve_exponent(tokens: list[float], target: float = ENTROPY, max_repeats: float = MAX_REPEATS) -> float:
    """Largest exponent in [0, 1] that reaches the entropy, raised where the repetition limit asks for it."""
    return _exponent(len(tokens), min(tokens, default=1), max(tokens, default=1), lambda a: entropy(tempered(tokens, a)), target, max_repeats)


def _exponent(n: int, least: float, most: float, entropy_at: Callable[[float], float], target: float, max_repeats: float) -> float:
    if n < 2:
        return 1.0
    wanted = target * math.log(n)
    by_entropy = 1.0 if entropy_at(1.0) >= wanted else bisect(lambda a: entropy_at(a) >= wanted)
    passes = lambda a: (most / least) ** (1 - a)  # of the source that weighs most beyond its share
    return by_entropy if passes(by_entropy) <= max_repeats else bisect(lambda a: passes(a) > max_repeats) + 2**-50


def n_tokens():
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def row_key():
    return F.xxhash64("doc_id", "source", F.md5(F.coalesce("text", F.lit(""))))


def row_order(epoch, key, seed: int):
    """Place of a row in the permutation of an epoch: 53 bits of hash."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), epoch, key), 11)


def source_weights(rows: DataFrame, target: float = ENTROPY, max_repeats: float = MAX_REPEATS, few: int = FEW_SOURCES) -> DataFrame:
    """source, rows, tokens, weight and passes of every source of counted ``rows``."""
    sized = materialize(rows.groupBy("source").agg(F.count("*").alias("rows"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")))
    real = sized.filter("tokens > 0")
    n, total, least, most = real.agg(F.count("*"), F.sum("tokens"), F.min("tokens"), F.max("tokens")).first()
    share = F.col("tokens") / F.lit(float(total or 1))
    if n <= few:
        tokens = sorted(float(r.tokens) for r in real.select("tokens").collect())
        entropy_at = lambda a: entropy(tempered(tokens, a))
    else:

        def entropy_at(a: float) -> float:
            z, weighed = real.agg(F.sum(share**a), F.sum(share**a * F.log(share))).first()
            return math.log(z) - a * weighed / z

    a = _exponent(n, float(least or 1), float(most or 1), entropy_at, target, max_repeats)
    powers = real.agg(F.sum(share**a)).first()[0] or 1.0
    has = F.col("tokens") > 0
    weight = F.when(has, share**a / F.lit(powers)).otherwise(0.0)
    passes = F.when(has, (F.lit(float(most or 1)) / F.col("tokens")) ** (1 - a)).otherwise(1.0)
    return materialize(sized.select("source", "rows", "tokens", weight.alias("weight"), passes.alias("passes")))


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """``df`` with a broadcast hint if it has few rows."""
    return F.broadcast(df) if df.count() <= most else df


def schedule(docs: DataFrame, target: float = ENTROPY, max_repeats: float = MAX_REPEATS, blocks: int = BLOCKS, seed: int = 5) -> DataFrame:
    """doc_id, source, tokens, weight, epoch, block and position of each appearance of each row.

    ``position`` orders the rows of a block; ``place`` is the place in the permutation of the epoch.
    """
    rows = materialize(docs.select("doc_id", "source", row_key().alias("key"), n_tokens().alias("tokens")))
    sized = source_weights(rows, target, max_repeats)
    sized = small(sized.select(F.col("source").alias("s"), "weight", "passes", F.col("tokens").alias("source_tokens"), F.ceil(F.col("rows") / BUCKET_ROWS).alias("buckets")))
    rows = rows.join(sized, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    epochs = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil("passes") - 1, F.lit(0)).cast("int"))))
    placed = epochs.withColumn("place", row_order(F.col("epoch"), F.col("key"), seed))
    placed = placed.withColumn("bucket", F.floor(F.col("place") / F.lit(float(1 << 53)) * F.col("buckets")).cast("int"))
    group = ["source", "epoch", "bucket"]
    sums = materialize(placed.groupBy(*group).agg(F.sum("tokens").alias("sum")))
    before = F.coalesce(F.sum("sum").over(Window.partitionBy("source", "epoch").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select(F.col("source").alias("s"), F.col("epoch").alias("e"), F.col("bucket").alias("b"), before.alias("before"))
    inside = F.sum("tokens").over(Window.partitionBy(*group).orderBy("place", "key").rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens")
    run = placed.withColumn("inside", inside)
    run = run.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("epoch") == F.col("e")) & (F.col("bucket") == F.col("b")))
    whole = F.col("passes") * F.col("source_tokens")
    run = run.withColumn("at", F.col("epoch") * F.col("source_tokens") + F.col("before") + F.col("inside"))
    run = run.filter((F.col("epoch") == 0) | (F.col("at") < whole))
    block = F.least(F.floor(F.col("at") / F.greatest(whole, F.lit(1.0)) * blocks), F.lit(blocks - 1)).cast("int")
    return run.select("doc_id", "source", "tokens", "weight", "epoch", block.alias("block"), F.xxhash64(F.lit(seed + 1), "key", "epoch").alias("position"), "place")


def mix(docs: DataFrame, target: float = ENTROPY, max_repeats: float = MAX_REPEATS, blocks: int = BLOCKS, seed: int = 5) -> DataFrame:
    """``docs`` with every row as often as its source's weight asks for, in the order of the blocks and of their permutations; rows with equal keys go together.

    A block ends at one place of a source's permutation, so that the small table of sources and blocks tells each row how often and in which
    blocks it appears. Texts are shuffled once, into ranges of (block, position): the files of the result follow each other in that order.
    """
    with scratch(docs.sparkSession):
        cuts = materialize(schedule(docs, target, max_repeats, blocks, seed).groupBy("source", "epoch", "block").agg(F.min("place").alias("first"), F.max("place").alias("end")), stay=True)
    of, last, place, starts, copy, block, position, key = (spare(docs, x) for x in ("of", "last", "place", "starts", "copy", "block", "position", "key"))
    ends = cuts.groupBy(F.col("source").alias(of)).agg(F.max("epoch").alias(last), F.max(F.struct("epoch", "end"))["end"].alias(place), F.collect_list(F.struct("epoch", "block", "first")).alias(starts))
    joined = docs.withColumn(key, row_key()).join(small(ends, MOST_CUTS // blocks), F.col("source").eqNullSafe(F.col(of)))
    again = (row_order(F.col(last), F.col(key), seed) <= F.col(place)).cast("int")
    each = joined.withColumn(copy, F.explode(F.sequence(F.lit(0), F.greatest(F.col(last) + again, F.lit(1)) - 1)))
    begun = F.filter(starts, lambda x: (x.epoch == F.col(copy)) & (x.first <= row_order(F.col(copy), F.col(key), seed)))
    placed = each.withColumns({block: F.coalesce(F.array_max(F.transform(begun, lambda x: x.block)), F.lit(0)), position: F.xxhash64(F.lit(seed + 1), F.col(key), F.col(copy))})
    return placed.drop(starts).repartitionByRange(block, position).sortWithinPartitions(block, position).select(*docs.columns)
