"""State that folds over ordered records: what came before a record, and what holds at it.

``running_index``, ``carried`` and ``ever`` are windows over all records of a key. ``scan`` gives the same for keys too large for a task: each
block of a key (a split of a file) folds by itself and leaves a summary (records counted, last value known, whether a condition held), the
summaries, one row a block, are folded in order, and what came before a block is added to its records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def so_far(key: str, order: str) -> WindowSpec:
    """A record and those before it."""
    return Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def before(key: str, order: str) -> WindowSpec:
    return Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def running_index(takes: Column, key: str, order: str) -> Column:
    """How many records before this one take an index."""
    return F.coalesce(F.sum(takes.cast("long")).over(before(key, order)), F.lit(0))


def carried(x: Column, key: str, order: str) -> Column:
    """The last value of ``x`` that was not null, up to this record."""
    return F.last(x, ignorenulls=True).over(so_far(key, order))


def ever(condition: Column, key: str, order: str) -> Column:
    """Whether ``condition`` held at this record or before."""
    return F.coalesce(F.max(condition).over(so_far(key, order)), F.lit(False))


def scan(rows: DataFrame, key: str, block: str, order: str, counts: dict[str, Column] | None = None, latest: dict[str, Column] | None = None, held: dict[str, Column] | None = None) -> DataFrame:
    """``rows`` with a column for each entry: ``counts`` as ``running_index``, ``latest`` as ``carried``, ``held`` as ``ever``, over all blocks of a key.

    Blocks go in the order of ``block``, records inside one in that of ``order``; entries must not be windows themselves. Both sides
    of the last join lie by (key, block), so that the records are shuffled once, and the summaries are read from that shuffle, too.
    """
    counts, latest, held = counts or {}, latest or {}, held or {}
    names = [*counts, *latest, *held]
    given = rows.withColumns({f"{n}__at": (c.cast("long") if n in counts else c) for n, c in (counts | latest | held).items()})
    local = Window.partitionBy(key, block).orderBy(order)
    so_far_, before_ = local.rowsBetween(Window.unboundedPreceding, Window.currentRow), local.rowsBetween(Window.unboundedPreceding, -1)
    mine = given.withColumns(
        {n: F.coalesce(F.sum(f"{n}__at").over(before_), F.lit(0)) for n in counts}
        | {n: F.last(f"{n}__at", ignorenulls=True).over(so_far_) for n in latest}
        | {n: F.coalesce(F.max(f"{n}__at").over(so_far_), F.lit(False)) for n in held}
    )
    known = lambda n: F.col(f"{n}__at").isNotNull()
    ends = given.groupBy(key, block).agg(
        *(F.sum(f"{n}__at").alias(f"{n}__all") for n in counts),
        *(F.max_by(f"{n}__at", F.when(known(n), F.col(order))).alias(f"{n}__all") for n in latest),
        *(F.max(f"{n}__at").alias(f"{n}__all") for n in held),
    )
    earlier = Window.partitionBy(key).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    fold = {n: F.sum(f"{n}__all").over(earlier) for n in counts} | {n: F.last(f"{n}__all", ignorenulls=True).over(earlier) for n in latest} | {n: F.max(f"{n}__all").over(earlier) for n in held}
    starts = ends.select(key, block, *(c.alias(f"{n}__before") for n, c in fold.items()))
    whole = mine.join(starts, [key, block])
    both = {n: F.col(n) + F.coalesce(f"{n}__before", F.lit(0)) for n in counts} | {n: F.coalesce(n, f"{n}__before") for n in latest} | {n: F.col(n) | F.coalesce(f"{n}__before", F.lit(False)) for n in held}
    return whole.withColumns(both).drop(*(f"{n}__{x}" for n in names for x in ("at", "before")))
