"""Ordered scans inside a key that stay balanced when one key dominates the input.

A running window puts a whole key into one task. Here a key is cut into consecutive buckets of
its order, on one or more levels from coarse to fine: the sums of the finest buckets are combined
map-side, the coarsest are scanned per key, every finer level inside one bucket of the level above,
and the rows inside one bucket of the finest. Each scan starts from a head row that carries the
state before it. Every key takes the same path, NULLs are a bucket of their own that comes first,
and no join or broadcast is involved: the input is read twice, once for its sums.

A window holds at most one coarse bucket per key, one finer bucket per coarse one, or the rows of
one finest bucket.

Running sums count the rows of every key first, combined map-side. While no key has more than
``WHOLE`` rows, each is scanned as it is: one shuffle of the rows instead of several.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.functions.ordering import CREATION, Order, sort_columns

_HEAD = "_head"
#: Positions of one topic partition that share the finest bucket of :func:`creation_buckets`.
OFFSETS = 65_536
#: Rows of a key that one task scans; with a larger key in the input, all are cut into buckets.
WHOLE = 131_072


def creation_buckets() -> list[Column]:
    """Minutes, then the full creation order with offsets in ranges; both rise along it.

    A key that has a single event time (a backfill, a coarse clock) is still cut by position.
    """
    *times_and_partition, offset = (c for c, _ in CREATION)
    return [
        F.date_trunc("minute", "event_time"),
        F.struct(*times_and_partition, F.floor(F.col(offset) / OFFSETS).alias("range")),
    ]


def _names(levels: int) -> list[str]:
    return [f"_bucket{i}" for i in range(levels)]


def _scan(within: Sequence[str], order: Sequence[Column]):
    return Window.partitionBy(*within).orderBy(F.col(_HEAD).desc(), *order)


def _with_heads(rows: DataFrame, heads: DataFrame) -> DataFrame:
    return rows.withColumn(_HEAD, F.lit(False)).unionByName(
        heads.withColumn(_HEAD, F.lit(True)), allowMissingColumns=True
    )


def _whole_sums(rows: DataFrame, key: str, order: Order, sums: dict[str, Column], totals: dict[str, str]) -> DataFrame:
    """:func:`running_sums` of keys that fit a task: one shuffle of the rows as they are, one sort, one window."""
    staged = rows.repartition(key).select("*", *(F.coalesce(value, F.lit(0)).alias(name) for name, value in sums.items()))
    scan = Window.partitionBy(key).orderBy(*sort_columns(order))
    sofar = scan.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    all_of = scan.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return staged.select(
        *rows.columns,
        *(F.sum(n).over(sofar).alias(n) for n in sums),
        *(F.sum(s).over(all_of).alias(o) for o, s in totals.items()),
    )


def running_sums(
    rows: DataFrame,
    key: str,
    buckets: Sequence[Column],
    order: Order,
    sums: dict[str, Column],
    totals: dict[str, str] | None = None,
    whole: int = WHOLE,
) -> DataFrame:
    """Add inclusive running sums per ``key``.

    No bucket may decrease along ``order``, NULLs first. ``totals`` maps extra output columns to
    the sum (a name in ``sums``) whose whole-key total they hold. Keys of more than ``whole`` rows
    are looked for at once, by a job that reads the key column only.
    """
    totals, levels = totals or {}, _names(len(buckets))
    if rows.groupBy(key).count().filter(F.col("count") > whole).isEmpty():
        return _whole_sums(rows, key, order, sums, totals)
    staged = rows.select(
        "*",
        *(b.alias(name) for name, b in zip(levels, buckets, strict=True)),
        *(F.coalesce(value, F.lit(0)).alias(name) for name, value in sums.items()),
    )
    finest = staged.groupBy(key, *levels).agg(*(F.sum(n).alias(n) for n in sums))
    per_level = [finest]
    for depth in range(len(levels) - 1, 0, -1):
        per_level.insert(0, per_level[0].groupBy(key, *levels[:depth]).agg(*(F.sum(n).alias(n) for n in sums)))
    heads = None
    for depth, level in enumerate(per_level):
        outer, own = [key, *levels[:depth]], levels[depth]
        if heads is None:
            level = level.withColumn(_HEAD, F.lit(False))
            level = level.withColumns({o: F.sum(s).over(Window.partitionBy(key)) for o, s in totals.items()})
        else:
            level = _with_heads(level, heads)
        scan = _scan(outer, [F.col(own).asc_nulls_first()])
        before = scan.rowsBetween(Window.unboundedPreceding, -1)
        heads = level.select(
            *outer,
            own,
            _HEAD,
            *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in sums),
            *(F.first(o, ignorenulls=True).over(Window.partitionBy(*outer)).alias(o) for o in totals),
        )
        heads = heads.filter(~F.col(_HEAD)).drop(_HEAD)
    scan = _scan([key, *levels], sort_columns(order))
    inclusive = scan.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    scanned = _with_heads(staged, heads).select(
        *rows.columns,
        _HEAD,
        *(F.sum(n).over(inclusive).alias(n) for n in sums),
        *(F.first(o).over(inclusive).alias(o) for o in totals),
    )
    return scanned.filter(~F.col(_HEAD)).drop(_HEAD)


def previous_value(
    rows: DataFrame, key: str, buckets: Sequence[Column], order: Order, value: str, name: str
) -> DataFrame:
    """Add ``name``: ``value`` of the preceding row of the key under ``order`` (all ascending)."""
    levels = _names(len(buckets))
    staged = rows.select("*", *(b.alias(n) for n, b in zip(levels, buckets, strict=True)))
    rank = [F.col(c).alias(f"_{i}") for i, (c, _) in enumerate(order)]
    last = F.max(F.struct(*rank, F.col(value).alias("value"))).alias("_last")
    per_level = [staged.groupBy(key, *levels).agg(last)]
    for depth in range(len(levels) - 1, 0, -1):
        per_level.insert(0, per_level[0].groupBy(key, *levels[:depth]).agg(F.max("_last").alias("_last")))
    heads = None
    for depth, level in enumerate(per_level):
        outer, own = [key, *levels[:depth]], levels[depth]
        level = level.select(*outer, own, F.col("_last.value").alias(value))
        level = level.withColumn(_HEAD, F.lit(False)) if heads is None else _with_heads(level, heads)
        before = F.lag(value).over(_scan(outer, [F.col(own).asc_nulls_first()]))
        heads = level.select(*outer, own, _HEAD, before.alias(value)).filter(~F.col(_HEAD)).drop(_HEAD)
    scanned = _with_heads(staged, heads).select(
        *rows.columns, _HEAD, F.lag(value).over(_scan([key, *levels], sort_columns(order))).alias(name)
    )
    return scanned.filter(~F.col(_HEAD)).drop(_HEAD)
