"""Neighbours and running sums of one source in order of time, over shards, so that no task holds a whole source.

The rows of a source are cut into stretches of time. What a stretch must know of those before and after it (their
last or first row, or a sum) is one small row per stretch: it is computed by an aggregate, passed along the stretches
of the source, and added to each stretch as a row of its own before the window runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

WEEK = 604_800

#: Columns that are added, and dropped again by ``bare``.
SHARD, ROW, SIDE, PREV, NEXT = "__ol_shard", "__ol_row", "__ol_side", "__ol_prev", "__ol_next"


def shard_of(df: DataFrame, time: str, shard: int) -> Column:
    """The stretch of a time: numbers are seconds; a key that is neither a number nor a time is one stretch."""
    kind = df.schema[time].dataType
    t = F.col(f"`{time}`")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.floor(F.unix_seconds(t.cast("timestamp")) / shard)
    if isinstance(kind, T.NumericType):
        return F.floor(t.cast("double") / shard)
    return F.lit(0).cast("long")


def neighbours(df: DataFrame, source: str, order: list[str], take: list[str], *, shard: int = WEEK, ahead: bool = False) -> DataFrame:
    """``df`` with ``PREV`` (and ``NEXT`` with ``ahead``): structs of ``order`` and ``take`` of the row before and after.

    They are null where there is none. Rows go by ``order``, nulls first; a null source is a source. Rows that are
    equal in ``order`` are taken in any order. ``SHARD`` stays for ``running``.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in dict.fromkeys([*order, *take])])
    base = df.withColumn(SHARD, shard_of(df, order[0], shard)).withColumn(ROW, row).withColumn(SIDE, F.lit(0))
    ends = base.groupBy(source, SHARD).agg(F.max(ROW).alias("__ol_hi"), F.min(ROW).alias("__ol_lo"))
    along = W.partitionBy(source).orderBy(SHARD)  # a row per stretch
    halo = [ends.select(source, SHARD, F.lag("__ol_hi").over(along).alias(ROW), F.lit(-1).alias(SIDE))]
    if ahead:
        halo.append(ends.select(source, SHARD, F.lead("__ol_lo").over(along).alias(ROW), F.lit(1).alias(SIDE)))
    for h in halo:
        base = base.unionByName(h.filter(F.col(ROW).isNotNull()), allowMissingColumns=True)
    within = W.partitionBy(source, SHARD).orderBy(SIDE, *order)
    out = base.withColumn(PREV, F.lag(ROW).over(within))
    if ahead:
        out = out.withColumn(NEXT, F.lead(ROW).over(within))
    return out.filter(F.col(SIDE) == 0).drop(ROW, SIDE)


def running(df: DataFrame, source: str, order: list[str], value: str, name: str, *, shard: int = WEEK) -> DataFrame:
    """``df`` with ``name``, the sum of ``value`` over the rows of the source up to this one."""
    base = df if SHARD in df.columns else df.withColumn(SHARD, shard_of(df, order[0], shard))
    sums = base.groupBy(source, SHARD).agg(F.sum(value).alias(value))
    before = W.partitionBy(source).orderBy(SHARD).rowsBetween(W.unboundedPreceding, -1)
    carried = sums.select(source, SHARD, F.sum(value).over(before).cast(base.schema[value].dataType).alias(value)).filter(F.col(value).isNotNull())
    both = base.withColumn(SIDE, F.lit(0)).unionByName(carried.withColumn(SIDE, F.lit(-1)), allowMissingColumns=True)
    up_to = W.partitionBy(source, SHARD).orderBy(SIDE, *order).rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn(name, F.sum(value).over(up_to)).filter(F.col(SIDE) == 0).drop(SIDE)


def bare(df: DataFrame) -> DataFrame:
    return df.drop(SHARD, PREV, NEXT)
