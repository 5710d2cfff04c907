"""Time series of counters and readings: deltas with restarts, islands, ranges, scales and marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontoloom.operators.shards import PREV, bare, neighbours, running


def counter_delta(df: DataFrame, *, source: str, time: str, counter: str, uptime: str, tie: str) -> DataFrame:
    """``df`` with ``delta``: the counter's growth since the reading before, or the whole counter after a restart.

    A restart lies between two readings if the one before is older than this one's uptime. The first reading of a
    source has no delta. ``tie`` orders readings of one time. Null counters count as 0. A source is spread over
    its weeks, as in all functions of this module.
    """
    rows = neighbours(df, source, [time, tie], [counter])
    now, before = F.coalesce(F.col(counter), F.lit(0)), F.coalesce(F.col(PREV)[counter], F.lit(0))
    prev = F.col(PREV)[time]
    return bare(rows.withColumn("delta", F.when(prev.isNull(), None).when(prev < F.col(time) - F.col(uptime), now).otherwise(now - before)))


def _changes(same: list[str]) -> Column:
    out = F.lit(False)
    for c in same:
        out |= ~F.col(c).eqNullSafe(F.col(PREV)[c])
    return out


def islands(df: DataFrame, *, source: str, time: str, gap: int, same: list[str] | None = None, tie: str | None = None) -> DataFrame:
    """Stretches without a gap over ``gap`` seconds and without a change of the columns ``same``.

    One row per stretch: source, the columns of ``same``, ``start``, ``stop``, ``n``. Nulls in ``same`` are equal.
    """
    same, order = same or [], [time, *([tie] if tie else [])]
    rows = neighbours(df, source, order, same)
    prev = F.col(PREV)[time]
    flag = F.when(prev.isNull() | (F.col(time) - prev > gap) | _changes(same), 1).otherwise(0)
    return (
        running(rows.withColumn("__flag", flag.cast("long")), source, order, "__flag", "__island")
        .groupBy(source, "__island", *same)
        .agg(F.min(time).alias("start"), F.max(time).alias("stop"), F.count("*").alias("n"))
        .drop("__island")
    )


def breaks(df: DataFrame, *, source: str, time: str, gap: int, tie: str) -> DataFrame:
    """Down-times: ``source, from_time, to_time`` where two readings are more than ``gap`` apart."""
    rows = neighbours(df.select(source, time, tie), source, [time, tie], [])
    return rows.select(source, F.col(PREV)[time].alias("from_time"), F.col(time).alias("to_time")).filter(F.col("to_time") - F.col("from_time") > gap)


def recent(df: DataFrame, time: str, length: Column | int) -> DataFrame:
    """Rows of the last ``length`` before the latest time of the table; nulls are left out."""
    last = df.agg(F.max(time).alias("__last"))
    return df.join(F.broadcast(last), F.col(time) >= F.col("__last") - length).drop("__last")  # one row


def first_valid(df: DataFrame, *, source: str, time: str, value: str, missing: float) -> DataFrame:
    """First value of each source that is neither null, NaN nor ``missing``; a null time is never first, ties take the least value."""
    v = F.col(value)
    return df.filter(F.col(time).isNotNull() & v.isNotNull() & ~F.isnan(v) & (v != missing)).groupBy(source).agg(F.min(F.struct(time, value)).alias("__m")).select(source, F.col("__m")[time].alias(time), F.col("__m")[value].alias(value))


def nice_max(x: Column) -> Column:
    """A round upper end of an axis: a power of ten, halved where half is enough; 1 for nothing above 0."""
    top = F.pow(F.lit(10.0), F.ceil(F.log10(x)))
    return F.when(x > 0, F.when(x < top / 2, top / 2).otherwise(top)).otherwise(F.lit(1.0))


def day_marks(df: DataFrame, time: str) -> DataFrame:
    """Each day between the first and last time with whether it is a weekend."""
    ends = df.agg(F.min(F.to_date(time)).alias("a"), F.max(F.to_date(time)).alias("b")).filter("a is not null")
    return ends.select(F.explode(F.sequence("a", "b")).alias("day")).withColumn("weekend", F.dayofweek("day").isin(1, 7))


def compress(df: DataFrame, *, source: str, time: str, same: list[str], tie: str) -> DataFrame:
    """First rows of stretches in which the columns of ``same`` do not change."""
    rows = neighbours(df, source, [time, tie], same)
    return bare(rows.filter(F.col(PREV).isNull() | _changes(same)))
