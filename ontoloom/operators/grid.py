"""Irregular readings onto a regular grid.

Readings are cut into time shards per source. Each shard also receives the neighbouring readings that its
interpolation needs (the halo), so a source that holds a third of all rows is spread over as many tasks as
it has shards, and no task ever sees a whole source. Everything stays in JVM expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WEEK = 604_800


def _edge_slope(h0: Column, h1: Column, d0: Column, d1: Column) -> Column:
    """One-sided three-point slope, limited so that the curve keeps the shape of the data."""
    s = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
    return (
        F.when(d1.isNull(), d0)
        .when(F.signum(s) != F.signum(d0), F.lit(0.0))
        .when((F.signum(d0) != F.signum(d1)) & (F.abs(s) > 3 * F.abs(d0)), 3 * d0)
        .otherwise(s)
    )


def _inner_slope(h0: Column, h1: Column, d0: Column, d1: Column) -> Column:
    """Weighted harmonic mean of the two neighbouring slopes; zero at a local extremum."""
    w0, w1 = 2 * h1 + h0, h1 + 2 * h0
    return F.when(d0 * d1 <= 0, F.lit(0.0)).otherwise((w0 + w1) / (w0 / d0 + w1 / d1))


def regular_grid(
    readings: DataFrame,
    *,
    source: str = "meter",
    time: str = "time_stamp",
    value: str = "volt",
    period: int = 600,
    max_gap: int = 7200,
    not_measured: tuple[float, ...] = (-1.0,),
    time_from: int | None = None,
    time_to: int | None = None,
    shard: int = WEEK,
) -> DataFrame:
    """One row per source and period from its first to its last usable reading.

    Returns ``source, period_start, value, n_readings, status``. ``status`` is ``observed`` (``value`` is the
    mean of the readings in the period), ``interpolated`` (monotone cubic at the middle of the period, between
    two readings at most ``max_gap`` seconds apart) or ``gap`` (longer: ``value`` is null).

    Method: shape-preserving monotone cubic interpolation per source segment; a segment ends where two
    readings are more than ``max_gap`` apart. A piece between two readings needs one more reading on either
    side at most, all within ``2 * max_gap``, so each shard gets the readings of its neighbours that lie
    within that distance. Gaps over shard borders come from the first and last reading of each shard.

    Cases: a reading is usable if source, time and value are not null, the value is neither NaN nor in
    ``not_measured``, and the time lies in ``[time_from, time_to)`` where given; others are ignored. Readings
    with equal source and time count as one with their mean value, so repeated rows change nothing when equal.
    A source with one usable reading gives one row. An empty table gives no rows. Other columns, whatever
    their names, are not read.
    """
    if shard % period:
        raise ValueError("shard must be a multiple of period")
    halo = min(2 * max_gap, shard - 1)
    if 2 * max_gap >= shard:
        raise ValueError("shard must be longer than twice max_gap")
    t, v = F.col(time).cast("long"), F.col(value).cast("double")
    usable = F.col(source).isNotNull() & t.isNotNull() & v.isNotNull() & ~F.isnan(v)
    for x in not_measured:
        usable &= v != F.lit(x)
    if time_from is not None:
        usable &= t >= time_from
    if time_to is not None:
        usable &= t < time_to
    home = F.floor(F.col("t") / shard)
    base = (
        readings.filter(usable)
        .select(F.col(source).alias("s"), t.alias("t"), v.alias("v"))
        .withColumn(
            "shard",
            F.explode(
                F.filter(
                    F.array(
                        home,
                        F.when(F.pmod("t", F.lit(shard)) <= halo, home - 1),
                        F.when(shard - F.pmod("t", F.lit(shard)) <= halo, home + 1),
                    ),
                    lambda x: x.isNotNull(),
                )
            ),
        )
    )
    points = base.groupBy("s", "shard", "t").agg(F.avg("v").alias("v"), F.count("*").alias("n"))
    points = points.withColumn("own", F.floor(F.col("t") / shard) == F.col("shard"))
    near = W.partitionBy("s", "shard").orderBy("t")
    pieces = points.select(
        "s",
        "shard",
        "own",
        F.col("t").alias("t1"),
        F.col("v").alias("v1"),
        F.lag("t").over(near).alias("t0"),
        F.lag("v").over(near).alias("v0"),
        F.lead("t").over(near).alias("t2"),
        F.lead("v").over(near).alias("v2"),
        F.lead("own").over(near).alias("own2"),
        F.lead("t", 2).over(near).alias("t3"),
        F.lead("v", 2).over(near).alias("v3"),
    ).filter(F.col("own") & F.col("t2").isNotNull() & (F.col("own2") | (F.col("t2") - F.col("t1") <= max_gap)))

    first = F.floor(F.col("t1") / period) + 1
    last = F.floor(F.col("t2") / period) - 1
    pieces = pieces.filter(first <= last)
    h0, h1, h2 = F.col("t1") - F.col("t0"), F.col("t2") - F.col("t1"), F.col("t3") - F.col("t2")
    h0, h2 = F.when(h0 <= max_gap, h0), F.when(h2 <= max_gap, h2)
    d0, d1, d2 = (F.col("v1") - F.col("v0")) / h0, (F.col("v2") - F.col("v1")) / h1, (F.col("v3") - F.col("v2")) / h2
    m1 = F.when(h0.isNull(), _edge_slope(h1, h2, d1, d2)).otherwise(_inner_slope(h0, h1, d0, d1))
    m2 = F.when(h2.isNull(), _edge_slope(h1, h0, d1, d0)).otherwise(_inner_slope(h1, h2, d1, d2))
    x = (F.col("k") * period + period / 2 - F.col("t1")) / F.col("h")
    curve = (
        F.col("v1") * (1 + 2 * x) * (1 - x) * (1 - x)
        + F.col("h") * F.col("m1") * x * (1 - x) * (1 - x)
        + F.col("v2") * x * x * (3 - 2 * x)
        + F.col("h") * F.col("m2") * x * x * (x - 1)
    )
    short = F.col("h") <= max_gap
    inside = (
        pieces.select("s", "t1", "v1", "v2", h1.alias("h"), m1.alias("m1"), m2.alias("m2"), F.explode(F.sequence(first, last)).alias("k"))
        .select("s", "k", F.when(short, curve).alias("v"), F.lit(0).cast("long").alias("n"), F.when(short, "interpolated").otherwise("gap").alias("status"))
    )
    ends = points.filter("own").groupBy("s", "shard").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    by_source = W.partitionBy("s").orderBy("shard")
    a, b = F.floor(F.col("hi") / period) + 1, F.floor(F.col("lo2") / period) - 1
    across = (
        ends.withColumn("lo2", F.lead("lo").over(by_source))
        .filter((F.col("lo2") - F.col("hi") > max_gap) & (a <= b))
        .select("s", F.explode(F.sequence(a, b)).alias("k"))
        .select("s", "k", F.lit(None).cast("double").alias("v"), F.lit(0).cast("long").alias("n"), F.lit("gap").alias("status"))
    )
    seen = (
        points.filter("own")
        .groupBy("s", "shard", F.floor(F.col("t") / period).alias("k"))
        .agg(F.avg("v").alias("v"), F.sum("n").alias("n"))
        .select("s", "k", "v", "n", F.lit("observed").alias("status"))
    )
    return seen.unionByName(inside).unionByName(across).select(
        F.col("s").alias("source"), (F.col("k") * period).alias("period_start"), F.col("v").alias("value"), F.col("n").alias("n_readings"), "status"
    )
