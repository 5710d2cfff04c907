"""References to records that do not exist, found by one pass over tagged keys in long form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ontoloom.session import broadcast_if_small, materialize


def tag_parents(df: DataFrame, table: str | Column, key: Column, since: Column, until: Column) -> DataFrame:
    """Long form of a parent table: each life of a record gives +1 when it starts and -1 when it ends.

    A life without a start, or which ends no later than it starts, never exists and gives no rows.
    """
    name = F.lit(table) if isinstance(table, str) else table
    lives = df.select(name.alias("parent_table"), key.alias("key"), since.alias("since"), until.alias("until")).filter(
        F.col("key").isNotNull() & F.col("since").isNotNull() & (F.col("until").isNull() | (F.col("until") > F.col("since")))
    )
    ends = F.array(
        F.struct(F.col("since").alias("at"), F.lit(1).cast("long").alias("lives")),
        F.struct(F.col("until").alias("at"), F.lit(-1).cast("long").alias("lives")),
    )
    return lives.select("parent_table", "key", F.inline(ends)).filter(F.col("at").isNotNull()).withColumn("refs", F.lit(0).cast("long"))


def tag_children(df: DataFrame, table: str | Column, key: Column, at: Column) -> DataFrame:
    """Long form of references: the key that they name and the time at which it must exist."""
    name = F.lit(table) if isinstance(table, str) else table
    return df.select(name.alias("parent_table"), key.alias("key"), at.alias("at"), F.lit(0).cast("long").alias("lives"), F.lit(1).cast("long").alias("refs"))


def missing_keys(parents: list[DataFrame], children: list[DataFrame]) -> DataFrame:
    """Parent table, key and time of every reference that finds no living record, with the number of references.

    ``parents`` and ``children`` are in the long form of ``tag_parents`` and ``tag_children``. All rows are
    united and summed by table, key and time before they move, so a key named by a third of all rows moves as
    one row per distinct time. What lives at a time is the running sum over a key; it is taken per key and
    day, and carried over days by the days' sums, so one key's history is spread over its days.

    Cases: a null key or a null time is no reference and gives no row. A start and an end at the time of a
    reference count before it. Repeated parent rows are several lives; the key exists while at least one
    lasts. Empty tables give no rows, or every reference.
    """
    rows = reduce(DataFrame.unionByName, [*parents, *children]).filter(F.col("key").isNotNull() & F.col("at").isNotNull())
    keys = ["parent_table", "key"]
    rows = (
        rows.withColumn("day", F.col("at").cast("date"))
        .groupBy(*keys, "day", "at")
        .agg(F.sum("lives").alias("lives"), F.sum("refs").alias("refs"))
    )
    rows = materialize(rows, "references")  # read twice
    days = rows.groupBy(*keys, "day").agg(F.sum("lives").alias("lives"))
    before = W.partitionBy(*keys).orderBy("day").rowsBetween(W.unboundedPreceding, -1)
    carried = days.select(*keys, "day", F.coalesce(F.sum("lives").over(before), F.lit(0)).alias("carried"))
    so_far = W.partitionBy(*keys, "day").orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        rows.withColumn("lives", F.sum("lives").over(so_far))
        .join(carried, [*keys, "day"])
        .filter((F.col("refs") > 0) & (F.col("lives") + F.col("carried") <= 0))
        .select(*keys, "at", "refs")
    )


def rows_of(missing: DataFrame, children: DataFrame, key: Column, at: Column, hot: int = 1_000_000) -> DataFrame:
    """The rows of a table of references whose key and time are in ``missing``, with ``parent_table`` and ``key``.

    ``missing`` goes to the rows where they lie if it is small. Otherwise pairs of key and time that more than
    ``hot`` rows share are joined apart (there are few of them, so they are small), and no key of the other join has
    more than ``hot`` rows.
    """
    missing = materialize(missing, "missing").withColumnRenamed("refs", "__refs")
    side = broadcast_if_small(missing, 96)
    on = (key == F.col("key")) & (at == F.col("at"))
    if side is not missing:
        return children.join(side, on).drop("at", "__refs")
    many, few = (missing.filter(F.col("__refs") > hot), missing.filter(F.col("__refs") <= hot))
    return children.join(broadcast_if_small(many, 96), on).unionByName(children.join(few, on)).drop("at", "__refs")


def report_missing(missing: DataFrame, by: list[Column]) -> DataFrame:
    """References without a record, summed by the given columns."""
    return missing.groupBy(*by).agg(F.sum("refs").alias("missing"), F.countDistinct("key").alias("missing_keys"))
