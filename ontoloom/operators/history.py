"""Versioned records: chains of versions, the latest, snapshots, movements and changes as of a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoloom.operators.shards import NEXT, PREV, bare, neighbours, running


def versions(df: DataFrame, key: str, *order: str) -> DataFrame:
    """``df`` with ``version`` (from 1) per key in the given order; a long history is spread over its weeks."""
    return bare(running(df.withColumn("__one", F.lit(1).cast("long")), key, list(order), "__one", "version")).drop("__one")


def chain(df: DataFrame, key: str, ident: str, *order: str) -> DataFrame:
    """``versions`` with ``prev`` and ``next``, the identifiers of the neighbouring versions."""
    near = neighbours(df, key, list(order), [ident], ahead=True)
    return versions(near.withColumn("prev", F.col(PREV)[ident]).withColumn("next", F.col(NEXT)[ident]), key, *order)


def latest(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The last version of each key, by one aggregate: a hot key costs a row per task."""
    cols = [c for c in df.columns if c != key]
    rank = F.struct(*order, *[c for c in cols if c not in order])
    return df.groupBy(key).agg(F.max(rank).alias("__m")).select(key, *[F.col("__m")[c].alias(c) for c in cols])


def snapshot(df: DataFrame, key: str, time: str, at) -> DataFrame:
    """The version of each key that was current at a time."""
    return latest(df.filter(F.col(time) <= at), key, time)


def movement(df: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    """Versions in which ``value`` differs from the version before: ``key, version, before, after``."""
    v = versions(neighbours(df.select(*dict.fromkeys([key, value, *order])), key, list(order), [value]).withColumn("before", F.col(PREV)[value]), key, *order)
    return v.filter((F.col("version") > 1) & ~F.col("before").eqNullSafe(F.col(value))).select(key, "version", "before", F.col(value).alias("after"))


def record(history: DataFrame, changes: DataFrame, key: str, at: str) -> DataFrame:
    """Append changed states to a history (``key, <state>, at, until``): open rows end where a change begins.

    ``changes`` has one row per key with the new state and its time. A change that equals the open state is none.
    """
    state = [c for c in changes.columns if c not in (key, at)]
    new = changes.select(key, F.col(at).alias("__at"), F.struct(*state).alias("__new"))
    j = history.join(new, key, "left")
    is_open = F.col("until").isNull()
    differs = F.col("__new").isNotNull() & ~F.struct(*state).eqNullSafe(F.col("__new"))
    old = j.withColumn("until", F.when(is_open & differs, F.col("__at")).otherwise(F.col("until"))).select(*history.columns)
    current = history.filter("until is null").select(key, F.struct(*state).alias("__old"))
    added = new.join(current, key, "left").filter(F.col("__old").isNull() | ~F.col("__old").eqNullSafe(F.col("__new")))
    return old.unionByName(added.select(key, *[F.col("__new")[c].alias(c) for c in state], F.col("__at").alias(at), F.lit(None).cast(history.schema["until"].dataType).alias("until")))


def reified(triples: DataFrame, statements: DataFrame) -> DataFrame:
    """Triples with the further columns of the statements about them; a triple without one is left out."""
    return triples.join(statements.withColumnsRenamed({"subject": "s", "predicate": "p", "object": "o"}), ["s", "p", "o"])
