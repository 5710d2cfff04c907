"""Streams of readings and changes: windowed counts, sessions and updates applied batch by batch."""

from __future__ import annotations

import uuid
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ontoloom.engine import Engine
from ontoloom.session import shared_dir


def event_stream(spark: SparkSession, path: str, schema: T.StructType, time: str, late: str = "1 hour", files: int = 8) -> DataFrame:
    """A stream over Parquet files of a folder with a watermark on ``time``."""
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    return df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def windowed(df: DataFrame, time: str, length: str, by: list[str], value: str) -> DataFrame:
    """Count and sum per window and group; a window takes rows until the watermark has passed it."""
    w = F.window(time, length)
    return df.groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), *by, "n", "total")


def sessions(df: DataFrame, time: str, gap: str, source: str) -> DataFrame:
    """Stretches of one source without a gap, as session windows."""
    return df.groupBy(F.session_window(time, gap).alias("w"), source).agg(F.count("*").alias("n")).select(source, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def run_to_end(stream: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Run an aggregated stream over all that is there now; the last state of every key, from the shared folder.

    The stream gives what has changed (``update`` mode), so state leaves memory once the watermark has passed. Every
    micro-batch writes a folder of its own, over what an earlier try of it left, so a batch that runs again changes
    nothing; of a key that several batches gave the last counts.
    """
    spark = stream.sparkSession
    folder = f"{shared_dir(spark)}/ontoloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"

    def batch(df: DataFrame, n: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/rows/batch={n}")

    q = stream.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{folder}/rows")
    others = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("last")).select(*[F.col(c) if c in keys else F.col("last")[c].alias(c) for c in stream.columns])


def apply_triples(stream: DataFrame, engine: Engine, checkpoint: str):
    """Start a query that merges every micro-batch of triples (``n, s, p, o, r``) into the engine's tables.

    A batch is one version: new subjects with a type become rows, values of scalars are replaced in order of ``n``,
    values of arrays appended. No row passes through the driver.
    """

    def batch(df: DataFrame, number: int) -> None:
        engine.load(df.select(F.lit(f"batch {number}").alias("src"), "n", "s", "p", "o", "r"))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
