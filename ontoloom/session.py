"""Session helpers: the shared scratch folder, tables that cut lineage, size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: a side is offered for broadcast only when its counted rows times its row width stay under this.
BROADCAST_BYTES = 8 * 1024 * 1024

#: Folders that ``materialize`` has written and nobody has released.
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor can read: ``spark.checkpoint.dir`` of the session.

    Where it is unset and the master is local, a temporary folder is made and set; where it is unset on a
    cluster, a ValueError says so, because a machine-local folder would not survive the loss of an executor.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ontoloom-"))
    return jsc.getCheckpointDir().get().rstrip("/")


def materialize(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder, in folders by a column if given, and read it back.

    This cuts lineage in a way that survives lost executors; the files go away when the application ends, or before
    that with ``release`` and ``scratch``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ontoloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, paths: list[str] | None = None) -> int:
    """Delete tables of ``materialize``, by default all that this process has written; returns how many.

    DataFrames that read them are of no use afterwards, so call it when their queries are done.
    """
    gone = list(_written) if paths is None else paths
    for path in gone:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        if path in _written:
            _written.remove(path)
    return len(gone)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables of ``materialize`` that are written inside go away at its end: write or collect the result inside too."""
    before = set(_written)
    try:
        yield
    finally:
        release(spark, [p for p in _written if p not in before])


def broadcast_if_small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if a bounded count proves that it fits; otherwise ``df`` as it is.

    The count reads at most ``limit / row_bytes + 1`` rows, so the proof costs little on a large side,
    which then goes through the ordinary shuffled join.
    """
    most = max(1, limit // row_bytes)
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the test data."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
