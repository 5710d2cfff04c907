"""Attribute-value rows into wide tables by characteristic sets."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontoloom.functions.iri import stripped
from ontoloom.session import materialize

#: Spark type of each range.
SPARK_TYPE = {"int": "int", "long": "bigint", "double": "double", "boolean": "boolean", "dateTime": "timestamp", "string": "string"}

_DATE_TIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})?$"
_DECIMAL = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"


def _read_time(s: Column) -> Column:
    """An instant; a fraction beyond microseconds is cut, a missing offset means UTC."""
    day = F.try_to_timestamp(F.concat(F.substring(s, 1, 19), F.lit("Z")), F.lit("yyyy-MM-dd'T'HH:mm:ssX"))
    sign = F.when(F.regexp_extract(s, r"([+-])\d{2}:\d{2}$", 1) == "-", -1).otherwise(1)
    hh = F.regexp_extract(s, r"[+-](\d{2}):\d{2}$", 1).try_cast("int")
    mm = F.regexp_extract(s, r"[+-]\d{2}:(\d{2})$", 1).try_cast("int")
    offset = F.coalesce(sign * (hh * 60 + mm), F.lit(0))
    fraction = F.rpad(F.substring(F.regexp_extract(s, r"\.(\d+)", 1), 1, 6), 6, "0").try_cast("long")
    micros = F.unix_micros(day) - offset.cast("long") * 60_000_000 + F.coalesce(fraction, F.lit(0).cast("long"))
    ok = s.rlike(_DATE_TIME) & (F.coalesce(hh, F.lit(0)) <= 14) & (F.coalesce(mm, F.lit(0)) < 60)
    return F.when(ok, F.timestamp_micros(micros))


def readers(s: Column) -> dict[str, Column]:
    """For each range the value of a stripped lexical form as text in one canonical spelling, null if unreadable.

    int and long: decimal digits, optional sign and leading zeros, within 32 or 64 bits. double: decimal
    number, optional exponent; overflow to infinity is unreadable. boolean: true, false, 1, 0. dateTime:
    ``yyyy-mm-ddThh:mm:ss``, optional fraction, optional Z or offset, a real date and time. string: all.
    """
    whole = F.when(s.rlike(r"^[+-]?\d+$"), F.regexp_replace(s, r"^\+", ""))
    number = F.when(s.rlike(_DECIMAL), s.try_cast("double"))
    number = F.when(F.abs(number) != F.lit(float("inf")), number + F.lit(0.0))
    return {
        "int": whole.try_cast("int").cast("string"),
        "long": whole.try_cast("bigint").cast("string"),
        "double": number.cast("string"),
        "boolean": F.when(s.isin("true", "1"), "true").when(s.isin("false", "0"), "false"),
        "dateTime": F.unix_micros(_read_time(s)).cast("string"),
        "string": s,
    }


def _typed(s: Column, kind: str) -> Column:
    return F.timestamp_micros(s.cast("long")) if kind == "dateTime" else s.cast(SPARK_TYPE[kind])


def _unary(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda x: f(x)


def cells(statements: DataFrame, properties: dict[str, tuple[str, bool]], *, subject: Column, attribute: Column, value: Column) -> DataFrame:
    """One row per subject and property: the readable values in canonical text and how many differ.

    ``properties`` maps a property to its range and whether it is multi-valued. Returns ``s, p, value, values``:
    ``value`` of a single-valued cell with exactly one readable value, ``values`` (sorted, distinct) of a
    multi-valued cell. Equal values of a cell are one before rows move, and smallest and largest are summed before
    they move again, so a hot subject or cell costs a row per task.
    """
    spark = statements.sparkSession
    known = spark.createDataFrame([(p, kind, multi) for p, (kind, multi) in properties.items()], "p string, kind string, many boolean")
    rows = statements.select(subject.alias("s"), attribute.alias("p"), stripped(value).alias("v")).filter(F.col("s").isNotNull() & (F.col("v") != ""))
    rows = rows.join(F.broadcast(known), "p")  # as many rows as the result has columns
    canonical = reduce(lambda out, k: out.when(F.col("kind") == k[0], k[1]), readers(F.col("v")).items(), F.when(F.lit(False), F.lit(None).cast("string")))
    return (
        rows.select("s", "p", "many", canonical.alias("c"))
        .distinct()
        .groupBy("s", "p", "many")
        .agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.sort_array(F.collect_set(F.when(F.col("many"), F.col("c")))).alias("values"))
        .select("s", "p", F.when(~F.col("many") & (F.col("lo") == F.col("hi")), F.col("lo")).alias("value"), F.when(F.col("many"), F.col("values")).alias("values"))
    )


def dense_tables(statements: DataFrame, properties: dict[str, tuple[str, bool]], *, subject: Column, attribute: Column, value: Column) -> DataFrame:
    """The dense tables of all characteristic sets: ``subject, signature`` and a typed column per property.

    Every set has its rows in stretches of their own, sorted by ``signature``, the sorted properties of the set; the
    columns that a set lacks are null throughout its stretch, which is what a union by name with missing columns
    gives. So any number of sets is one table and one scan, and none is left out.
    """
    entity = (
        cells(statements, properties, subject=subject, attribute=attribute, value=value)
        .groupBy("s")
        .agg(F.map_from_entries(F.collect_list(F.struct("p", F.struct("value", "values")))).alias("cell"))
        .withColumn("signature", F.sort_array(F.map_keys("cell")))
    )
    out = [F.col("s").alias("subject"), F.col("signature").alias("_signature")]
    for p, (kind, multi) in properties.items():
        got = F.col("cell")[F.lit(p)]
        one = partial(_typed, kind=kind)
        out.append((F.transform(got["values"], _unary(one)) if multi else one(got["value"])).alias(p))
    return materialize(entity.select(*out).sortWithinPartitions("_signature"), "characteristic-sets")


def wide(statements: DataFrame, properties: dict[str, tuple[str, bool]], *, subject: Column, attribute: Column, value: Column) -> DataFrame:
    """One row per subject with one typed column per property, and ``_conflicts``, its cells without a single value.

    Method: characteristic sets. Subjects are grouped by the exact set of their properties; each set has a dense
    table with just its columns, and the dense tables are united by name with missing columns null (``dense_tables``).
    In a dense table every single-valued column must have a value: a null there is a conflict.

    Cases: a null subject, a property that ``properties`` lacks, a null or blank value give nothing; a subject
    with nothing else gives no row. A single-valued cell whose values do not give exactly one readable value is
    null and named in ``_conflicts`` (in order of ``properties``). Multi-valued columns are arrays, sorted by
    canonical text, distinct, empty if nothing is readable. Equal statements count once. An empty table gives no
    rows, with all columns. Extra columns of ``statements`` are not read; a property may not be called ``subject``,
    ``_signature`` or ``_conflicts``, and columns that differ in case only need ``spark.sql.caseSensitive``.
    """
    if taken := {"subject", "_signature", "_conflicts"} & set(properties):
        raise ValueError(f"properties that are columns already: {sorted(taken)}")
    rows = dense_tables(statements, properties, subject=subject, attribute=attribute, value=value)
    empty = [F.when(F.array_contains("_signature", p) & F.col(f"`{p}`").isNull(), F.lit(p)) for p, (_, multi) in properties.items() if not multi]
    conflicts = F.array_compact(F.array(*empty)) if empty else F.array().cast("array<string>")
    return rows.select("subject", *[F.col(f"`{p}`") for p in properties], conflicts.alias("_conflicts"))
