"""The pN_ queries of the general operators over the monitoring tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontoloom.functions.iri import expand, local
from ontoloom.operators import anomalies, eav, hierarchy, orphans
from ontoloom.operators.grid import regular_grid
from ontoloom.session import table

#: 2019 in epoch seconds (UTC).
YEAR_FROM, YEAR_TO = 1_546_300_800, 1_577_836_800


def _grid(spark: SparkSession, d: str) -> DataFrame:
    return regular_grid(table(spark, d, "logger"), source="meter", time="time_stamp", value="volt", time_from=YEAR_FROM, time_to=YEAR_TO)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Periods without a usable reading: those that are marked as a gap, and those with a value of the curve."""
    filled = F.col("value").isNotNull() & ~F.isnan("value")
    return _grid(spark, d).filter((F.col("status") != "observed") & ((F.col("status") == "gap") | filled)).select(F.col("source").alias("meter"), "period_start")


def p1_grid(spark: SparkSession, d: str) -> DataFrame:
    """The regular series of every meter; values to four digits, as the order of a sum shows in the last ones."""
    return _grid(spark, d).select(F.col("source").alias("meter"), "period_start", F.round("value", 4).alias("value"), "n_readings", "status")


def _links(spark: SparkSession, d: str) -> DataFrame:
    now = hierarchy.current_version(table(spark, d, "equipment"), "equipment_id", "time_stamp")
    part = hierarchy.links_of(now, "part_of", local(F.col("equipment_id")), local(F.col("part_of")))
    cls = table(spark, d, "rdf_class")
    sub = hierarchy.links_of(cls, "sub_class_of", local(F.col("class_id")), local(F.col("sub_class_of")))
    return part.unionByName(sub)


def _trees(spark: SparkSession, d: str, columns: tuple[str, ...] = hierarchy.LONG) -> DataFrame:
    return hierarchy.hierarchy(_links(spark, d), columns=columns)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Nodes that lie on a cycle of parent links."""
    return _trees(spark, d, ()).filter("on_cycle").select("tree", "node_id")


def p2_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Path, depth, root and number of ancestors of every node; the path is joined by ``/``."""
    return _trees(spark, d).select("tree", "node_id", F.concat_ws("/", "path").alias("path"), "depth", "root", F.size("ancestors").cast("long").alias("n_ancestors"))


def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Every node with every descendant."""
    return hierarchy.descendants(_trees(spark, d))


def _missing(spark: SparkSession, d: str) -> DataFrame:
    """Links without a target, with the table and the key that they name."""
    links = table(spark, d, "links").withColumn("__key", expand(F.col("resource_ref")))
    parents = orphans.tag_parents(table(spark, d, "resources"), "resources", expand(F.col("resource_id"), bare=True), F.col("declared_at"), F.col("deleted_at"))
    children = orphans.tag_children(links, "resources", F.col("__key"), F.col("load_closed_at"))
    return orphans.rows_of(orphans.missing_keys([parents], [children]), links, F.col("__key"), F.col("load_closed_at"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Links whose target does not exist when the load closes."""
    return _missing(spark, d).select("link_id")


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """Missing references per parent table, subject type and month."""
    hit = _missing(spark, d).withColumn("refs", F.lit(1).cast("long"))
    return orphans.report_missing(hit, [F.col("parent_table"), F.col("subject_type"), F.date_format("load_closed_at", "yyyy-MM").alias("month")])


def _implausible(spark: SparkSession, d: str) -> DataFrame:
    return anomalies.implausible(table(spark, d, "logger"), time_from=YEAR_FROM, time_to=YEAR_TO)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows of implausible readings."""
    return _implausible(spark, d).select("logger_id")


def p4_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Rows of implausible readings with the reasons."""
    return _implausible(spark, d).select("logger_id", "meter", "time_stamp", "volt", "uptime", anomalies.reason_names(F.col("_reasons")).alias("reasons"))


def _properties(spark: SparkSession, d: str, most: int = 10_000) -> dict[str, tuple[str, bool]]:
    """The property schema, a small fixed table; ``most`` proves that the driver can hold it."""
    rows = table(spark, d, "prop_schema").select("p", "range_type", "multi_valued").filter("p is not null").distinct().orderBy("p").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("prop_schema is too large for a schema")
    return {r.p: (r.range_type, bool(r.multi_valued)) for r in rows}


def _wide(spark: SparkSession, d: str) -> DataFrame:
    return eav.wide(table(spark, d, "statements"), _properties(spark, d), subject=local(F.col("subject")), attribute=local(F.col("p")), value=F.col("v"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Cells whose values do not give exactly one readable value."""
    return _wide(spark, d).select("subject", F.explode("_conflicts").alias("p"))


def p5_wide(spark: SparkSession, d: str) -> DataFrame:
    """One row per subject, one typed column per property; times in UTC, lists joined by ``|``, conflicts by blanks."""
    wide = _wide(spark, d)
    utc = "TIMESTAMP_NTZ'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast(unix_micros({}) / 1000000BD as decimal(18, 6)))"
    shown = {"timestamp": lambda c: F.expr(utc.format(f"`{c}`")), "array": lambda c: F.array_join(F.col(f"`{c}`").cast("array<string>"), "|")}
    cols = [shown[f.dataType.typeName()](f.name).alias(f.name) if f.dataType.typeName() in shown else F.col(f"`{f.name}`") for f in wide.drop("_conflicts").schema]
    return wide.select(*cols, F.concat_ws(" ", "_conflicts").alias("conflicts"))


QUERIES = {f.__name__: f for f in (p1_found, p1_grid, p2_found, p2_nodes, p2_descendants, p3_found, p3_report, p4_found, p4_reasons, p5_found, p5_wide)}
