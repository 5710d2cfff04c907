"""The ontology over the Parquet tables of the test data."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontoloom.catalog import OBJ, XSD, Catalog, ClassDef, PropertyDef
from ontoloom.functions.lexical import duration, hex_in, hex_out
from ontoloom.session import table

EX = "http://example.org/shop#"
STRING, INT, DOUBLE, TIME = XSD + "string", XSD + "int", XSD + "double", XSD + "dateTime"
EVENTS = ("Click", "Error", "Purchase", "Signup", "View")


def _p(name: str, kind: str, **kw) -> PropertyDef:
    return PropertyDef(EX + name, kind if ":" in kind else EX + kind, **kw)


def _t(read: Callable[[], DataFrame], key: str | None, cols: dict[str, str]) -> Callable[[], DataFrame]:
    """Reads a class table: ``id`` from the key (or from all columns), properties from columns."""

    def rows() -> DataFrame:
        df = read()
        ident = F.col(key) if key else F.concat(F.lit("_:"), F.xxhash64(*df.columns).cast("string"))
        return df.select(ident.alias("id"), *[F.col(c).alias(n) for n, c in cols.items()])

    return rows


def shop(spark: SparkSession, d: str) -> Catalog:
    """Classes, properties and lazily read tables of one folder."""
    t = lambda n: lru_cache(lambda: table(spark, d, n))
    orders, events = t("orders"), t("events")
    cat = Catalog(spark).with_namespace("ex", EX)

    def add(name: str, props: list[PropertyDef], df: Callable[[], DataFrame] | None = None, prefix: str = "", extends: str | None = None, **kw) -> None:
        nonlocal cat
        cat = cat.with_class(ClassDef(EX + name, EX + extends if extends else None, tuple(props), df, EX + prefix if prefix else "", **kw))

    add("Region", [_p("name", STRING)], _t(t("region"), "r_regionkey", {"name": "r_name"}), "region_", comment="a part of the world")
    add("Nation", [_p("name", STRING), _p("region", "Region")], _t(t("nation"), "n_nationkey", {"name": "n_name", "region": "n_regionkey"}), "nation_")
    add("Party", [_p("name", STRING), _p("nation", "Nation"), _p("acctbal", DOUBLE)])
    add(
        "Customer",
        [_p("mktsegment", STRING), _p("order", "Order", multi=True, inverse=lambda: orders().select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("value")))],
        _t(t("customer"), "c_custkey", {"name": "c_name", "nation": "c_nationkey", "acctbal": "c_acctbal", "mktsegment": "c_mktsegment"}), "customer_", "Party",
    )
    add("Supplier", [], _t(t("supplier"), "s_suppkey", {"name": "s_name", "nation": "s_nationkey", "acctbal": "s_acctbal"}), "supplier_", "Party")
    size = PropertyDef(EX + "size", INT)
    add(
        "Part",
        [_p("name", STRING), _p("brand", STRING), _p("type_name", STRING), size, _p("price", DOUBLE), PropertyDef(EX + "size_hex", INT, column="size", parse=hex_in, format=hex_out)],
        _t(t("part"), "p_partkey", {"name": "p_name", "brand": "p_brand", "type_name": "p_type", "size": "p_size", "price": "p_retailprice"}), "part_",
    )
    add(
        "Order", [_p("customer", "Customer"), _p("status", STRING), _p("totalprice", DOUBLE), _p("orderdate", TIME), _p("priority", STRING)],
        _t(orders, "o_orderkey", {"customer": "o_custkey", "status": "o_orderstatus", "totalprice": "o_totalprice", "orderdate": "o_orderdate", "priority": "o_orderpriority"}), "order_",
    )
    add(
        "LineItem",
        [_p("order", "Order"), _p("part", "Part"), _p("supplier", "Supplier"), _p("linenumber", INT), _p("quantity", DOUBLE), _p("extendedprice", DOUBLE), _p("discount", DOUBLE), _p("tax", DOUBLE), _p("returnflag", STRING), _p("linestatus", STRING), _p("shipdate", TIME)],
        _t(t("lineitem"), None, {"order": "l_orderkey", "part": "l_partkey", "supplier": "l_suppkey", "linenumber": "l_linenumber", "quantity": "l_quantity", "extendedprice": "l_extendedprice", "discount": "l_discount", "tax": "l_tax", "returnflag": "l_returnflag", "linestatus": "l_linestatus", "shipdate": "l_shipdate"}),
    )
    add(
        "Event",
        [
            _p("ts", TIME), _p("user", "Customer"), _p("value", DOUBLE), _p("props", STRING),
            _p("age", STRING, computed=lambda: duration(F.unix_timestamp(F.lit("2024-02-01 00:00:00")) - F.unix_timestamp(F.col("ts").cast("timestamp")))),
            _p("ts_v", STRING, computed=lambda: F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")),
        ],
    )
    for e in EVENTS:
        add(f"{e}Event", [], _t(lambda e=e: events().filter(F.col("event_type") == e.lower()), "event_id", {"ts": "ts", "user": "user_id", "value": "value", "props": "props"}), "event_", "Event")
    add("Document", [_p("text", STRING), _p("lang", STRING), _p("source", STRING), _p("n_chars", XSD + "integer")], _t(t("documents"), "doc_id", {c: c for c in ("text", "lang", "source", "n_chars")}), "document_")
    add("Vector", [_p("component", XSD + "float", multi=True), _p("label", INT)], _t(t("embeddings"), "vec_id", {"component": "embedding", "label": "label"}), "vector_")
    return cat


__all__ = ["EX", "OBJ", "shop"]
