"""Queries of loads, changes, users, documents and functions over the test tables, each with DuckDB SQL that gives the same rows."""

from __future__ import annotations

import dataclasses
import json
import threading
import uuid
from collections.abc import Callable
from urllib.parse import quote
from urllib.request import Request, urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ontoloom import store
from ontoloom.catalog import OBJ, PROVENANCE, RDF, RDFS, XSD, Catalog, CatalogError, ClassDef, PropertyDef, User
from ontoloom.engine import Engine
from ontoloom.functions.lexical import date_time, distance_km, mac_in, mac_out, parse_prefix
from ontoloom.functions.xml import xml_digest
from ontoloom.graph_queries import CUST, NAT, ORD, PART, REG
from ontoloom.operators import history
from ontoloom.server import serve
from ontoloom.session import shared_dir, table
from ontoloom.shop import EX, shop
from ontoloom.sinks import writers
from ontoloom.sources import rdf

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def _sparql(name: str, text: str, sql: str, changes: tuple[str, ...] = (), catalog: Callable[[SparkSession, str], Catalog] = shop, limit: int | None = None) -> None:
    """Apply changes, then query."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        e = Engine(catalog(spark, d), limit)
        for c in changes:
            e.update(c)
        return e.query(text)

    QUERIES[name], ORACLES[name] = run, sql


# the language

_sparql("select_star", "SELECT * WHERE { ?x a ex:Nation ; ex:name ?n ; ex:region ?r }", f"select {NAT('n_nationkey')} as x, n_name as n, {REG('n_regionkey')} as r from nation")
_sparql("prefix_base", f"BASE <{EX}> PREFIX s: <{EX}> SELECT ?x ?n WHERE {{ ?x s:nation <nation_3> ; s:name ?n ; a s:Customer }}", f"select {CUST('c_custkey')} as x, c_name as n from customer where c_nationkey = 3")
_sparql(
    "two_values", "SELECT ?c ?a ?b WHERE { ?c a ex:Customer ; ex:order ?a , ?b }",
    f"select {CUST('a.o_custkey')} as c, {ORD('a.o_orderkey')} as a, {ORD('b.o_orderkey')} as b from orders a join orders b on a.o_custkey = b.o_custkey join customer on c_custkey = a.o_custkey",
)
_sparql("blank_pattern", "SELECT ?n WHERE { [] a ex:Order ; ex:customer ?c . ?c ex:name ?n }", "select c_name as n from orders join customer on o_custkey = c_custkey")
_sparql("same_variable_twice", "SELECT ?o ?x WHERE { ?l a ex:LineItem ; ex:order ?o ; ex:discount ?x ; ex:tax ?x }", f"select {ORD('l_orderkey')} as o, l_discount as x from lineitem where l_discount = l_tax")
_sparql("literal_with_verbs", "SELECT ?x ?n ?y WHERE { ?x a ex:Nation ; ex:name ?n . ?n ex:name ?y }", "select n_name as x, n_name as n, n_name as y from nation where false")
_sparql("filter_decimal", "SELECT ?x ?s WHERE { ?x a ex:Part ; ex:size ?s . FILTER(?s >= 14.5) }", f"select {PART('p_partkey')} as x, p_size as s from part where p_size >= 14.5")
_sparql(
    "order_three", "SELECT ?s ?p ?t ?o WHERE { ?o a ex:Order ; ex:status ?s ; ex:priority ?p ; ex:totalprice ?t } ORDER BY ?s ?p ?t ?o LIMIT 25",
    f"select o_orderstatus as s, o_orderpriority as p, o_totalprice as t, {ORD('o_orderkey')} as o from orders order by s, p, t, o limit 25",
)
_MIXED = f"""select {NAT('n_nationkey')} as s, n_name as o from nation union all select {NAT('n_nationkey')}, {REG('n_regionkey')} from nation
 union all select {NAT('n_nationkey')}, '{EX}Nation' from nation union all select {NAT('n_nationkey')}, {NAT('n_nationkey')} from nation union all select {NAT('n_nationkey')}, {NAT('n_nationkey')} from nation"""
_sparql("order_kinds", "SELECT ?s ?o WHERE { ?s a ex:Nation ; ?p ?o } ORDER BY ?o ?s LIMIT 40", f"select s, o from ({_MIXED}) order by o like 'http%', o, s limit 40")
QUERIES["default_limit"] = lambda spark, d: Engine(shop(spark, d), 100).query("SELECT ?o WHERE { ?o a ex:Order }").agg(F.count("*").alias("n"))
ORACLES["default_limit"] = "select least(count(*), 100) as n from orders"
_sparql("typed_lookup", "SELECT ?t WHERE { ex:part_7 a ?t ; ex:price ?p }", f"select '{EX}Part' as t from part where p_partkey = 7")


@_query("select c_custkey as id, c_name as name from customer where c_custkey = 7")
def lookup_by_name(spark: SparkSession, d: str) -> DataFrame:
    """A resource of any class by its IRI."""
    return Engine(shop(spark, d)).lookup(EX + "customer_7").select("id", "name")


_HASHES = {
    "Region": ("Region", f"{EX}name>{XSD}string"),
    "Nation": ("Nation", f"{EX}name>{XSD}string;{EX}region>{EX}Region"),
    "Supplier": ("Supplier", f"{EX}name>{XSD}string;{EX}nation>{EX}Nation;{EX}acctbal>{XSD}double"),
}
_sparql(
    "class_hash", "SELECT ?c ?h WHERE { ?c a rdfs:Class ; obj:hashOf ?h . FILTER(?h != '') }",
    "select * from (values " + ", ".join(f"('{EX}{n}', md5('{EX}{c}|{shape}'))" for n, (c, shape) in _HASHES.items()) + ") t(c, h)",
)
_all_hashes = QUERIES["class_hash"]
QUERIES["class_hash"] = lambda spark, d: _all_hashes(spark, d).filter(F.col("c").isin(*[EX + n for n in _HASHES]))

# changes


def _notes(spark: SparkSession, d: str) -> Catalog:
    """The shop with a class whose resources have no native keys."""
    note = (PropertyDef(EX + "says", XSD + "string"), PropertyDef(EX + "about", EX + "Nation"), PropertyDef(EX + "rank", XSD + "int"), PropertyDef(PROVENANCE, XSD + "int"), PropertyDef(EX + "kind", XSD + "string", const=True))
    rows = lambda: spark.createDataFrame([], "id string, says string, about bigint, rank int, prov int, kind string")
    key = lambda: shop(spark, d).classes[EX + "Nation"].table.schema["id"].dataType
    return shop(spark, d).with_class(ClassDef(EX + "Note", None, note, lambda: rows().withColumn("about", F.col("about").cast(key()))))


_NOTE = "INSERT DATA { _:n1 a ex:Note ; ex:says 'one' ; ex:about ex:nation_3 . _:n2 a ex:Note ; ex:says 'two' ; ex:about ex:nation_4 ; ex:rank 5 }"
_sparql("blank_subject", "SELECT ?t ?n WHERE { _:n1 ex:says ?t ; ex:about ?x . ?x ex:name ?n }", "select 'one' as t, n_name as n from nation where n_nationkey = 3", (_NOTE,), _notes)
_sparql("blank_insert", "SELECT ?t ?r ?n WHERE { ?x a ex:Note ; ex:says ?t ; ex:rank ?r ; ex:about ?y . ?y ex:name ?n }", "select 'new' as t, 2 as r, n_name as n from nation where n_nationkey = 5", ("INSERT DATA { [] a ex:Note ; ex:says 'new' ; ex:rank 2 ; ex:about ex:nation_5 }",), _notes)
_sparql(
    "nested_insert", "SELECT ?x ?n ?g WHERE { ?x a ex:Nation ; ex:region ?r ; ex:name ?n . ?r ex:name ?g . FILTER(?g = 'NEW') }",
    f"select '{EX}nation_900' as x, 'N900' as n, 'NEW' as g", ("INSERT DATA { ex:nation_900 a ex:Nation ; ex:name 'N900' ; ex:region [ ex:name 'NEW' ] }",),
)
_sparql("const_and_kind", "SELECT ?t ?r WHERE { ?x a ex:Note ; ex:says ?t ; ex:rank ?r }", "select 'one' as t, 0 as r union all select 'two', 5", (_NOTE, "INSERT DATA { _:n1 ex:kind 'changed' ; ex:says ex:nation_3 ; ex:about 'text' ; ex:nothing 'x' }"), _notes)
_sparql("provenance", "SELECT ?t ?p WHERE { ?x a ex:Note ; ex:says ?t ; obj:prov ?p }", "select 'one' as t, 2 as p union all select 'two', 2", (_NOTE,), _notes)
_sparql("retype_ignored", "SELECT ?x ?t WHERE { ex:nation_3 a ?t ; obj:self ?x }", f"select '{EX}nation_3' as x, '{EX}Nation' as t", ("INSERT DATA { ex:nation_3 a ex:Region }",))
_sparql("delete_link", "SELECT ?x ?r WHERE { ?x a ex:Nation ; ex:region ?r }", f"select {NAT('n_nationkey')} as x, {REG('n_regionkey')} as r from nation where not (n_nationkey = 3 and n_regionkey = 3 % 5)", ("DELETE DATA { ex:nation_3 ex:region ex:region_99 , ex:region_3 }",))


@_query(f"select {NAT('n_nationkey')} as x, n_name as n from nation")
def failed_update(spark: SparkSession, d: str) -> DataFrame:
    """Of an update whose second statement fails, the first leaves nothing."""
    e = Engine(shop(spark, d))
    try:
        e.update("INSERT DATA { ex:nation_3 ex:name 'changed' } ; INSERT DATA { ex:nowhere ex:name 'x' }")
    except CatalogError:
        return e.query("SELECT ?x ?n WHERE { ?x a ex:Nation ; ex:name ?n }")
    raise AssertionError("the update did not fail")


@_query(f"select '{EX}nation_777' as s, '{RDF}type' as p, '{EX}Nation' as o union all select '{EX}nation_777', '{EX}name', 'Made' union all select '{EX}nation_777', '{EX}region', '{EX}region_1'")
def insert_reply(spark: SparkSession, d: str) -> DataFrame:
    """The description of what an insert created."""
    e = Engine(shop(spark, d))
    made = e.update("INSERT DATA { ex:nation_777 a ex:Nation ; ex:name 'Made' ; ex:region ex:region_1 . ex:nation_3 ex:name 'Known' }")
    return e.describe(made[0]).select("s", "p", "o").filter(F.lit(len(made) == 1))


@_query(f"select {CUST('c_custkey')} as c, n_name as n from customer join nation on c_nationkey = n_nationkey union all select '{EX}customer_900000007', n_name from customer join nation on c_nationkey = n_nationkey where c_custkey = 7")
def clone_post(spark: SparkSession, d: str) -> DataFrame:
    e = Engine(shop(spark, d))
    e.clone(EX + "customer_7", EX + "customer_900000007")
    return e.query("SELECT ?c ?n WHERE { ?c a ex:Customer ; ex:nation ?x . ?x ex:name ?n }")


@_query(f"select {CUST('c_custkey')} as c, {NAT('case when c_nationkey = 3 then 333 else c_nationkey end')} as x, n_name as n from customer join nation on c_nationkey = n_nationkey")
def rename_post(spark: SparkSession, d: str) -> DataFrame:
    """A nation under another name, and every link to it."""
    e = Engine(shop(spark, d))
    e.rename(EX + "nation_3", EX + "nation_333")
    return e.query("SELECT ?c ?x ?n WHERE { ?c a ex:Customer ; ex:nation ?x . ?x ex:name ?n }")


@_query("select '#' || part as item, case when part % 10 = 0 then 'moved' else brand end as place, case when part % 10 = 0 then brand end as before from (select p_partkey as part, p_brand as brand from part)")
def versions_post(spark: SparkSession, d: str) -> DataFrame:
    """Items that keep their old state when their place changes."""
    item = EX + "Item"
    props = (PropertyDef(EX + "place", XSD + "string"), PropertyDef(EX + "tag", XSD + "string"), PropertyDef(OBJ + "prev", item), PropertyDef(OBJ + "next", item))
    part = table(spark, d, "part")
    none = F.lit(None).cast("string")
    rows = part.select(F.concat(F.lit("#"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_brand").alias("place"), F.when(F.col("p_partkey") % 10 == 0, "go").otherwise("stay").alias("tag"), none.alias("prev"), none.alias("next"))
    e = Engine(Catalog(spark).with_namespace("ex", EX).with_class(ClassDef(item, None, props, rows, versioned=EX + "place")))
    e.update("INSERT { ?x ex:place 'moved' } WHERE { ?x ex:tag 'go' }")
    now = e.catalog.classes[item].table
    old = now.filter("next is not null").select(F.col("next").alias("id"), F.col("place").alias("before"))
    return now.filter("next is null").join(old, "id", "left").select(F.col("id").alias("item"), "place", "before")


@_query("select equipment_id, max(time_stamp) as time_stamp from equipment where time_stamp <= 1561939200 group by 1")
def version_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """The version of every piece of equipment that was current in the middle of 2019."""
    return history.snapshot(table(spark, d, "equipment").select("equipment_id", "time_stamp"), "equipment_id", "time_stamp", 1_561_939_200)


@_query(f"select {PART('p_partkey')} as x, p_retailprice as p from part")
def trigger_delete(spark: SparkSession, d: str) -> DataFrame:
    """A trigger keeps prices from being deleted."""
    e = Engine(shop(spark, d).with_trigger(EX + "price", "delete", lambda batch: batch.limit(0)))
    e.update("DELETE { ?x ex:price ?p } WHERE { ?x a ex:Part ; ex:price ?p . FILTER(?p > 1000) }")
    return e.query("SELECT ?x ?p WHERE { ?x a ex:Part ; ex:price ?p }")


# users and patches

_CLERK = User("clerk", {EX + "Party": frozenset({EX + "acctbal"})}, frozenset({EX + "Supplier"}), frozenset({EX + "Part"}))
_sparql("user_classes", "SELECT ?x ?n WHERE { ?x a ex:Party ; ex:name ?n }", f"select {CUST('c_custkey')} as x, c_name as n from customer", catalog=lambda spark, d: shop(spark, d).as_user(_CLERK))
_sparql(
    "user_properties", "SELECT ?p ?o WHERE { ex:customer_7 ?p ?o }",
    f"""select '{RDF}type' as p, '{EX}Customer' as o union all select '{OBJ}self', '{EX}customer_7' union all select '{OBJ}id', '{EX}customer_7' union all select '{EX}name', c_name from customer where c_custkey = 7
 union all select '{EX}nation', {NAT('c_nationkey')} from customer where c_custkey = 7 union all select '{EX}mktsegment', c_mktsegment from customer where c_custkey = 7""",
    catalog=lambda spark, d: shop(spark, d).as_user(_CLERK),
)
_sparql("user_read_only", "SELECT ?x ?p WHERE { ?x a ex:Part ; ex:price ?p }", f"select {PART('p_partkey')} as x, p_retailprice as p from part", ("INSERT { ?x ex:price 1 } WHERE { ?x a ex:Part ; ex:size 15 }",), lambda spark, d: shop(spark, d).as_user(_CLERK))
_sparql(
    "patch_inherited", "SELECT ?x ?n WHERE { ?x a ex:Party ; ex:name ?n }",
    f"select {CUST('c_custkey')} as x, c_name as n from customer union all select '{EX}supplier_' || s_suppkey, lower(s_name) from supplier",
    catalog=lambda spark, d: shop(spark, d).patch(EX + "Supplier", PropertyDef(EX + "name", XSD + "string", computed=lambda: F.lower("name"))),
)

# documents


def _written(spark: SparkSession, lines: DataFrame, head: str, tail: str) -> str:
    """Text files of lines with a head and a tail each; the folder."""
    folder = f"{shared_dir(spark)}/ontoloom/{spark.sparkContext.applicationId}/text-{uuid.uuid4().hex[:12]}"
    whole = lines.select(F.col("value")).repartition(2).mapInPandas(lambda parts, h=head, t=tail: _wrapped(parts, h, t), "value string")
    whole.write.text(folder)
    return folder


def _wrapped(parts, head: str, tail: str):
    import pandas as pd

    yield pd.DataFrame({"value": [head]})
    yield from parts
    yield pd.DataFrame({"value": [tail]})


_HEAD = f'<rdf:RDF xmlns:rdf="{RDF}" xmlns:ex="{EX}" xml:base="http://example.org/shop">'


def _loaded(spark: SparkSession, d: str, value: str, source: str = "nation", emptied: tuple[str, ...] = ("Nation", "Region"), form: str = "rdfxml") -> rdf.Loaded:
    """Load documents with an element per row of a table into the shop, some of whose classes are emptied."""
    cat = shop(spark, d)
    cat = cat.with_tables({EX + c: (cat.classes[EX + c].table.limit(0), cat.classes[EX + c].prefix) for c in emptied})
    lines = table(spark, d, source).select(F.expr(value).alias("value"))
    head, tail = (_HEAD, "</rdf:RDF>") if form == "rdfxml" else (f"@prefix ex: <{EX}> .", "")
    return rdf.load(cat, _written(spark, lines, head, tail), form)


_NAMES = "SELECT ?x ?n ?r ?g WHERE { ?x a ex:Nation ; ex:name ?n ; ex:region ?r . ?r ex:name ?g }"
_NAMES_SQL = f"select {NAT('n_nationkey')} as x, n_name as n, {REG('n_regionkey')} as r, 'R' || n_regionkey as g from nation"


@_query(_NAMES_SQL)
def rdf_nested(spark: SparkSession, d: str) -> DataFrame:
    """Property attributes and nodes inside nodes, with ``rdf:ID`` against the base."""
    value = """'<ex:Nation rdf:ID="nation_' || n_nationkey || '" ex:name="' || n_name || '"><ex:region><ex:Region rdf:about="http://example.org/shop#region_' || n_regionkey || '"><ex:name>R' || n_regionkey || '</ex:name></ex:Region></ex:region></ex:Nation>'"""
    return Engine(_loaded(spark, d, value).catalog).query(_NAMES)


@_query(_NAMES_SQL)
def rdf_typed_later(spark: SparkSession, d: str) -> DataFrame:
    """Descriptions without a type, whose types and link targets come later in the document."""
    value = """'<rdf:Description rdf:about="#nation_' || n_nationkey || '"><ex:name>' || n_name || '</ex:name><ex:region rdf:resource="#region_' || n_regionkey || '"/></rdf:Description><ex:Nation rdf:about="#nation_' || n_nationkey || '"/><ex:Region rdf:about="#region_' || n_regionkey || '" ex:name="R' || n_regionkey || '"/>'"""
    return Engine(_loaded(spark, d, value).catalog).query(_NAMES)


@_query(f"select {NAT('n_nationkey')} as x, 'new ' || n_name as n from nation")
def rdf_describe_existing(spark: SparkSession, d: str) -> DataFrame:
    """Descriptions of resources that exist change them."""
    value = """'<rdf:Description rdf:about="#nation_' || n_nationkey || '"><ex:name>new ' || n_name || '</ex:name></rdf:Description>'"""
    return Engine(_loaded(spark, d, value, emptied=()).catalog).query("SELECT ?x ?n WHERE { ?x a ex:Nation ; ex:name ?n }")


_LINKS = """'<ex:Nation rdf:about="#nation_' || n_nationkey || '" ex:name="' || n_name || '" ex:odd="1"><ex:region rdf:resource="#region_' || n_regionkey || '"/></ex:Nation><ex:Planet rdf:about="#planet_' || n_nationkey || '"/>' || if(n_regionkey < 3, '<ex:Region rdf:about="#region_' || n_regionkey || '"/>', '')"""


@_query(f"select {NAT('n_nationkey')} as x, {REG('n_regionkey')} as r from nation where n_regionkey < 3")
def rdf_dangling(spark: SparkSession, d: str) -> DataFrame:
    """Links to resources that the document does not have are left out."""
    return Engine(_loaded(spark, d, _LINKS).catalog).query("SELECT ?x ?r WHERE { ?x a ex:Nation ; ex:region ?r }")


@_query("""select 'link to nothing' as reason, count(*) as n from nation where n_regionkey >= 3 union all select 'unknown property', count(*) from nation union all select 'unknown class', count(*) from nation""")
def rdf_rejected(spark: SparkSession, d: str) -> DataFrame:
    """Triples of a load that were not used, by reason."""
    return _loaded(spark, d, _LINKS).rejected.groupBy("reason").agg(F.count("*").alias("n"))


@_query(f"select {NAT('n_nationkey')} as subject, '{EX}region' as predicate, {REG('n_regionkey')} as object, 'load ' || n_nationkey as source from nation")
def rdf_reified(spark: SparkSession, d: str) -> DataFrame:
    """Statements about links, with what is said of them."""
    value = """'<rdf:Statement rdf:nodeID="s' || n_nationkey || '"><rdf:subject rdf:resource="#nation_' || n_nationkey || '"/><rdf:predicate rdf:resource="#region"/><rdf:object rdf:resource="#region_' || n_regionkey || '"/><ex:source>load ' || n_nationkey || '</ex:source></rdf:Statement>'"""
    return _loaded(spark, d, value).statements.select("subject", "predicate", "object", F.col("meta")[EX + "source"].alias("source"))


@_query(_NAMES_SQL)
def turtle_load(spark: SparkSession, d: str) -> DataFrame:
    """Turtle with prefixes, lists of properties and values."""
    value = """'ex:nation_' || n_nationkey || ' a ex:Nation ; ex:name "' || n_name || '" ; ex:region ex:region_' || n_regionkey || ' . ex:region_' || n_regionkey || ' a ex:Region ; ex:name "R' || n_regionkey || '" .'"""
    return Engine(_loaded(spark, d, value, form="turtle").catalog).query(_NAMES)


@_query(f"""select '<rdf:Description rdf:about="' || {NAT('n_nationkey')} || '"><ex:name>' || n_name || '</ex:name><ex:region rdf:resource="' || {REG('n_regionkey')} || '"/><rdf:type rdf:resource="{EX}Nation"/></rdf:Description>' as value from nation""")
def describe_sink(spark: SparkSession, d: str) -> DataFrame:
    """Descriptions as RDF/XML."""
    e = Engine(shop(spark, d))
    return writers.describe_rdf_xml(e.catalog, e.query("DESCRIBE ?x WHERE { ?x a ex:Nation }"))


_CONTEXT = json.dumps({"rdf": RDF, "rdfs": RDFS, "xsd": XSD, "obj": OBJ, "ex": EX})


@_query(f"""select '{{"@context":{_CONTEXT},"@id":"' || {NAT('n_nationkey')} || '","@type":"ex:Nation","ex:name":"' || n_name || '","ex:region":{{"@id":"' || {REG('n_regionkey')} || '"}}}}' as value from nation""")
def jsonld_sink(spark: SparkSession, d: str) -> DataFrame:
    cat = shop(spark, d)
    return writers.json_ld_rows(cat, cat.classes[EX + "Nation"])


@_query("select 'Region ' || r_name as value from region")
def content_sink(spark: SparkSession, d: str) -> DataFrame:
    """Resources as their class renders them."""
    c = shop(spark, d).classes[EX + "Region"]
    return dataclasses.replace(c, render=lambda rows: rows.select(F.concat(F.lit("Region "), "name").alias("value"))).render(c.table)


@_query(f"""select '<rdfs:Class rdf:about="{EX}' || c || 'Event"><rdfs:subClassOf rdf:resource="{EX}Event"/></rdfs:Class>' as value from (values ('Click'), ('Error'), ('Purchase'), ('Signup'), ('View')) t(c)""")
def schema_sink(spark: SparkSession, d: str) -> DataFrame:
    """The classes below one class, as the dump of the schema has them."""
    lines = writers.schema_rdf_xml(shop(spark, d)).split("\n")
    return spark.createDataFrame([(x,) for x in lines], "value string").filter(F.col("value").contains(f'subClassOf rdf:resource="{EX}Event"'))


@_query(f"select {CUST('c_custkey')} as x, c_name as n, {NAT('c_nationkey')} as r, c_mktsegment as m from customer")
def rdf_lines(spark: SparkSession, d: str) -> DataFrame:
    """Customers written as RDF/XML, a node per line, and loaded again from files that are split."""
    cat = shop(spark, d)
    c = cat.classes[EX + "Customer"]
    folder = f"{shared_dir(spark)}/ontoloom/{spark.sparkContext.applicationId}/lines-{uuid.uuid4().hex[:12]}"
    writers.write_rdf_xml(cat, folder, [c.iri])
    bare = cat.with_tables({c.iri: (c.table.limit(0), c.prefix)})
    return Engine(rdf.load(bare, folder, "lines").catalog).query("SELECT ?x ?n ?r ?m WHERE { ?x a ex:Customer ; ex:name ?n ; ex:nation ?r ; ex:mktsegment ?m }")


# stores, servers, hooks


@_query(f"select {REG('r_regionkey')} as x, case when r_regionkey = 1 then 'second' else r_name end as n from region")
def store_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """A catalog saved, loaded, changed, saved to the same folder and loaded again."""
    folder = f"{shared_dir(spark)}/ontoloom/{spark.sparkContext.applicationId}/store-{uuid.uuid4().hex[:12]}"
    small = shop(spark, d)
    small = dataclasses.replace(small, classes={c: dataclasses.replace(x, storage="orc" if c == EX + "Region" else "volatile") for c, x in small.classes.items()})
    store.save(small, folder)
    for name in ("first", "second"):
        e = Engine(store.load(small, folder))
        e.update(f"INSERT DATA {{ ex:region_1 ex:name '{name}' }}")
        store.save(e.catalog, folder)
    return Engine(store.load(small, folder)).query("SELECT ?x ?n WHERE { ?x a ex:Region ; ex:name ?n }")


def _served(spark: SparkSession, engine: Engine, *requests: tuple[str, str | None]) -> DataFrame:
    """Lines that a server answers to requests (a path, and the body of a POST), one after another; the last answer."""
    httpd = serve(engine)
    threading.Thread(target=httpd.serve_forever, daemon=True).start()
    try:
        for path, body in requests:
            request = Request(f"http://127.0.0.1:{httpd.server_address[1]}{path}", body.encode() if body else None, {"Accept": "text/csv"})
            with urlopen(request, timeout=300) as reply:
                text = reply.read().decode()
    finally:
        httpd.shutdown()
        httpd.server_close()
    return spark.createDataFrame([(x,) for x in text.splitlines()], "value string")


@_query("select 'n,k' as value union all select n_name || ',' || count(*) from customer join nation on c_nationkey = n_nationkey group by n_name")
def server_csv(spark: SparkSession, d: str) -> DataFrame:
    return _served(spark, Engine(shop(spark, d)), ("/sparql", "SELECT ?n COUNT(?c) AS ?k WHERE { ?c a ex:Customer ; ex:nation ?x . ?x ex:name ?n }"))


@_query(f"select 'x' as value union all select {CUST('c_custkey')} from customer where c_nationkey = 3 or c_custkey = 5")
def server_update(spark: SparkSession, d: str) -> DataFrame:
    """An update and a query after it, both over HTTP."""
    return _served(spark, Engine(shop(spark, d)), ("/sparql", "INSERT DATA { ex:customer_5 ex:nation ex:nation_3 }"), ("/sparql", "SELECT ?x WHERE { ?x a ex:Customer ; ex:nation ex:nation_3 }"))


@_query(f"""select '<rdf:Description rdf:about="{EX}region_2"><ex:name>' || r_name || '</ex:name><rdf:type rdf:resource="{EX}Region"/></rdf:Description>' as value from region where r_regionkey = 2""")
def server_data(spark: SparkSession, d: str) -> DataFrame:
    """The description of a resource by its address."""
    return _served(spark, Engine(shop(spark, d)), ("/data/" + quote(EX + "region_2", safe=""), None))


@_query(f"select trim(x) as value from (select unnest(string_split('[' || (select string_agg('\"' || {NAT('n_nationkey')} || '\"', ', ' order by n_nationkey) from nation) || ']', ', ')) as x)")
def server_rest(spark: SparkSession, d: str) -> DataFrame:
    """All ids of a class as JSON, an id per row, in order of keys."""
    cat = shop(spark, d)
    c = cat.classes[EX + "Nation"]
    got = _served(spark, Engine(cat.with_tables({EX + "Nation": (c.table.orderBy("id"), c.prefix)})), ("/rest/Nation", None))
    return got.select(F.explode(F.split("value", ", ")).alias("value"))


@_query(f"select {NAT('n_nationkey')} as x, n_name || ' (loaded)' as n from nation")
def load_hook(spark: SparkSession, d: str) -> DataFrame:
    """A load after which a hook changes what is there."""
    cat = shop(spark, d)
    folder = f"{shared_dir(spark)}/ontoloom/{spark.sparkContext.applicationId}/hook-{uuid.uuid4().hex[:12]}"
    writers.write_rdf_xml(cat, folder, [EX + "Nation"])

    def after(loaded: Catalog) -> Catalog:
        c = loaded.classes[EX + "Nation"]
        return loaded.with_tables({EX + "Nation": (c.table.withColumn("name", F.concat("name", F.lit(" (loaded)"))), c.prefix)})

    bare = cat.with_tables({EX + "Nation": (cat.classes[EX + "Nation"].table.limit(0), cat.classes[EX + "Nation"].prefix)})
    return Engine(rdf.load(bare, folder, after=after).catalog).query("SELECT ?x ?n WHERE { ?x a ex:Nation ; ex:name ?n }")


# functions


@_query(r"""select stmt_id, coalesce(try_cast(regexp_extract(v, '^\s*([+-]?[0-9]+)', 1) as bigint), 0) as whole, v is not null and lower(trim(v)) in ('true', '1') or coalesce(try_cast(regexp_extract(v, '^\s*([+-]?[0-9]+)', 1) as integer) <> 0, false) as yes from statements""")
def fn_prefix_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Numbers that texts start with, 0 for none."""
    v = F.col("v")
    return table(spark, d, "statements").select("stmt_id", parse_prefix(v, T.LongType()).alias("whole"), F.coalesce(parse_prefix(v, T.BooleanType()), F.lit(False)).alias("yes"))


@_query("select event_id, epoch_us(ts) - 5400000000 + 250000 as micros from events")
def fn_date_time_in(spark: SparkSession, d: str) -> DataFrame:
    """Times with a fraction and an offset without a colon."""
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".25+0130"))
    return table(spark, d, "events").select("event_id", (F.unix_micros(parse_prefix(text, T.TimestampType())) + F.pmod(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(1_000_000))).alias("micros"))


@_query("select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad((epoch_us(ts) % 1000000 // 1000)::varchar, 3, '0') as text from events")
def fn_date_time_out(spark: SparkSession, d: str) -> DataFrame:
    """Times in milliseconds; the offset of the session's zone, four digits with a sign, is tested and cut off."""
    t = date_time(F.col("ts").cast("timestamp"))
    return table(spark, d, "events").select("event_id", F.when(t.rlike(r"[+-]\d{4}$"), F.regexp_replace(t, r"[+-]\d{4}$", "")).alias("text"))


@_query("select doc_id, lower(hex(encode(docket))) as hexed, docket as back from documents where docket is not null")
def fn_hex_text(spark: SparkSession, d: str) -> DataFrame:
    """Bytes as hexadecimal digits and back."""
    h = F.lower(F.hex(F.encode("docket", "UTF-8")))
    return table(spark, d, "documents").filter("docket is not null").select("doc_id", h.alias("hexed"), F.decode(F.unhex(h), "UTF-8").alias("back"))


_MAC = "lpad(to_hex(p_partkey * 7919 + 281474000000000), 12, '0')"


@_query(f"select p_partkey, lower(concat_ws(':', {', '.join(f'substr({_MAC}, {k}, 2)' for k in range(1, 12, 2))})) as mac, p_partkey * 7919 + 281474000000000 as back from part")
def fn_mac(spark: SparkSession, d: str) -> DataFrame:
    """Hardware addresses of integers and back."""
    mac = mac_out(F.col("p_partkey").cast("long") * 7919 + 281_474_000_000_000)
    return table(spark, d, "part").select("p_partkey", mac.alias("mac"), mac_in(mac).alias("back"))


@_query("select vec_id, array_to_string([floor(x::double * 1000)::bigint for x in embedding], ' ') as v, array_to_string([floor(x::double * 1000)::bigint for x in list_concat(embedding[1:1], embedding[4:])], ' ') as erased, floor(embedding[3]::double * 1000)::bigint as third from embeddings")
def fn_array_values(spark: SparkSession, d: str) -> DataFrame:
    """The values of arrays, without the second and third, and by index."""
    from ontoloom.functions.lexical import erase

    whole = lambda a: F.array_join(F.transform(a, lambda x: F.floor(x.cast("double") * 1000).cast("string")), " ")
    e = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", whole(e).alias("v"), whole(erase(e, 1, 2)).alias("erased"), F.floor(F.element_at(e, 3).cast("double") * 1000).alias("third"))


@_query("""select row_id, round(2 * 6371.0 * asin(sqrt(pow(sin(radians(geo_lat::double - 50) / 2), 2) + cos(radians(50.0)) * cos(radians(geo_lat::double)) * pow(sin(radians(geo_long::double - 8) / 2), 2))), 2) as km from sites where geo_lat is not null and geo_long is not null""")
def fn_distance(spark: SparkSession, d: str) -> DataFrame:
    """Distance of every site from one point."""
    lat, lon = F.col("geo_lat").cast("double"), F.col("geo_long").cast("double")
    return table(spark, d, "sites").filter("geo_lat is not null and geo_long is not null").select("row_id", F.round(distance_km(F.lit(50.0), F.lit(8.0), lat, lon), 2).alias("km"))


@_query("""select p_partkey, md5('<item brand="' || p_brand || '" size="' || p_size || '"><n>' || p_name || '</n></item>') as digest, true as valid from part""")
def fn_xml_digest_attributes(spark: SparkSession, d: str) -> DataFrame:
    """Digest of a document whose attributes are in another order, and whether it is the one that was signed."""
    from ontoloom.functions.xml import signature_valid

    doc = F.concat(F.lit("<item  size='"), F.col("p_size").cast("string"), F.lit("' brand='"), "p_brand", F.lit("' ><n >"), "p_name", F.lit("</n ></item >"))
    digest = F.md5(F.concat(F.lit('<item brand="'), "p_brand", F.lit('" size="'), F.col("p_size").cast("string"), F.lit('"><n>'), "p_name", F.lit("</n></item>")))
    return table(spark, d, "part").select("p_partkey", xml_digest(doc).alias("digest"), signature_valid(doc, digest).alias("valid"))


@_query("select row_id, sign(geo_lat::double)::bigint as sign from sites where geo_lat is not null")
def fn_sign(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sites").filter("geo_lat is not null").select("row_id", F.signum(F.col("geo_lat").cast("double")).cast("long").alias("sign"))
