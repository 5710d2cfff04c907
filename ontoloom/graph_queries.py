"""Queries of the graph engine over the test tables, each with DuckDB SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontoloom.engine import Engine
from ontoloom.functions.lexical import duration, erase, first_word, general_float, hex_in, percent_decode, percent_encode
from ontoloom.functions.xml import xml_digest
from ontoloom.operators import history, timeseries
from ontoloom.session import shared_dir, table
from ontoloom.shop import EX, shop
from ontoloom.sinks import writers
from ontoloom.sources import rdf
from ontoloom.streaming import events

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _iri(name: str, c: str) -> str:
    return f"'{EX}{name}_' || {c}"


def _sparql(name: str, text: str, sql: str | None) -> None:
    QUERIES[name] = lambda spark, d: Engine(shop(spark, d)).query(text)
    if sql:
        ORACLES[name] = sql


def _after(name: str, changes: list[str], text: str, sql: str) -> None:
    """Apply changes, then query the state."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        e = Engine(shop(spark, d))
        for c in changes:
            e.update(c)
        return e.query(text)

    QUERIES[name] = run
    ORACLES[name] = sql


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


CUST, SUPP, NAT, ORD, REG, EVT, PART = (lambda c, n=n: _iri(n, c) for n in ("customer", "supplier", "nation", "order", "region", "event", "part"))
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"

_sparql("class_scan", "SELECT ?x ?n WHERE { ?x a ex:Customer ; ex:name ?n . }", f"select {CUST('c_custkey')} as x, c_name as n from customer")
_sparql("subclass_scan", "SELECT ?x ?n WHERE { ?x a ex:Party ; ex:name ?n }", f"select {CUST('c_custkey')} as x, c_name as n from customer union all select {SUPP('s_suppkey')}, s_name from supplier")
_sparql("most_specific_type", "SELECT ?x ?t WHERE { ?x a ex:Party ; a ?t }", f"select {CUST('c_custkey')} as x, '{EX}Customer' as t from customer union all select {SUPP('s_suppkey')}, '{EX}Supplier' from supplier")
_sparql("domain_inference", "SELECT ?x ?s WHERE { ?x ex:mktsegment ?s }", f"select {CUST('c_custkey')} as x, c_mktsegment as s from customer")
_sparql("full_scan", "SELECT ?x ?n WHERE { ?x ex:name ?n }", f"select {CUST('c_custkey')} as x, c_name as n from customer union all select {SUPP('s_suppkey')}, s_name from supplier union all select {NAT('n_nationkey')}, n_name from nation union all select {REG('r_regionkey')}, r_name from region union all select {PART('p_partkey')}, p_name from part")
_sparql("bound_subject", "SELECT ?n WHERE { ex:customer_7 ex:name ?n }", "select c_name as n from customer where c_custkey = 7")
_sparql("bound_iri_object", "SELECT ?o WHERE { ?o ex:customer ex:customer_7 }", f"select {ORD('o_orderkey')} as o from orders where o_custkey = 7")
_sparql("bound_literal", "SELECT ?x WHERE { ?x ex:mktsegment 'BUILDING' }", f"select {CUST('c_custkey')} as x from customer where c_mktsegment = 'BUILDING'")
_sparql("bound_number", "SELECT ?x WHERE { ?x a ex:Part ; ex:size 15 }", f"select {PART('p_partkey')} as x from part where p_size = 15")
_sparql("star_join", "SELECT ?o ?c ?s ?p ?d WHERE { ?o ex:customer ?c ; ex:status ?s ; ex:totalprice ?p ; ex:orderdate ?d }", f"select {ORD('o_orderkey')} as o, {CUST('o_custkey')} as c, o_orderstatus as s, o_totalprice as p, o_orderdate as d from orders")
_sparql("path_1", "SELECT ?o ?n WHERE { ?o a ex:Order ; ex:customer ?c . ?c ex:name ?n }", f"select {ORD('o_orderkey')} as o, c_name as n from orders join customer on o_custkey = c_custkey")
_sparql("path_3", "SELECT ?c ?r WHERE { ?c a ex:Customer ; ex:nation ?n . ?n ex:region ?g . ?g ex:name ?r }", f"select {CUST('c_custkey')} as c, r_name as r from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
_sparql("fan_in_shared_object", "SELECT ?c ?s WHERE { ?c a ex:Customer ; ex:nation ?n . ?s a ex:Supplier ; ex:nation ?n }", f"select {CUST('c_custkey')} as c, {SUPP('s_suppkey')} as s from customer join supplier on c_nationkey = s_nationkey")
_sparql(
    "diamond_same_nation", "SELECT ?o ?s ?n WHERE { ?l ex:order ?o ; ex:supplier ?s . ?o ex:customer ?c . ?c ex:nation ?n . ?s ex:nation ?n }",
    f"select {ORD('o_orderkey')} as o, {SUPP('s_suppkey')} as s, {NAT('c_nationkey')} as n from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey where c_nationkey = s_nationkey",
)
_sparql("cross_product", "SELECT ?a ?b WHERE { ?a a ex:Region . ?b a ex:Region }", f"select {REG('a.r_regionkey')} as a, {REG('b.r_regionkey')} as b from region a, region b")
for _n, _op in (("eq", "="), ("ne", "!="), ("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">=")):
    _sparql(f"filter_{_n}", f"SELECT ?x ?s WHERE {{ ?x a ex:Part ; ex:size ?s . FILTER(?s {_op} 15) }}", f"select {PART('p_partkey')} as x, p_size as s from part where p_size {_op} 15")
_sparql("filter_two_vars", "SELECT ?o ?a ?b WHERE { ?x a ex:LineItem ; ex:discount ?a ; ex:tax ?b ; ex:order ?o . FILTER(?a < ?b) }", f"select {ORD('l_orderkey')} as o, l_discount as a, l_tax as b from lineitem where l_discount < l_tax")
_sparql("filter_text", "SELECT ?x WHERE { ?x ex:mktsegment ?m . FILTER(?m > 'FURNITURE') }", f"select {CUST('c_custkey')} as x from customer where c_mktsegment > 'FURNITURE'")
_sparql("order_1", "SELECT ?x ?p WHERE { ?x a ex:Part ; ex:price ?p } ORDER BY ?p", f"select {PART('p_partkey')} as x, p_retailprice as p from part order by p, x")
_sparql("order_2", "SELECT ?m ?x WHERE { ?x ex:mktsegment ?m ; ex:acctbal ?b } ORDER BY ?m ?b", f"select c_mktsegment as m, {CUST('c_custkey')} as x from customer")
_sparql("order_limit", "SELECT ?o ?p WHERE { ?o a ex:Order ; ex:totalprice ?p } ORDER BY ?p ?o LIMIT 10", f"select {ORD('o_orderkey')} as o, o_totalprice as p from orders order by p, o limit 10")
_sparql("order_desc_offset", "SELECT ?o ?p WHERE { ?o a ex:Order ; ex:totalprice ?p } ORDER BY DESC(?p) ?o LIMIT 10 OFFSET 5", f"select {ORD('o_orderkey')} as o, o_totalprice as p from orders order by p desc, o limit 10 offset 5")
_sparql("count_global", "SELECT COUNT(?o) AS ?n WHERE { ?o a ex:Order }", "select count(*) as n from orders")
_sparql("count_group", "SELECT ?s COUNT(?o) AS ?n WHERE { ?o a ex:Order ; ex:status ?s }", "select o_orderstatus as s, count(*) as n from orders group by 1")
_sparql(
    "count_path", "SELECT ?n COUNT(?o) AS ?k WHERE { ?o a ex:Order ; ex:customer ?c ; ex:totalprice ?p . ?c ex:nation ?t . ?t ex:name ?n . FILTER(?p > 100000) } ORDER BY ?n",
    "select n_name as n, count(*) as k from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where o_totalprice > 100000 group by 1",
)
_NATION = f"""select '{RDF_TYPE}' as p, '{EX}Nation' as o from nation where n_nationkey = 3 union all select '{EX}name', n_name from nation where n_nationkey = 3
 union all select '{EX}region', {REG('n_regionkey')} from nation where n_nationkey = 3"""
_sparql("predicate_var", "SELECT ?p ?o WHERE { ex:nation_3 ?p ?o }", f"{_NATION} union all select 'http://ontoloom.example.org/obj#self', '{EX}nation_3' union all select 'http://ontoloom.example.org/obj#id', '{EX}nation_3'")
_sparql("predicate_var_object", "SELECT ?s ?p WHERE { ?s a ex:Nation ; ?p ex:region_1 }", f"select {NAT('n_nationkey')} as s, '{EX}region' as p from nation where n_regionkey = 1")
_sparql("describe_iri", "DESCRIBE ex:nation_3", f"select '{EX}nation_3' as s, p, o, p <> '{EX}name' as is_resource from ({_NATION})")
_sparql(
    "describe_query", "DESCRIBE ?n WHERE { ?c a ex:Customer ; ex:nation ?n ; ex:acctbal ?a . FILTER(?a > 9000) }",
    f"""with k as (select distinct c_nationkey as k from customer where c_acctbal > 9000), n as (select * from nation where n_nationkey in (select k from k))
 select {NAT('n_nationkey')} as s, '{RDF_TYPE}' as p, '{EX}Nation' as o, true as is_resource from n union all select {NAT('n_nationkey')}, '{EX}name', n_name, false from n union all select {NAT('n_nationkey')}, '{EX}region', {REG('n_regionkey')}, true from n""",
)
_sparql("schema_domain_entail", "SELECT ?p WHERE { ?p rdfs:domain ex:Customer }", "select * from (values " + ", ".join(f"('{EX}{x}')" for x in ("name", "nation", "acctbal", "mktsegment", "order")) + ") t(p)")
_sparql("schema_range", "SELECT ?p WHERE { ?p rdfs:range ex:Customer }", f"select * from (values ('{EX}customer'), ('{EX}user')) t(p)")
_sparql("schema_subclass", "SELECT ?c WHERE { ?c rdfs:subClassOf ex:Event }", "select * from (values " + ", ".join(f"('{EX}{x}Event')" for x in ("Click", "Error", "Purchase", "Signup", "View")) + ") t(c)")
_sparql("schema_optional", "SELECT ?p ?r ?s WHERE { ?p rdfs:domain ex:Nation ; rdfs:range ?r ; rdfs:subPropertyOf ?s }", f"select * from (values ('{EX}name', 'http://www.w3.org/2001/XMLSchema#string', null::varchar), ('{EX}region', '{EX}Region', null::varchar)) t(p, r, s)")
_CARD = {"Region": "region", "Nation": "nation", "Customer": "customer", "Supplier": "supplier", "Part": "part", "Order": "orders", "LineItem": "lineitem", "Document": "documents", "Vector": "embeddings"}
_sparql(
    "class_cardinality", "SELECT ?c ?n WHERE { ?c a rdfs:Class ; obj:cardinality ?n }",
    " union all ".join(f"select '{EX}{c}' as c, count(*) as n from {t}" for c, t in _CARD.items())
    + "".join(f" union all select '{EX}{e}Event', count(*) from events where event_type = '{e.lower()}'" for e in ("Click", "Error", "Purchase", "Signup", "View"))
    + f" union all select '{EX}Party', 0 union all select '{EX}Event', 0",
)
_sparql("class_shape", "SELECT ?c ?n WHERE { ?c rdfs:subClassOf ex:Party ; obj:sizeOf ?n }", f"select * from (values ('{EX}Customer', 6), ('{EX}Supplier', 4)) t(c, n)")
_sparql("array_explode", "SELECT ?e ?v WHERE { ?e ex:component ?v }", f"select {_iri('vector', 'vec_id')} as e, unnest(embedding) as v from embeddings")
_sparql("inverse_array", "SELECT ?c ?o WHERE { ?c a ex:Customer ; ex:order ?o }", f"select {CUST('o_custkey')} as c, {ORD('o_orderkey')} as o from orders")
_sparql("pseudo_time", "SELECT ?e ?t WHERE { ?e a ex:Event ; ex:ts_v ?t }", f"select {EVT('event_id')} as e, strftime(ts, '%Y-%m-%dT%H:%M:%S') as t from events")
_AGE = "(epoch(timestamp '2024-02-01 00:00:00')::bigint - floor(epoch(ts))::bigint)"
_sparql("pseudo_duration", "SELECT ?e ?t WHERE { ?e a ex:Event ; ex:age ?t }", f"select {EVT('event_id')} as e, ({_AGE} // 86400) || 'd ' || ({_AGE} % 86400 // 3600) || 'h ' || ({_AGE} % 3600 // 60) || 'm' as t from events")
_sparql("hex_adapter", "SELECT ?x ?h WHERE { ?x ex:size_hex ?h }", f"select {PART('p_partkey')} as x, lower(to_hex(p_size)) as h from part")
_sparql("unknown_predicate", "SELECT ?x ?y WHERE { ?x ex:nothing ?y }", "select c_name as x, c_name as y from customer where false")
_sparql("user_path", "SELECT ?e ?n WHERE { ?e a ex:Event ; ex:user ?u ; ex:value ?v . ?u ex:name ?n . FILTER(?v > 50) }", f"select {EVT('event_id')} as e, c_name as n from events join customer on user_id = c_custkey where value > 50")

# updates

_after(
    "insert_data_post", ["INSERT DATA { ex:customer_900000001 a ex:Customer ; ex:name 'New' ; ex:nation ex:nation_3 , ex:nation_777 . }"], "SELECT ?x ?n ?b WHERE { ?x a ex:Customer ; ex:name ?n ; ex:nation ex:nation_3 ; ex:acctbal ?b }",
    f"select {CUST('c_custkey')} as x, c_name as n, c_acctbal as b from customer where c_nationkey = 3 union all select '{EX}customer_900000001', 'New', 0.0::double",
)
_after(
    "insert_where_post", ["INSERT { ?c ex:mktsegment 'VIP' } WHERE { ?c a ex:Customer ; ex:acctbal ?b . FILTER(?b > 9000) }"], "SELECT ?c ?m WHERE { ?c ex:mktsegment ?m }",
    f"select {CUST('c_custkey')} as c, case when c_acctbal > 9000 then 'VIP' else c_mktsegment end as m from customer",
)
_after(
    "delete_data_post", ["DELETE DATA { ex:nation_3 ex:name 'NATION_3' . ex:nation_4 ex:name 'wrong' . }"], "SELECT ?x ?n WHERE { ?x a ex:Nation ; ex:name ?n }",
    f"select {NAT('n_nationkey')} as x, n_name as n from nation where n_name <> 'NATION_3'",
)
_after(
    "delete_where_post", ["DELETE { ?c ex:acctbal ?b } WHERE { ?c a ex:Customer ; ex:acctbal ?b ; ex:mktsegment 'BUILDING' }"], "SELECT ?c ?b WHERE { ?c a ex:Customer ; ex:acctbal ?b . FILTER(?b = 0) }",
    f"select {CUST('c_custkey')} as c, 0.0::double as b from customer where c_acctbal = 0 or c_mktsegment = 'BUILDING'",
)
_after(
    "modify_post", ["DELETE { ?c ex:mktsegment ?m } INSERT { ?c ex:mktsegment 'MOVED' } WHERE { ?c ex:mktsegment ?m ; ex:nation ex:nation_3 }"], "SELECT ?c ?m WHERE { ?c ex:mktsegment ?m }",
    f"select {CUST('c_custkey')} as c, case when c_nationkey = 3 then 'MOVED' else c_mktsegment end as m from customer",
)
_after("array_append_post", ["INSERT DATA { ex:vector_1 ex:component 1.5 , 2.5 . } ; DELETE DATA { ex:vector_1 ex:component 1.5 }"], "SELECT ?v WHERE { ex:vector_1 ex:component ?v }", "select unnest(embedding) as v from embeddings where vec_id = 1 union all select 2.5::float")


@_query(f"select {PART('p_partkey')} as x, case when p_partkey = 2 then 12.0::double else p_retailprice end as p from part")
def trigger_reject(spark: SparkSession, d: str) -> DataFrame:
    """A trigger leaves out negative prices before a change is applied."""
    cat = shop(spark, d).with_trigger(EX + "price", "insert", lambda batch: batch.filter(F.col("o").try_cast("double") >= 0))
    e = Engine(cat)
    e.update("INSERT DATA { ex:part_1 ex:price -5 . ex:part_2 ex:price 12 . }")
    return e.query("SELECT ?x ?p WHERE { ?x a ex:Part ; ex:price ?p }")


# history and statements about statements


@_query("select equipment_id, nullif(m.part_of, '') as part_of, m.time_stamp as time_stamp from (select equipment_id, max({'time_stamp': time_stamp, 'part_of': coalesce(part_of, '')}) as m from equipment group by 1)")
def version_latest(spark: SparkSession, d: str) -> DataFrame:
    """The current version of every piece of equipment."""
    t = table(spark, d, "equipment").select("equipment_id", F.coalesce("part_of", F.lit("")).alias("part_of"), "time_stamp")
    return history.latest(t, "equipment_id", "time_stamp").select("equipment_id", F.when(F.col("part_of") != "", F.col("part_of")).alias("part_of"), "time_stamp")




@_query("""with v as (select user_id, event_type, row_number() over w as version, lag(event_type) over w as before from events window w as (partition by user_id order by ts, event_id))
 select user_id, version, before, event_type as after from v where version > 1 and before is distinct from event_type""")
def version_movement(spark: SparkSession, d: str) -> DataFrame:
    """Changes of event type along each user's chain of events."""
    return history.movement(table(spark, d, "events"), "user_id", "event_type", "ts", "event_id").withColumn("version", F.col("version").cast("long"))


@_query("select event_id, row_number() over w as version, lag(event_id) over w as prev, lead(event_id) over w as next from events window w as (partition by user_id order by ts, event_id)")
def version_chain(spark: SparkSession, d: str) -> DataFrame:
    """Each event with the one before and after it of the same user."""
    return history.chain(table(spark, d, "events"), "user_id", "event_id", "ts", "event_id").select("event_id", F.col("version").cast("long").alias("version"), "prev", "next")


@_query("select subject as s, p, resource_ref as o, load_id from links where resource_ref is not null and subject is not null and p is not null")
def reified_meta(spark: SparkSession, d: str) -> DataFrame:
    """Statements with the load that made them."""
    t = table(spark, d, "links").filter("resource_ref is not null and subject is not null and p is not null")
    triples = t.select(F.col("subject").alias("s"), "p", F.col("resource_ref").alias("o")).distinct()
    statements = t.select("subject", F.col("p").alias("predicate"), F.col("resource_ref").alias("object"), "load_id")
    return history.reified(triples, statements).select("s", "p", "o", "load_id")


# time series

_LOG = "logger"


def _log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "logger")


@_query(f"""select logger_id, case when pt is null then null when pt < time_stamp - uptime then coalesce(data_bytes, 0) else coalesce(data_bytes, 0) - coalesce(pd, 0) end as delta
 from (select *, lag(time_stamp) over w as pt, lag(data_bytes) over w as pd from {_LOG} window w as (partition by meter order by time_stamp nulls first, logger_id))""")
def ts_delta(spark: SparkSession, d: str) -> DataFrame:
    """Growth of the data counter, with restarts."""
    return timeseries.counter_delta(_log(spark, d), source="meter", time="time_stamp", counter="data_bytes", uptime="uptime", tie="logger_id").select("logger_id", "delta")


@_query(f"""select meter, sum(delta)::bigint as total from (select meter, case when pt < time_stamp - uptime then coalesce(data_bytes, 0) else coalesce(data_bytes, 0) - coalesce(pd, 0) end as delta
 from (select *, lag(time_stamp) over w as pt, lag(data_bytes) over w as pd from {_LOG} window w as (partition by meter order by time_stamp nulls first, logger_id)) where pt is not null) group by 1""")
def ts_total(spark: SparkSession, d: str) -> DataFrame:
    """Data used by each meter over all restarts."""
    delta = timeseries.counter_delta(_log(spark, d), source="meter", time="time_stamp", counter="data_bytes", uptime="uptime", tie="logger_id")
    return delta.filter("delta is not null").groupBy("meter").agg(F.sum("delta").alias("total"))


@_query(f"""with f as (select *, case when lag(time_stamp) over w is null or time_stamp - lag(time_stamp) over w > 3600 or n_client is distinct from lag(n_client) over w then 1 else 0 end as flag from {_LOG} window w as (partition by meter order by time_stamp nulls first, logger_id)),
 i as (select *, sum(flag) over (partition by meter order by time_stamp nulls first, logger_id rows unbounded preceding) as island from f)
 select meter, n_client, min(time_stamp) as start, max(time_stamp) as stop, count(*) as n from i group by meter, island, n_client""")
def ts_islands(spark: SparkSession, d: str) -> DataFrame:
    """Stretches with the same number of clients and no long gap."""
    return timeseries.islands(_log(spark, d), source="meter", time="time_stamp", gap=3600, same=["n_client"], tie="logger_id")


@_query(f"select meter, from_time, time_stamp as to_time from (select meter, time_stamp, lag(time_stamp) over (partition by meter order by time_stamp nulls first, logger_id) as from_time from {_LOG}) where time_stamp - from_time > 3600")
def ts_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Down-times of over an hour."""
    return timeseries.breaks(_log(spark, d), source="meter", time="time_stamp", gap=3600, tie="logger_id")


@_query("select event_id, ts from events where ts >= (select max(ts) from events) - interval 10 days")
def ts_range(spark: SparkSession, d: str) -> DataFrame:
    """Events of the last ten days."""
    return timeseries.recent(table(spark, d, "events"), "ts", F.expr("INTERVAL 10 DAYS")).select("event_id", "ts")


@_query("select user_id, case when m > 0 then case when m < pow(10, ceil(log10(m))) / 2 then pow(10, ceil(log10(m))) / 2 else pow(10, ceil(log10(m))) end else 1.0 end as top from (select user_id, max(value) as m from events group by 1)")
def ts_scale(spark: SparkSession, d: str) -> DataFrame:
    """A round axis maximum per user."""
    return table(spark, d, "events").groupBy("user_id").agg(F.max("value").alias("m")).select("user_id", timeseries.nice_max(F.col("m")).alias("top"))


@_query(f"select meter, m.t as time_stamp, m.v as volt from (select meter, min({{'t': time_stamp, 'v': volt}}) as m from {_LOG} where time_stamp is not null and volt is not null and not isnan(volt) and volt <> -1 group by 1)")
def ts_first_valid(spark: SparkSession, d: str) -> DataFrame:
    """First measured voltage of every meter."""
    return timeseries.first_valid(_log(spark, d), source="meter", time="time_stamp", value="volt", missing=-1.0)


@_query("select strftime(d, '%Y-%m-%d') as day, dayofweek(d) in (0, 6) as weekend from (select unnest(generate_series((select min(ts)::date from events)::timestamp, (select max(ts)::date from events)::timestamp, interval 1 day)) as d)")
def ts_day_marks(spark: SparkSession, d: str) -> DataFrame:
    """Days of the event table and weekends."""
    return timeseries.day_marks(table(spark, d, "events"), "ts").select(F.date_format("day", "yyyy-MM-dd").alias("day"), "weekend")


@_query(f"select logger_id from (select logger_id, row_number() over w as k, n_client, lag(n_client) over w as b from {_LOG} window w as (partition by meter order by time_stamp nulls first, logger_id)) where k = 1 or n_client is distinct from b")
def ts_compress(spark: SparkSession, d: str) -> DataFrame:
    """Readings at which the number of clients changes."""
    return timeseries.compress(_log(spark, d), source="meter", time="time_stamp", same=["n_client"], tie="logger_id").select("logger_id")


# streams


@_query("select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def stream_daily(spark: SparkSession, d: str) -> DataFrame:
    """Daily counts of the event table, read as a stream."""
    s = events.event_stream(spark, f"{d}/[e]vents.parquet", table(spark, d, "events").schema, "ts")
    rows = events.run_to_end(events.windowed(s, "ts", "1 day", ["event_type"], "value"), "daily", ["start", "stop", "event_type"])
    return rows.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@_query("""with f as (select *, case when lag(ts) over w is null or ts - lag(ts) over w >= interval 6 hours then 1 else 0 end as flag from events window w as (partition by user_id order by ts)),
 i as (select *, sum(flag) over (partition by user_id order by ts rows unbounded preceding) as k from f) select user_id, count(*) as n, count(distinct k) as sessions from i group by 1""")
def session_windows(spark: SparkSession, d: str) -> DataFrame:
    """Events and sessions per user, parted by pauses of six hours."""
    t = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return events.sessions(t, "ts", "6 hours", "user_id").groupBy("user_id").agg(F.sum("n").alias("n"), F.count("*").alias("sessions"))


# functions


@_query("select vec_id, len(embedding)::integer as n, embedding[1] as first, len(embedding)::integer + 1 as appended, len(embedding)::integer - 2 as erased from embeddings")
def fn_arrays(spark: SparkSession, d: str) -> DataFrame:
    """Number of values, access by index, append and erase."""
    e = F.col("embedding")
    more = F.array_append(e, F.lit(0.0).cast("float"))
    return table(spark, d, "embeddings").select("vec_id", F.size(e).alias("n"), F.element_at(e, 1).alias("first"), F.size(more).alias("appended"), F.size(erase(e, 1, 2)).alias("erased"))



@_query("select doc_id, url_encode(court) as encoded, court as back from documents where court is not null")
def fn_percent(spark: SparkSession, d: str) -> DataFrame:
    """Percent-encoding and back."""
    e = percent_encode(F.col("court"))
    return table(spark, d, "documents").filter("court is not null").select("doc_id", e.alias("encoded"), percent_decode(e).alias("back"))


@_query("select doc_id, regexp_extract(court, '^\\s*(\\S+)', 1) as word, length(docket) * 3600 // 86400 || 'd ' || length(docket) * 3600 % 86400 // 3600 || 'h 0m' as d from documents where court is not null and docket is not null")
def fn_word_duration(spark: SparkSession, d: str) -> DataFrame:
    """First word of a text, and a duration."""
    t = table(spark, d, "documents").filter("court is not null and docket is not null")
    return t.select("doc_id", first_word(F.col("court")).alias("word"), duration(F.length("docket") * 3600).alias("d"))


@_query("select p_partkey, p_size::bigint as back, printf('%g', p_retailprice) as g from part")
def fn_lexical(spark: SparkSession, d: str) -> DataFrame:
    """Hexadecimal there and back, and numbers in six digits."""
    return table(spark, d, "part").select("p_partkey", hex_in(F.lower(F.hex(F.col("p_size").cast("long")))).alias("back"), general_float(F.col("p_retailprice")).alias("g"))


@_query("select p_partkey, md5('<p>' || p_name || '</p>') as digest from part")
def fn_xml_digest(spark: SparkSession, d: str) -> DataFrame:
    """Digest of an XML document whose spelling differs from the canonical one."""
    return table(spark, d, "part").select("p_partkey", xml_digest(F.concat(F.lit("<p >"), "p_name", F.lit("</p >"))).alias("digest"))


# sinks


@_query("select o_orderstatus || ',' || count(*) as value from orders group by o_orderstatus")
def csv_sink(spark: SparkSession, d: str) -> DataFrame:
    return writers.csv_rows(QUERIES["count_group"](spark, d))


@_query("select '<result><binding name=\"s\"><literal>' || o_orderstatus || '</literal></binding><binding name=\"n\"><literal>' || count(*) || '</literal></binding></result>' as value from orders group by o_orderstatus")
def sparql_xml_sink(spark: SparkSession, d: str) -> DataFrame:
    return writers.sparql_xml_rows(QUERIES["count_group"](spark, d))


@_query(f"select '<ex:Nation rdf:about=\"{EX}nation_' || n_nationkey || '\"><ex:name>' || n_name || '</ex:name><ex:region rdf:resource=\"{EX}region_' || n_regionkey || '\"/></ex:Nation>' as value from nation")
def rdfxml_sink(spark: SparkSession, d: str) -> DataFrame:
    cat = shop(spark, d)
    return writers.rdf_xml_rows(cat, cat.classes[EX + "Nation"])


@_query(f"select {NAT('n_nationkey')} as x, n_name as n, {REG('n_regionkey')} as r from nation")
def rdfxml_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Nations written as RDF/XML and loaded again into emptied tables."""
    cat = shop(spark, d)
    folder = f"{shared_dir(spark)}/ontoloom/{spark.sparkContext.applicationId}/rdf-{uuid.uuid4().hex[:12]}"
    writers.write_rdf_xml(cat, folder, [EX + "Nation", EX + "Region"])
    bare = cat.with_tables({EX + c: (cat.classes[EX + c].table.limit(0), cat.classes[EX + c].prefix) for c in ("Nation", "Region")})
    return Engine(rdf.load(bare, folder).catalog).query("SELECT ?x ?n ?r WHERE { ?x a ex:Nation ; ex:name ?n ; ex:region ?r }")


@_query(f"select '{{\"id\":\"{EX}region_' || r_regionkey || '\",\"name\":\"' || r_name || '\"}}' as value from region")
def rest_sink(spark: SparkSession, d: str) -> DataFrame:
    cat = shop(spark, d)
    return writers.rest_rows(cat, cat.classes[EX + "Region"])
