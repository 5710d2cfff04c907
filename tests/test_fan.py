import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from ontoloom.engine import Engine
from ontoloom.plans import planner
from tests.graphs import catalog
from tests.test_entry import ORACLES, duck, table  # noqa: F401
from tests.test_graph import rows

FAN_IN = __spark_entry__.queries()["fan_in_shared_object"]


def write(spark, folder, customers, suppliers):
    """Tables of nation keys, one per row."""
    for name, x, nations in (("customer", "c", customers), ("supplier", "s", suppliers)):
        key = "c_custkey" if x == "c" else "s_suppkey"
        more = ["'m' AS c_mktsegment"] if x == "c" else []
        df = spark.createDataFrame(list(enumerate(nations)), f"{key} bigint, {x}_nationkey int")
        df.selectExpr("*", f"'n' AS {x}_name", f"1.0D AS {x}_acctbal", *more).coalesce(1).write.parquet(f"{folder}/{name}.parquet")


def test_pairs_of_one_nation_are_made_in_several_tasks(spark, tmp_path):
    n = 3000
    write(spark, tmp_path, [7] * n, [7] * n)
    df = FAN_IN(spark, str(tmp_path))
    made = df.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n"), F.max(F.length("c") + F.length("s"))).collect()
    assert sum(r.n for r in made) == n * n and max(r.n for r in made) <= n * n / 2
    one = df.filter(F.col("c").endswith("_2999")).select("s").distinct().count()
    assert one == n and df.filter(F.col("s").endswith("_2999")).select("c").distinct().count() == n


@pytest.fixture
def always(monkeypatch):
    """Every join of two sides with several rows of a key is spread, in blocks of two rows."""
    spread, used = planner.Planner._spread, []
    for k, v in (("BLOCK", 2), ("TASK_ROWS", 1), ("FAN", 0)):
        monkeypatch.setattr(planner, k, v)
    monkeypatch.setattr(planner.Planner, "_spread", lambda *a: (x := spread(*a), used.append(x is not None))[0])
    return used


def test_spread_pairs_with_nulls_and_keys_of_one_side(spark, tmp_path, always):
    rand = random.Random(3)
    c, s = ([rand.choice([None, 0, 0, 0, 1, 2, k]) for _ in range(40)] for k in (3, 4))
    write(spark, tmp_path, c, s)
    want = Counter((i, j) for i, x in enumerate(c) for j, y in enumerate(s) if x is not None and x == y)
    got = Counter(tuple(int(v.rpartition("_")[2]) for v in r) for r in FAN_IN(spark, str(tmp_path)).collect())
    assert got == want and always == [True]


def test_spread_query_equals_sql(spark, sf, duck, always):  # noqa: F811
    df = FAN_IN(spark, sf)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    want = duck.execute(ORACLES["fan_in_shared_object"])
    assert got == table([d[0] for d in want.description], want.fetchall()) and always == [True]


TEXTS = [
    "SELECT ?x ?y ?v WHERE { ?x ex:n ?v . ?y ex:n ?v }",
    "SELECT ?x ?y WHERE { ?x ex:many ?z . ?y ex:many ?z }",
    "SELECT ?x ?z ?y WHERE { ?x ex:link ?z . ?y ex:many ?z . FILTER(?x != ?y) } ORDER BY ?z ?x",
    "SELECT ?v COUNT(?x) AS ?k WHERE { ?x ex:nums ?v . ?y ex:n ?v } ORDER BY ?v",
    "SELECT ?x ?y WHERE { ?x ex:link ?z ; ex:n ?v . ?y ex:link ?z ; ex:nums ?v }",
    "SELECT ?x ?o WHERE { ?x ?p ?o . ?y ?p ?o }",
    "SELECT ?x ?h WHERE { ?x ex:hexed ?h . ?y ex:n ?h }",
    "SELECT ?w WHERE { ?x ex:link ?z . ?y ex:link ?z . ?y ex:n ?w }",
]


@pytest.mark.parametrize("text", TEXTS)
def test_spread_joins_equal_ordinary_ones(spark, text, monkeypatch):
    e = Engine(catalog(spark))
    want = rows(e.query(text))
    for k, v in (("BLOCK", 1), ("TASK_ROWS", 1), ("FAN", 0)):
        monkeypatch.setattr(planner, k, v)
    assert rows(e.query(text)) == want and want
    monkeypatch.setattr(planner.Planner, "_spread", lambda *a: None)
    assert rows(e.query(text)) == want
