import io
import math
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from ontoloom.__main__ import main

QUERIES, ORACLES = __spark_entry__.queries(), __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return c


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted([cell(r[i]) for i in order] for r in rows)


def test_names():
    assert set(ORACLES) <= set(QUERIES)
    for n in (1, 2, 3, 4, 5):
        assert f"p{n}_found" in QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    want = duck.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert got == table(names, want.fetchall())


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["n", "k"] and df.count() > 0


def test_command_line(spark, sf, capsys, monkeypatch):
    assert main(["schema", sf]) == 0
    assert "rdf:Property" in capsys.readouterr().out
    monkeypatch.setattr(sys, "stdin", io.StringIO("SELECT ?n WHERE { ex:nation_3 ex:name ?n }"))
    assert main(["query", sf, "--csv"]) == 0
    assert capsys.readouterr().out.split() == ["n", "NATION_3"]


def test_order_1_sorts_the_whole_table(spark, tmp_path):
    n = 100_001
    spark.range(n).selectExpr("id AS p_partkey", "'n' AS p_name", "'b' AS p_brand", "'t' AS p_type", "1 AS p_size", "double(id) AS p_retailprice").write.parquet(str(tmp_path / "part.parquet"))
    assert QUERIES["order_1"](spark, str(tmp_path)).count() == n
