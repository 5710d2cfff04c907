import datetime as dt

import pytest
from pyspark.sql import functions as F

from ontoloom.functions.iri import expand, is_blank, local, local_name
from ontoloom.operators import eav, orphans

D = lambda day, month=1: dt.datetime(2019, month, day)


def test_spellings(spark):
    rows = [(" #x\n",), ("mon:x",), ("http://monitor.example.org/#x",), ("x",), ("other:x",), ("",), ("  ",), (None,), ("#X",)]
    df = spark.createDataFrame(rows, "r string")
    got = [r[0] for r in df.select(local_name(expand(F.col("r")))).collect()]
    assert got == ["x", "x", "x", "x", "other:x", None, None, None, "X"]
    assert [r[0] for r in df.select(expand(F.col("r"), bare=True)).collect()][3] == "http://monitor.example.org/#x"
    assert [r[0] for r in df.select(expand(F.col("r"))).collect()][3] == "x"
    assert [r[0] for r in df.select(is_blank(F.col("r"))).collect()] == [False] * 5 + [True] * 3 + [False]


def missing(spark, lives, refs):
    p = spark.createDataFrame(lives, "k string, a timestamp, b timestamp, key string")
    c = spark.createDataFrame(refs, "k string, at timestamp, refs int")
    got = orphans.missing_keys(
        [orphans.tag_parents(p, "t", F.col("k"), F.col("a"), F.col("b"))], [orphans.tag_children(c, "t", F.col("k"), F.col("at"))]
    )
    return sorted((r.key, r["at"], r.refs) for r in got.collect())


def test_lives(spark):
    lives = [("a", D(1), D(5), "x"), ("a", D(1), D(5), "x"), ("a", D(9), None, "x"), ("b", D(3), D(2), "x"), ("c", None, None, "x"), ("d", D(2, 3), None, "x"), (None, D(1), None, "x")]
    refs = [(k, D(d), 7) for k in ("a", "b", "c") for d in (1, 4, 5, 9)] + [("d", D(1, 4), 1), ("d", D(1, 3), 1), (None, D(1), 1), ("a", None, 1), ("e", D(1), 1), ("e", D(1), 1)]
    want = [("a", D(5), 1), ("b", D(1), 1), ("b", D(4), 1), ("b", D(5), 1), ("b", D(9), 1), ("c", D(1), 1), ("c", D(4), 1), ("c", D(5), 1), ("c", D(9), 1), ("d", D(1, 3), 1), ("e", D(1), 2)]
    assert missing(spark, lives, refs) == want
    assert missing(spark, [], [("a", D(1), 1)]) == [("a", D(1), 1)]
    assert missing(spark, lives, []) == []


PROPS = {"n": ("int", False), "l": ("long", False), "d": ("double", False), "b": ("boolean", False), "t": ("dateTime", False), "s": ("string", False), "m": ("long", True)}


def wide(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], "s string, p string, v string, value string")
    return eav.wide(df, PROPS, subject=F.col("s"), attribute=F.col("p"), value=F.col("v"))


def test_readable(spark):
    cases = {
        "n": [(["7", "+07", " 7 "], 7), (["2147483648"], None), (["x", "5"], 5), (["5", "6"], None), (["1.0"], None), (["-0", "0"], 0)],
        "d": [(["1.5", "+1.50e0", "15e-1"], 1.5), (["1e999"], None), (["-0.0", "0"], 0.0), ([".5"], 0.5), (["1.2.3"], None), (["nan"], None)],
        "b": [(["true", "1"], True), (["0"], False), (["TRUE"], None), (["off"], None)],
        "t": [(["2019-12-19T06:06:14+03:00", "2019-12-19T03:06:14", "2019-12-19T03:06:14.000Z"], dt.datetime(2019, 12, 19, 3, 6, 14)), (["2019-02-30T00:00:00"], None), (["2019-02-01T24:00:00"], None), (["2019-02-01"], None)],
        "s": [(["a", " a\n"], "a"), (["a", "A"], None)],
    }
    rows, want = [], {}
    for p, xs in cases.items():
        for i, (vs, out) in enumerate(xs):
            rows += [(f"{p}{i}", p, v) for v in vs]
            want[f"{p}{i}"] = (p, out)
    got = {r.subject: r for r in wide(spark, rows).collect()}
    for s, (p, out) in want.items():
        assert got[s][p] == out, (s, got[s][p], out)
        assert got[s]._conflicts == ([] if out is not None else [p])


def test_session_zone_does_not_matter(spark):
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        rows = [("a", "t", "2019-03-31T02:30:00"), ("a", "t", "2019-03-31T02:30:00Z"), ("a", "t", "2019-03-31T04:30:00+02:00")]
        got = wide(spark, rows).select("_conflicts", F.unix_micros("t").alias("u")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got._conflicts == [] and got.u == int(dt.datetime(2019, 3, 31, 2, 30, tzinfo=dt.timezone.utc).timestamp()) * 10**6


def test_sets_and_cases(spark):
    rows = [("a", "n", "1"), ("a", "m", "2"), ("a", "m", "02"), ("a", "m", "3"), ("b", "n", "1"), ("c", "s", "x"), ("c", "zz", "y"), (None, "n", "1"), ("d", "n", None), ("d", "n", "  "), ("e", "m", "bad")]
    got = {r.subject: r for r in wide(spark, rows).collect()}
    assert set(got) == {"a", "b", "c", "e"}
    assert got["a"].m == [2, 3] and got["a"].n == 1 and got["b"].m is None and got["c"].s == "x"
    assert got["e"].m == [] and got["e"]._conflicts == []
    empty = wide(spark, [])
    assert empty.count() == 0 and set(PROPS) < set(empty.columns)
    assert wide(spark, [("a", "s", "y" * 200_000), ("a", "s", "y" * 200_000)]).first()._conflicts == []


def test_every_set_lies_together(spark):
    rows = [(f"{i}", p, "1") for i in range(200) for p in list(PROPS)[: 1 + i % 3]] + [("x", "n", "1"), ("x", "n", "2")]
    df = spark.createDataFrame(rows, "s string, p string, v string")
    got = eav.dense_tables(df, PROPS, subject=F.col("s"), attribute=F.col("p"), value=F.col("v"))
    sets = {tuple(sorted(list(PROPS)[:k])) for k in (1, 2, 3)} | {("n",)}
    assert {tuple(r._signature) for r in got.select("_signature").distinct().collect()} == sets
    first = got.filter(F.size("_signature") == 1).agg(*[F.count(p).alias(p) for p in PROPS]).first().asDict()
    assert [p for p, n in first.items() if n] == sorted({list(PROPS)[0]} | {"n"}, key=list(PROPS).index)
    parts = got.select(F.spark_partition_id().alias("k"), F.concat_ws(",", "_signature").alias("g")).collect()
    for k in {r.k for r in parts}:
        names = [r.g for r in parts if r.k == k]
        assert sum(a != b for a, b in zip(names, names[1:])) == len(set(names)) - 1
    with pytest.raises(ValueError):
        eav.wide(df, {"subject": ("int", False)}, subject=F.col("s"), attribute=F.col("p"), value=F.col("v"))


def test_local_names(spark):
    refs = ["#x", " mon:x\n", "x", "http://monitor.example.org/#x", "http://other/#x", "#", " ", "", None, "mon:", "MON:x", "#mon:x"]
    df = spark.createDataFrame([(r,) for r in refs], "r string")
    got = df.select(local(F.col("r")).alias("a"), local_name(expand(F.col("r"), bare=True)).alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got] and [r.a for r in got][:4] == ["x"] * 4


def test_rows_of_hot_pairs(spark, monkeypatch):
    links = spark.createDataFrame([(i, f"k{i % 3}", D(1 + i % 2)) for i in range(60)] + [(100, None, D(1)), (101, "k0", None)], "id long, k string, t timestamp")
    missing = links.filter("k IN ('k0', 'k1')").groupBy(F.lit("p").alias("parent_table"), F.col("k").alias("key"), F.col("t").alias("at")).agg(F.count("*").alias("refs")).filter("at is not null")
    want = {i for i in range(60) if i % 3 < 2}
    assert {r.id for r in orphans.rows_of(missing, links, F.col("k"), F.col("t")).collect()} == want
    monkeypatch.setattr(orphans, "broadcast_if_small", lambda df, *_: df)
    for hot in (0, 10, 10**6):
        got = orphans.rows_of(missing, links, F.col("k"), F.col("t"), hot=hot).collect()
        assert {r.id for r in got} == want and len(got) == 40
