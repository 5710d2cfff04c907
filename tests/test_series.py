import pytest
from pyspark.sql import functions as F

from ontoloom.functions import lexical as L
from ontoloom.operators import history, shards, timeseries
from ontoloom.shop import shop
from ontoloom.streaming import events


def test_lexical(spark):
    values = [0.0, 1.0, -2.5, 123456.0, 1234567.0, 0.0001, 0.00001234, 1e100, 1 / 3, 99999.951, float("inf"), float("nan")]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(L.general_float(F.col("v"))).collect()]
    assert got == ["nan" if v != v else f"{v:g}" for v in values]
    df = spark.createDataFrame([(" 12abc", "ff zz"), ("x", "q"), ("-7.5e1", "0x1F")], "a string, b string")
    assert [tuple(r) for r in df.select(L.parse_prefix(F.col("a"), spark.range(1).schema["id"].dataType), L.hex_in(F.col("b"))).collect()] == [(12, 255), (0, 0), (-7, 31)]
    one = df.limit(1).select(L.duration(F.lit(93784)), L.percent_encode(F.lit("a b+é")), L.percent_decode(F.lit("a%20b+%C3%A9")), L.first_word(F.lit("  a b")), L.xml_escape(F.lit('<&">')), L.hex_out(F.lit(255))).first()
    assert tuple(one) == ("1d 2h 3m", "a%20b%2B%C3%A9", "a b+é", "a", "&lt;&amp;&quot;&gt;", "ff")
    assert df.limit(1).select(L.erase(F.array(*map(F.lit, [1, 2, 3])), 1), L.distance_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0))).first() == ([1, 3], pytest.approx(20015.09, abs=0.1))


def test_series(spark):
    df = spark.createDataFrame([("a", 0, 10, 0, 1), ("a", 600, 25, 600, 1), ("a", 1200, 5, 100, 1), ("a", 9000, 6, 8000, 2), ("b", 0, None, 0, None)], "s string, t long, c long, u long, k int")
    got = [r.delta for r in timeseries.counter_delta(df, source="s", time="t", counter="c", uptime="u", tie="c").orderBy("s", "t").collect()]
    assert got == [None, 15, 5, 1, None]
    isl = sorted((r.s, r.start, r.stop, r.n) for r in timeseries.islands(df, source="s", time="t", gap=3600).collect())
    assert isl == [("a", 0, 1200, 3), ("a", 9000, 9000, 1), ("b", 0, 0, 1)]
    assert [(r.from_time, r.to_time) for r in timeseries.breaks(df, source="s", time="t", gap=3600, tie="c").collect()] == [(1200, 9000)]
    assert timeseries.recent(df, "t", 8000).count() == 2
    assert timeseries.compress(df, source="s", time="t", same=["k"], tie="c").count() == 3
    assert [r[0] for r in spark.createDataFrame([(0.0,), (4.0,), (51.0,), (7.0,)], "x double").select(timeseries.nice_max(F.col("x"))).collect()] == [1.0, 5.0, 100.0, 10.0]
    for f in (lambda d: timeseries.islands(d, source="s", time="t", gap=1), lambda d: timeseries.recent(d, "t", 1), lambda d: timeseries.first_valid(d, source="s", time="t", value="c", missing=-1)):
        assert f(df.withColumn("c", F.col("c").cast("double")).limit(0)).count() == 0


def test_history(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("a", 3, "y"), ("b", 1, None)], "k string, t long, v string")
    assert sorted(tuple(r) for r in history.latest(df, "k", "t").collect()) == [("a", 3, "y"), ("b", 1, None)]
    assert history.snapshot(df, "k", "t", 2).count() == 2
    assert [tuple(r) for r in history.movement(df, "k", "v", "t").collect()] == [("a", 3, "x", "y")]
    assert history.chain(df, "k", "t", "t").filter("prev is null").count() == 2
    h = spark.createDataFrame([("a", "x", 0, None), ("b", "q", 0, 5)], "k string, v string, at long, until long")
    c = spark.createDataFrame([("a", "y", 7), ("b", "q", 8), ("c", "n", 9)], "k string, v string, at long")
    got = sorted((r.k, r.v, r["at"], r.until) for r in history.record(h, c, "k", "at").collect())
    assert got == [("a", "x", 0, 7), ("a", "y", 7, None), ("b", "q", 0, 5), ("b", "q", 8, None), ("c", "n", 9, None)]
    same = spark.createDataFrame([("a", "x", 7)], "k string, v string, at long")
    assert history.record(h, same, "k", "at").count() == 2


def test_streams(spark, sf, tmp_path):
    src = spark.read.parquet(f"{sf}/events.parquet")
    (tmp_path / "in").mkdir()
    src.repartition(3).write.mode("overwrite").parquet(str(tmp_path / "in"))
    s = events.event_stream(spark, str(tmp_path / "in"), src.schema, "ts", files=1)
    assert s.isStreaming
    q = events.windowed(s, "ts", "1 day", ["event_type"], "value").writeStream.format("memory").queryName("win").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    want = src.groupBy(F.window(F.col("ts").cast("timestamp"), "1 day"), "event_type").count()
    assert spark.table("win").count() == want.count() and spark.table("win").agg(F.sum("n")).first()[0] == src.count()
    sess = events.sessions(src.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 hour", "user_id")
    assert sess.agg(F.sum("n")).first()[0] == src.count()


def test_update_mode_gives_every_window_once(spark, sf, tmp_path):
    src = spark.read.parquet(f"{sf}/events.parquet")
    src.withColumn("day", F.to_date("ts")).repartitionByRange(4, "ts").drop("day").write.parquet(str(tmp_path / "in"))
    s = events.event_stream(spark, str(tmp_path / "in"), src.schema, "ts", late="60 days", files=1)
    rows = events.run_to_end(events.windowed(s, "ts", "1 day", ["event_type"], "value"), "days", ["start", "stop", "event_type"])
    want = src.groupBy(F.to_date("ts").alias("d"), "event_type").agg(F.count("*").alias("n"))
    assert {(str(r.d), r.event_type, r.n) for r in rows.select(F.to_date("start").alias("d"), "event_type", "n").collect()} == {(str(r.d), r.event_type, r.n) for r in want.collect()}


def test_stream_of_triples(spark, sf, tmp_path):
    from ontoloom.engine import Engine

    ex = "http://example.org/shop#"
    (tmp_path / "in").mkdir()
    rows = [(0, ex + "nation_3", ex + "name", "First", False), (1, ex + "nation_3", ex + "name", "Renamed", False), (2, ex + "nation_900", "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", ex + "Nation", True), (3, ex + "nation_900", ex + "name", "New", False), (4, ex + "nation_901", ex + "name", "nobody", False)]
    schema = "n long, s string, p string, o string, r boolean"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    e = Engine(shop(spark, sf))
    events.apply_triples(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), e, str(tmp_path / "cp")).awaitTermination()
    assert e.query("SELECT ?n WHERE { ex:nation_3 ex:name ?n }").first().n == "Renamed"
    assert [r.n for r in e.query("SELECT ?n WHERE { ex:nation_900 ex:name ?n }").collect()] == ["New"]
    assert e.query("SELECT ?n WHERE { ex:nation_901 ex:name ?n }").count() == 0


@pytest.mark.parametrize("shard", [50, 100_000])
def test_shards_equal_one_window(spark, shard):
    import random

    r = random.Random(4)
    rows = [(r.choice(["a", "a", "b", None]), r.choice([None, *range(0, 900, 7)]), i, r.choice([1, 1, 2, None])) for i in range(400)]
    df = spark.createDataFrame(rows, "s string, t long, i long, v long")
    got = {x.i: x for x in shards.running(shards.neighbours(df, "s", ["t", "i"], ["v"], shard=shard, ahead=True).withColumn("one", F.lit(1)), "s", ["t", "i"], "one", "k", shard=shard).collect()}
    assert len(got) == 400
    for source in ("a", "b", None):
        own = sorted((x for x in rows if x[0] == source), key=lambda x: (-1 if x[1] is None else x[1], x[2]))
        for k, x in enumerate(own):
            g = got[x[2]]
            before, after = (own[k - 1] if k else None), (own[k + 1] if k + 1 < len(own) else None)
            assert g.k == k + 1
            assert (g[shards.PREV] and (g[shards.PREV].i, g[shards.PREV].v)) == (before and (before[2], before[3]))
            assert (g[shards.NEXT] and (g[shards.NEXT].i, g[shards.NEXT].v)) == (after and (after[2], after[3]))
