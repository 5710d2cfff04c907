import random

import pytest

from ontoloom.operators.grid import regular_grid
from tests.brute import grid_missing, monotone_cubic

SCHEMA = "meter string, time_stamp long, volt double, s string, shard int, source string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)


def series(seed, n=300):
    r = random.Random(seed)
    rows = []
    for m in ("a", "b", "c"):
        t = r.randrange(0, 10_000)
        for _ in range(n):
            t += r.choice([30, 200, 600, 610, 1300, 4000, 9000, 700_000 if r.random() < 0.05 else 600])
            rows.append((m, t, r.choice([12.0, 12.5, 13.25, 11.0, None, float("nan"), -1.0, 14.0])))
    return rows


@pytest.mark.parametrize("shard", [14_400 + 600, 604_800])
def test_matches_brute_force(spark, shard):
    rows = series(1)
    got = regular_grid(frame(spark, rows), shard=shard).collect()
    assert {(r.source, r.period_start) for r in got if r.status != "observed"} == grid_missing(rows)
    assert len({(r.source, r.period_start) for r in got}) == len(got)
    by = {}
    for s, t, v in rows:
        if v is not None and v == v and v != -1:
            by.setdefault((s, t), []).append(v)
    points = {}
    for (s, t), v in sorted(by.items()):
        points.setdefault(s, []).append((t, sum(v) / len(v)))
    for r in got:
        mid = r.period_start + 300
        ps = points[r.source]
        before = [p for p in ps if p[0] < r.period_start]
        after = [p for p in ps if p[0] >= r.period_start + 600]
        if r.status == "observed":
            own = [v for t, v in ps if r.period_start <= t < r.period_start + 600]
            assert r.value == pytest.approx(sum(own) / len(own))
            continue
        gap = after[0][0] - before[-1][0]
        assert r.status == ("interpolated" if gap <= 7200 else "gap")
        if r.status == "gap":
            assert r.value is None
            continue
        i = ps.index(before[-1])
        lo = hi = i
        while lo and ps[lo][0] - ps[lo - 1][0] <= 7200:
            lo -= 1
        while hi + 1 < len(ps) and ps[hi + 1][0] - ps[hi][0] <= 7200:
            hi += 1
        seg = ps[lo : hi + 1]
        assert r.value == pytest.approx(monotone_cubic([p[0] for p in seg], [p[1] for p in seg], mid), abs=1e-9)
        assert min(before[-1][1], after[0][1]) - 1e-9 <= r.value <= max(before[-1][1], after[0][1]) + 1e-9


def test_defined_cases(spark):
    assert regular_grid(frame(spark, [])).count() == 0
    rows = [(None, 5, 1.0), ("a", None, 1.0), ("a", 5, None), ("b", 1200, 3.0), ("b", 1200, 5.0), ("b", 1200, 5.0)]
    got = regular_grid(frame(spark, rows)).collect()
    assert [(r.source, r.period_start, r.n_readings, r.status) for r in got] == [("b", 1200, 3, "observed")]
    assert got[0].value == pytest.approx(13 / 3)
    with pytest.raises(ValueError):
        regular_grid(frame(spark, []), shard=1000)


def test_time_range(spark):
    rows = [("a", 0, 1.0), ("a", 6000, 1.0), ("a", 9000, 2.0)]
    got = regular_grid(frame(spark, rows), time_from=6000, time_to=9000).collect()
    assert [(r.period_start, r.status) for r in got] == [(6000, "observed")]


def test_values_worked_by_hand(spark):
    """Slopes 0, 3/2, 0, 0 of the points 0, 1, 4, 4: the harmonic mean of 1 and 3 inside, flat ends and steps."""
    rows = [("m", 300 + 1200 * k, v) for k, v in enumerate([0.0, 1.0, 4.0, 4.0])]
    df = spark.createDataFrame(rows, "meter string, time_stamp long, volt double")
    got = {r.period_start: r.value for r in regular_grid(df).collect()}
    assert got == pytest.approx({0: 0.0, 600: 0.3125, 1200: 1.0, 1800: 2.6875, 2400: 4.0, 3000: 4.0, 3600: 4.0})


def test_shape_is_kept(spark):
    """Lines stay lines, and between two readings the curve never leaves their range or turns round."""
    r = random.Random(11)
    rows, t, v = [], 0, 0.0
    for _ in range(300):
        t += r.randrange(60, 6000)
        v += r.choice([0.0, 0.1, 5.0, 0.0, 2.0])
        rows += [("up", t, v), ("line", t, t * 0.25 + 3)]
    df = spark.createDataFrame(rows, "meter string, time_stamp long, volt double")
    got = [r for r in regular_grid(df).filter("status = 'interpolated'").orderBy("source", "period_start").collect()]
    assert len(got) > 500
    for g in got:
        mid = g.period_start + 300
        if g.source == "line":
            assert g.value == pytest.approx(mid * 0.25 + 3)
        else:
            before = max(x for x in rows if x[0] == "up" and x[1] <= mid)
            after = min(x for x in rows if x[0] == "up" and x[1] > mid)
            assert before[2] - 1e-9 <= g.value <= after[2] + 1e-9
    up = [g for g in got if g.source == "up"]
    assert all(a.value <= b.value + 1e-9 for a, b in zip(up, up[1:]))
