import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ontoloom.operators.anomalies import Limits, implausible, reason_names
from tests.brute import implausible_rows

SCHEMA = "logger_id long, meter string, time_stamp long, volt float, uptime long, s string, t int, v int, _reasons string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], SCHEMA)


def check(spark, rows, **kw):
    got = implausible(frame(spark, rows), **kw).select("logger_id", reason_names(F.col("_reasons")).alias("r")).collect()
    assert {r.logger_id: set(r.r.split()) for r in got} == implausible_rows(rows)


def series(seed, meters=3, n=500):
    r = random.Random(seed)
    rows, i = [], 0
    for m in range(meters):
        t, u, v = r.randrange(10**9), r.randrange(10**6), 12.0
        frozen = 0
        for _ in range(n):
            step = r.choice([600, 600, 610, 590, 300, 1200]) if r.random() > 0.02 else r.choice([90_000, 700_000])
            t, u = t + step, u + step
            if r.random() < 0.02:
                u = r.randrange(1000)
            if frozen <= 0:
                v = min(15.0, max(10.0, v + r.choice([-0.05, 0.0, 0.05])))
                if r.random() < 0.01:
                    frozen = r.choice([8, 11, 12, 13, 40])
            frozen -= 1
            x, w = v, u
            p = r.random()
            if p < 0.02:
                x = v + r.choice([-3, 2, 5])
            elif p < 0.03:
                x = r.choice([-5.0, 80.0, None, float("nan"), -1.0])
            if r.random() < 0.01:
                w = r.choice([u + 5000, u + 10**6, -4, 4 * 10**8, None])
            x = None if x is None else round(x, 2)
            for _ in range(2 if r.random() < 0.02 else 1):
                rows.append((i, f"m{m}", t, x, w))
                i += 1
    return [(a, b, c, None if d is None else float(__import__("numpy").float32(d)), e) for a, b, c, d, e in rows]


@pytest.mark.parametrize("shard", [604_800, 86_400, 1_800])
def test_matches_one_scan(spark, shard):
    check(spark, series(5), limits=Limits(shard=shard))


def test_defined_cases(spark):
    check(spark, [])
    check(spark, [(1, None, 5, 99.0, 1), (2, "a", None, 99.0, 1), (3, "a", 5, None, None), (4, "a", 5, 99.0, None), (5, "a", 5, 99.0, None)])
    check(spark, [(i, "a", i * 600, 12.0, 5 + i) for i in range(12)])
    check(spark, [(i, "a", i * 600, 12.0 + i % 2, 7) for i in range(12)])
    df = frame(spark, [(1, "a", 5, 99.0, 1)])
    assert implausible(df).columns == df.columns


@pytest.mark.parametrize("every", [4, 6, 12])
def test_spikes_on_a_schedule(spark, every):
    r = random.Random(every)
    v = [12.0 + r.gauss(0, 0.03) + (1.5 if i % every == 3 else 0) for i in range(4320)]
    rows = [(i, "a", 1_546_300_800 + i * 600, float(np.float32(round(x, 2))), i * 600) for i, x in enumerate(v)]
    want = implausible_rows(rows)
    assert sum("spike" in w for w in want.values()) > 4000 // every
    check(spark, rows)
