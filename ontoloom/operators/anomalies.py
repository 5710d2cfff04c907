"""Implausible measurements per source: spikes, frozen values and impossible readings.

Readings are cut into weekly shards per source. Every shard is summed up once (slot medians per day, changes,
border readings, border runs, uptime state); the sums of one source, bounded by the days of the period, are put
together: robust principal components of its daily profile matrix give the normal behaviour, and each shard gets
the context that it needs from its neighbours. A second pass over the shards tests the readings. So a source with a
third of all rows is spread over its weeks, and the result is that of one scan per source in order of time.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoloom.session import materialize

_NULL_V, _NULL_U = -1e300, -(2**63)

IMPOSSIBLE, FROZEN, SPIKE, UPTIME = 1, 2, 4, 8
REASONS = {IMPOSSIBLE: "impossible", FROZEN: "frozen", SPIKE: "spike", UPTIME: "uptime"}


class Limits(NamedTuple):
    """What is impossible, frozen or a spike."""

    value_min: float = 0.0
    value_max: float = 60.0
    not_measured: float = -1.0
    uptime_max: int = 315_360_000
    frozen: int = 12
    run: int = 3
    level: int = 3600
    times: float = 8.0
    least: float = 0.5
    ahead: int = 3600
    slot: int = 600
    day: int = 86_400
    shard: int = 604_800


def _low_rank(x: np.ndarray, tau: float) -> np.ndarray:
    """Singular values of ``x`` shrunk by ``tau``, through the smaller Gram matrix."""
    wide = x.shape[0] <= x.shape[1]
    g = x @ x.T if wide else x.T @ x
    w, q = np.linalg.eigh(g)
    s = np.sqrt(np.maximum(w, 0))
    keep = s > tau
    if not keep.any():
        return np.zeros_like(x)
    q = q[:, keep]
    shrunk = q * ((s[keep] - tau) / s[keep])
    return shrunk @ (q.T @ x) if wide else (x @ q) @ shrunk.T


def robust_components(m: np.ndarray, rounds: int = 20, tol: float = 1e-3) -> np.ndarray:
    """Low-rank part of ``m`` by principal component pursuit (augmented Lagrangian); the rest is sparse."""
    norm = np.sqrt(max(np.linalg.eigvalsh(m @ m.T if m.shape[0] <= m.shape[1] else m.T @ m)[-1], 0))
    if norm == 0:
        return m.copy()
    lam = 1 / np.sqrt(max(m.shape))
    y = m / max(norm, np.abs(m).max() / lam)
    s, mu, low = np.zeros_like(m), 1.25 / norm, m
    total = np.linalg.norm(m)
    for _ in range(rounds):
        low = _low_rank(m - s + y / mu, 1 / mu)
        x = m - low + y / mu
        s = np.sign(x) * np.maximum(np.abs(x) - lam / mu, 0)
        r = m - low - s
        y = y + mu * r
        mu *= 1.6
        if np.linalg.norm(r) < tol * total:
            break
    return low


def normal_levels(slots: np.ndarray, medians: np.ndarray, per_row: int) -> np.ndarray:
    """Normal value of each occupied slot from the profile matrix with ``per_row`` slots in a row.

    ``slots`` are sorted slot numbers; rows without readings are left out, empty slots are filled along the row.
    """
    row, col = slots // per_row, slots % per_row
    rows, at = np.unique(row, return_inverse=True)
    # fill all empty cells at once: within a row by neighbours in time, never across rows
    m = np.empty((len(rows), per_row))
    bounds = np.searchsorted(at, np.arange(len(rows) + 1))
    grid = np.arange(per_row)
    for i in range(len(rows)):
        a, b = bounds[i], bounds[i + 1]
        m[i] = medians[a] if b == a + 1 else np.interp(grid, col[a:b], medians[a:b])
    center = np.median(m, axis=1, keepdims=True)
    return (robust_components(m - center) + center)[at, col]


class Shard(NamedTuple):
    """Arrays of one source and shard in order of time; ``v`` and ``u`` hold the marks of no measurement."""

    t: np.ndarray
    v: np.ndarray
    u: np.ndarray


def _measured(s: Shard, lim: Limits) -> tuple[np.ndarray, np.ndarray]:
    return ~np.isnan(s.v) & (s.v != _NULL_V) & (s.v != lim.not_measured), s.u != _NULL_U


def _possible(v: np.ndarray, lim: Limits) -> np.ndarray:
    return (v >= lim.value_min) & (v <= lim.value_max)


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of equal values."""
    start = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    return start, np.diff(np.r_[start, len(x)])


def _edges(x: np.ndarray) -> tuple | None:
    """First value, its run; last value, its run; whether all are equal; None for no readings."""
    if not len(x):
        return None
    start, n = _runs(x)
    return x[0], int(n[0]), x[-1], int(n[-1]), len(n) == 1


def _settle(z: np.ndarray, state: float, ahead: int) -> tuple[np.ndarray, float]:
    """Which readings run ahead of the last sound one, and the state afterwards."""
    flag = np.zeros(len(z), bool)
    if not len(z):
        return flag, state
    if z[0] <= state + ahead and (z[1:] <= z[:-1] + ahead).all():
        return flag, float(z[-1])
    for i, x in enumerate(z.tolist()):
        if x > state + ahead:
            flag[i] = True
        else:
            state = x
    return flag, state


def summarize(s: Shard, lim: Limits) -> dict:
    """What the other shards of the source need to know of this one."""
    has_v, has_u = _measured(s, lim)
    v_all, u_all = s.v[has_v], s.u[has_u]
    ok = has_v & _possible(s.v, lim)
    t, v = s.t[ok], s.v[ok]
    slot = t // lim.slot
    start = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]]) if len(slot) else np.empty(0, np.int64)
    med = v[start]
    if len(start) < len(v):
        n = np.diff(np.r_[start, len(v)])
        by_value = v[np.lexsort((v, slot))]
        med = (by_value[start + (n - 1) // 2] + by_value[start + n // 2]) / 2
    change, times = np.unique(np.abs(np.diff(v)), return_counts=True)
    head = int(np.searchsorted(t, t[min(lim.run - 1, len(t) - 1)] + lim.level, "right")) if len(t) else 0
    tail = int(np.searchsorted(t, t[-min(lim.run, len(t))] - lim.level, "left")) if len(t) else 0
    z, frozen_at = (u_all - s.t[has_u]).astype(float), np.zeros(len(u_all), bool)
    lead = trail = 0
    if len(u_all):
        begin, n = _runs(u_all)
        frozen_at = np.repeat(n >= lim.frozen, n)
        lead = int(n[0]) if n[0] < lim.frozen else 0
        trail = int(n[-1]) if n[-1] < lim.frozen and len(n) > 1 else 0
    bad = (u_all < 0) | (u_all > lim.uptime_max)
    keep = ~(frozen_at | bad)
    mid = slice(lead, len(z) - trail)
    zm = z[mid][keep[mid]]
    return {
        "v": _edges(v_all), "u": _edges(u_all), "nv": len(v_all), "nu": len(u_all),
        "slot": slot[start].astype(np.int32), "med": med.astype(np.float32),  # the components need no more digits
        "change": change, "times": times.astype(np.int32),
        "head": (t[:head], v[:head]), "tail": (t[tail:], v[tail:]), "n": len(t),
        "lead": z[:lead][~bad[:lead]], "trail": z[len(z) - trail :][~bad[len(z) - trail :]],
        "low": float(zm.min()) if len(zm) else None, "last": _settle(zm, np.inf, lim.ahead)[1] if len(zm) else None,
    }


def _weighted_median(x: np.ndarray, n: np.ndarray) -> float:
    if not len(x):
        return 0.0
    o = np.argsort(x)
    c = np.cumsum(n[o])
    k = c[-1]
    return float(x[o][np.searchsorted(c, (k - 1) // 2, "right")] + x[o][np.searchsorted(c, k // 2, "right")]) / 2


def contexts(parts: list[dict], lim: Limits) -> list[dict]:
    """Put the sums of one source, in order of time, together: what each shard must know."""
    n = len(parts)
    out: list[dict] = [{} for _ in range(n)]
    for name, count in (("v", "nv"), ("u", "nu")):
        for step, key, first, last in ((1, "before", 0, 2), (-1, "after", 2, 0)):
            run: tuple = (None, 0)
            for i in range(n)[::step]:
                out[i][name + key] = run
                e = parts[i][name]
                if e is not None:
                    if e[4]:
                        run = (e[0], parts[i][count] + (run[1] if run[0] == e[0] else 0))
                    else:
                        run = (e[last], e[last + 1])
    changes = [np.concatenate([p[x] for p in parts]) for x in ("change", "times")]
    ends = [(p["head"][1][0], p["tail"][1][-1]) for p in parts if p["n"]]
    gaps = np.abs(np.array([b[0] - a[1] for a, b in zip(ends, ends[1:])], float))
    limit = max(lim.least, lim.times * _weighted_median(np.r_[changes[0], gaps], np.r_[changes[1], np.ones(len(gaps), int)]))
    slots = np.concatenate([p["slot"] for p in parts]).astype(np.int64)
    med = np.concatenate([p["med"] for p in parts]).astype(float)
    levels = []
    if len(slots):
        for per_row in (lim.day // lim.slot, lim.day // lim.slot // 12):
            levels.append(normal_levels(slots, med, per_row).astype(np.float32))
    at = 0
    state = np.inf
    for i, p in enumerate(parts):
        k = len(p["slot"])
        out[i] |= {"limit": limit, "slot": p["slot"], "levels": [x[at : at + k] for x in levels]}
        at += k
        out[i]["left"] = _border(parts, i, -1, lim)
        out[i]["right"] = _border(parts, i, 1, lim)
        out[i]["state"] = state
        e = p["u"]
        if e is not None:
            whole = p["nu"] + (out[i]["ubefore"][1] if out[i]["ubefore"][0] == e[0] else 0)
            if e[4]:
                whole += out[i]["uafter"][1] if out[i]["uafter"][0] == e[0] else 0
                if whole < lim.frozen:
                    state = _settle(p["lead"], state, lim.ahead)[1]
            else:
                lead = e[1] + (out[i]["ubefore"][1] if out[i]["ubefore"][0] == e[0] else 0)
                if lead < lim.frozen:
                    state = _settle(p["lead"], state, lim.ahead)[1]
                if p["low"] is not None and p["low"] <= state + lim.ahead:
                    state = p["last"]
                trail = e[3] + (out[i]["uafter"][1] if out[i]["uafter"][0] == e[2] else 0)
                if trail < lim.frozen:
                    state = _settle(p["trail"], state, lim.ahead)[1]
    return out


def _border(parts: list[dict], i: int, step: int, lim: Limits) -> tuple[np.ndarray, np.ndarray]:
    """Readings of the neighbours that a run at the border and the hour beyond it can reach."""
    ts, vs, got = [], [], 0
    j = i + step
    while 0 <= j < len(parts):
        t, v = parts[j]["head" if step > 0 else "tail"]
        ts.append(t)
        vs.append(v)
        got += len(t)
        if got >= lim.run:
            flat = np.concatenate(ts if step > 0 else ts[::-1])
            third = flat[lim.run - 1] if step > 0 else flat[-lim.run]
            if len(t) < parts[j]["n"] or abs(flat[-1 if step > 0 else 0] - third) > lim.level:
                break
        j += step
    if not ts:
        return np.empty(0, np.int64), np.empty(0)
    return (np.concatenate(ts), np.concatenate(vs)) if step > 0 else (np.concatenate(ts[::-1]), np.concatenate(vs[::-1]))


def _frozen(x: np.ndarray, before: tuple, after: tuple, least: int) -> np.ndarray:
    if not len(x):
        return np.zeros(0, bool)
    start, n = _runs(x)
    whole = n.copy()
    if before[0] == x[0]:
        whole[0] += before[1]
    if after[0] == x[-1]:
        whole[-1] += after[1]
    return np.repeat(whole >= least, n)


def _least(v: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least of ``v[lo:hi]`` for each pair; infinite for an empty one."""
    out = np.full(len(lo), np.inf)
    size, table = 1, v
    while True:
        at = np.flatnonzero((hi - lo >= size) & (hi - lo < 2 * size))
        out[at] = np.minimum(table[lo[at]], table[hi[at] - size])
        if not (hi - lo >= 2 * size).any():
            return out
        table = np.minimum(table[:-size], table[size:])
        size *= 2


def outliers(t: np.ndarray, v: np.ndarray, limit: float, lim: Limits) -> np.ndarray:
    """Which readings can be in a spike: a superset for the exact test, whatever the normal behaviour.

    A level is a median, so a value beyond it by ``limit`` is beyond the extreme of its hour by as much; the hours of
    every run that holds a reading lie in the stretches before and after it that are looked at here.
    """
    n = len(v)
    i = np.arange(n)
    before = np.searchsorted(t, t[np.maximum(i - lim.run + 1, 0)] - lim.level, "left"), i
    after = i + 1, np.searchsorted(t, t[np.minimum(i + lim.run - 1, n - 1)] + lim.level, "right")
    flag = np.zeros(n, bool)
    for x in (v, -v):
        low = np.maximum(_least(x, *before), _least(x, *after))
        flag |= x > low + limit
    return flag


def spikes(t: np.ndarray, v: np.ndarray, candidates: np.ndarray, limit: float, lim: Limits) -> np.ndarray:
    """The exact test around the candidates: runs of at most ``lim.run`` readings beyond both levels."""
    flag = np.zeros(len(v), bool)
    near = np.zeros(len(v) + lim.run, bool)
    for k in range(1 - lim.run, lim.run):  # what a run with a candidate can touch
        near[np.clip(candidates + k, 0, len(v) - 1)] = True
    at = np.flatnonzero(near[: len(v)])
    spans = [np.searchsorted(t, x, side).tolist() for x, side in ((t[at] - lim.level, "left"), (t[at], "left"), (t[at], "right"), (t[at] + lim.level, "right"))]
    values = v.tolist()

    def median(lo: int, hi: int) -> float:
        x = sorted(values[lo:hi])
        n = hi - lo
        return (x[(n - 1) // 2] + x[n // 2]) / 2 if n else float("nan")

    before = {i: median(lo, hi) for i, lo, hi in zip(at.tolist(), spans[0], spans[1])}
    after = {i: median(lo, hi) for i, lo, hi in zip(at.tolist(), spans[2], spans[3])}
    for i in candidates.tolist():
        for a in range(max(0, i - lim.run + 1), i + 1):
            for b in range(i, min(a + lim.run, len(v))):
                lo, hi = before[a], after[b]
                part = values[a : b + 1]
                if min(part) > max(lo, hi) + limit or max(part) < min(lo, hi) - limit:
                    if lo == lo and hi == hi:
                        flag[a : b + 1] = True
    return flag


def judge(s: Shard, ctx: dict, lim: Limits) -> np.ndarray:
    """Reasons of each reading of one shard as bits."""
    out = np.zeros(len(s.t), np.int32)
    has_v, has_u = _measured(s, lim)
    possible = _possible(s.v, lim)
    bad_u = has_u & ((s.u < 0) | (s.u > lim.uptime_max))
    out[(has_v & ~possible) | bad_u] |= IMPOSSIBLE
    out[np.flatnonzero(has_v)[_frozen(s.v[has_v], ctx["vbefore"], ctx["vafter"], lim.frozen)]] |= FROZEN
    still = np.zeros(len(s.t), bool)
    still[np.flatnonzero(has_u)[_frozen(s.u[has_u], ctx["ubefore"], ctx["uafter"], lim.frozen)]] = True
    out[still] |= FROZEN
    sound = np.flatnonzero(has_u & ~still & ~bad_u)
    out[sound[_settle((s.u[sound] - s.t[sound]).astype(float), ctx["state"], lim.ahead)[0]]] |= UPTIME
    own = np.flatnonzero(has_v & possible)
    if len(own):
        at = np.searchsorted(ctx["slot"], s.t[own] // lim.slot)
        far = np.zeros(len(own), bool)
        for level in ctx["levels"]:
            far |= np.abs(s.v[own] - level[at]) > ctx["limit"] / 2
        (lt, lv), (rt, rv) = ctx["left"], ctx["right"]
        t, v = np.r_[lt, s.t[own], rt], np.r_[lv, s.v[own], rv]
        far |= outliers(t, v, ctx["limit"], lim)[len(lt) : len(lt) + len(own)]
        cand = np.flatnonzero(far)
        if len(cand):
            flag = spikes(t, v, cand + len(lt), ctx["limit"], lim)
            out[own[flag[len(lt) : len(lt) + len(own)]]] |= SPIKE
    return out


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list]]:
    """Columns of one key after another, as arrays, from batches that are sorted by their first ``keys`` columns."""
    held: list[list] = []
    key: tuple | None = None

    def joined() -> list:
        return held[0] if len(held) == 1 else [np.concatenate(c) for c in zip(*held)]

    for b in batches:
        if not b.num_rows:
            continue
        change = np.zeros(b.num_rows, bool)
        names = []
        for c in range(keys):
            col = b.column(c)
            if pa.types.is_string(col.type):
                coded = col.dictionary_encode()
                x, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
                names.append((x, words))
            else:
                x = col.to_numpy(zero_copy_only=False)
                names.append((x, None))
            change[1:] |= x[1:] != x[:-1]
        rest = [b.column(c).to_numpy(zero_copy_only=False) for c in range(keys, b.num_columns)]
        cuts = [0, *np.flatnonzero(change).tolist(), b.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            here = tuple(words[x[lo]] if words is not None else int(x[lo]) for x, words in names)
            if here != key:
                if held:
                    yield key, joined()
                held, key = [], here
            held.append([x[lo:hi] for x in rest])
    if held:
        yield key, joined()


def _flush(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(zip(*rows), types)], names=names)


def _sum_batches(lim: Limits) -> Callable:
    def run(batches):
        rows = []
        for (source, shard), part in _groups(batches, 2):
            rows.append((source, shard, pickle.dumps(summarize(Shard(*part), lim))))
            if len(rows) >= 500:
                yield _flush(rows, ["s", "shard", "sums"], [pa.string(), pa.int64(), pa.binary()])
                rows = []
        if rows:
            yield _flush(rows, ["s", "shard", "sums"], [pa.string(), pa.int64(), pa.binary()])

    return run


def _context_batches(lim: Limits) -> Callable:
    def run(batches):
        for (source,), part in _groups(batches, 1):
            got = contexts([pickle.loads(x) for x in part[1]], lim)
            yield _flush([(source, int(k), pickle.dumps(c)) for k, c in zip(part[0], got)], ["s", "shard", "ctx"], [pa.string(), pa.int64(), pa.binary()])

    return run


def _judge_batches(lim: Limits) -> Callable:
    names, types = ["s", "t", "v", "u", "reasons"], [pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.int32()]

    def run(batches):
        rows: list[tuple] = []
        for (source, _), (ctx, t, v, u) in _groups(batches, 2):
            part = Shard(t[1:], v[1:], u[1:])  # the context sorts first
            reasons = judge(part, pickle.loads(ctx[0]), lim)
            hit = np.flatnonzero(reasons)
            rows.extend((source, *x) for x in zip(part.t[hit].tolist(), part.v[hit].tolist(), part.u[hit].tolist(), reasons[hit].tolist()))
            if len(rows) >= 5000:
                yield _flush(rows, names, types)
                rows = []
        if rows:
            yield _flush(rows, names, types)

    return run


def implausible(
    readings: DataFrame, *, source: str = "meter", time: str = "time_stamp", value: str = "volt", uptime: str = "uptime", time_from: int | None = None, time_to: int | None = None, limits: Limits | None = None
) -> DataFrame:
    """The rows of ``readings`` that are implausible, with ``_reasons``, bits of ``REASONS``.

    Method: robust principal components on the profile matrix of each source (a row per day, and again a row per
    two hours, as a source of few days has few rows) part normal behaviour from sparse deviations; deviations of
    half the spike limit are candidates. So is every reading that stands out of the hours around it (``outliers``),
    as spikes on a schedule are normal behaviour to the matrix. The rule for spikes is tested exactly around the
    candidates. Constant runs, ranges and uptime are tested apart from that.

    Cases: a null source or time, or a time outside ``[time_from, time_to)``, is never implausible and never
    looked at. Null, NaN and -1 are no measurement: never flagged, skipped. Rows with equal source, time, value
    and uptime are one reading, and all of them are returned. Readings of one time are taken in order of value
    and uptime. Without a reading in the hour before or after there is no level and no spike. The first uptime
    of a source is sound. Empty tables give no rows. Other columns are returned as they are; a column that is
    called ``_reasons`` is replaced.
    """
    lim = limits or Limits()
    t = F.col(time).cast("long")
    v, u = F.coalesce(F.col(value).cast("double"), F.lit(_NULL_V)), F.coalesce(F.col(uptime).cast("long"), F.lit(_NULL_U).cast("long"))
    inside = F.col(source).isNotNull() & t.isNotNull()
    if time_from is not None:
        inside &= t >= time_from
    if time_to is not None:
        inside &= t < time_to
    spark = readings.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    one = readings.filter(inside).select(F.col(source).cast("string").alias("s"), t.alias("t"), v.alias("v"), u.alias("u")).distinct()
    one = one.select("s", F.floor(F.col("t") / lim.shard).alias("shard"), F.lit(None).cast("binary").alias("ctx"), "t", "v", "u")
    sums = one.drop("ctx").repartition(parts, "s", "shard").sortWithinPartitions("s", "shard", "t", "v", "u").mapInArrow(_sum_batches(lim), "s string, shard long, sums binary")
    ctx = sums.repartition(parts, "s").sortWithinPartitions("s", "shard").mapInArrow(_context_batches(lim), "s string, shard long, ctx binary")
    ctx = materialize(ctx, "contexts")
    both = one.unionByName(ctx.select("s", "shard", "ctx", F.lit(-(2**62)).cast("long").alias("t"), F.lit(0.0).alias("v"), F.lit(0).cast("long").alias("u")))
    hits = (
        both.repartition(parts, "s", "shard")
        .sortWithinPartitions("s", "shard", F.col("ctx").isNull(), "t", "v", "u")
        .mapInArrow(_judge_batches(lim), "s string, t long, v double, u long, reasons int")
    )
    hits = hits.select(F.col("s").alias("__ol_source"), F.col("t").alias("__ol_time"), F.col("v").alias("__ol_value"), F.col("u").alias("__ol_uptime"), F.col("reasons").alias("__ol_reasons"))
    on = (F.col(source).cast("string") == F.col("__ol_source")) & (t == F.col("__ol_time")) & (v == F.col("__ol_value")) & (u == F.col("__ol_uptime"))
    kept = [c for c in readings.columns if c != "_reasons"]
    return readings.join(hits, on).select(*kept, F.col("__ol_reasons").alias("_reasons"))


def reason_names(bits) -> object:
    """``_reasons`` as names joined by blanks, in order of ``REASONS``."""
    return F.concat_ws(" ", *(F.when(bits.bitwiseAND(F.lit(b)) > 0, F.lit(n)) for b, n in REASONS.items()))
