"""Plain versions of operators, to compare with on small inputs."""

from __future__ import annotations

import math

import numpy as np


def implausible_rows(rows: list[tuple], t_from: int | None = None, t_to: int | None = None) -> dict:
    """``rows`` of (id, source, time, value, uptime): reasons by id, one scan per source."""
    by: dict = {}
    for i, s, t, v, u in rows:
        if s is None or t is None or (t_from is not None and t < t_from) or (t_to is not None and t >= t_to):
            continue
        v = None if v is None or math.isnan(v) or v == -1 else float(v)
        by.setdefault(s, {}).setdefault((t, v, u), []).append(i)
    out: dict = {}
    for readings in by.values():
        keys = sorted(readings, key=lambda k: (k[0], -math.inf if k[1] is None else k[1], -math.inf if k[2] is None else k[2]))
        why: dict = {k: set() for k in keys}
        for which, name in ((1, "v"), (2, "u")):
            seq = [k for k in keys if k[which] is not None]
            run: list = []
            for k in [*seq, None]:
                if run and (k is None or k[which] != run[-1][which]):
                    if len(run) >= 12:
                        for x in run:
                            why[x].add("frozen" + name)
                    run = []
                if k is not None:
                    run.append(k)
        for k in keys:
            if k[1] is not None and not 0 <= k[1] <= 60:
                why[k].add("impossible")
            if k[2] is not None and not 0 <= k[2] <= 315_360_000:
                why[k].add("impossibleu")
        sound = None
        for k in keys:
            if k[2] is None or "frozenu" in why[k] or "impossibleu" in why[k]:
                continue
            if sound is not None and k[2] > sound[2] + (k[0] - sound[0]) + 3600:
                why[k].add("uptime")
            else:
                sound = k
        ok = [k for k in keys if k[1] is not None and 0 <= k[1] <= 60]
        t, v = np.array([k[0] for k in ok], float), np.array([k[1] for k in ok], float)
        limit = max(0.5, 8 * float(np.median(np.abs(np.diff(v))))) if len(v) > 1 else 0.5
        for a in range(len(v)):
            for n in (1, 2, 3):
                b = a + n
                if b > len(v):
                    break
                before, after = v[(t >= t[a] - 3600) & (t < t[a])], v[(t > t[b - 1]) & (t <= t[b - 1] + 3600)]
                if not len(before) or not len(after):
                    continue
                d = np.r_[v[a:b] - np.median(before), v[a:b] - np.median(after)]
                if (d > limit).all() or (d < -limit).all():
                    for x in ok[a:b]:
                        why[x].add("spike")
        names = {"frozenv": "frozen", "frozenu": "frozen", "impossibleu": "impossible"}
        for k, w in why.items():
            if w:
                for i in readings[k]:
                    out[i] = {names.get(x, x) for x in w}
    return out


def grid_missing(rows: list[tuple], period: int = 600) -> set:
    """``rows`` of (source, time, value): periods without a usable reading between first and last."""
    seen: dict = {}
    for s, t, v in rows:
        if s is not None and t is not None and v is not None and not math.isnan(v) and v != -1:
            seen.setdefault(s, set()).add(t // period)
    return {(s, k * period) for s, ks in seen.items() for k in range(min(ks), max(ks)) if k not in ks}


def monotone_cubic(t: list[float], v: list[float], x: float) -> float:
    """Value at ``x`` of the shape-preserving cubic through the points of one segment."""
    n = len(t)
    h = [t[i + 1] - t[i] for i in range(n - 1)]
    d = [(v[i + 1] - v[i]) / h[i] for i in range(n - 1)]

    def edge(h0, h1, d0, d1):
        s = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
        if s * d0 <= 0 and not (s == 0 and d0 == 0):
            return 0.0
        return 3 * d0 if d0 * d1 <= 0 and abs(s) > 3 * abs(d0) else s

    if n == 2:
        m = [d[0], d[0]]
    else:
        m = [edge(h[0], h[1], d[0], d[1])]
        for i in range(1, n - 1):
            if d[i - 1] * d[i] <= 0:
                m.append(0.0)
            else:
                w0, w1 = 2 * h[i] + h[i - 1], h[i] + 2 * h[i - 1]
                m.append((w0 + w1) / (w0 / d[i - 1] + w1 / d[i]))
        m.append(edge(h[-1], h[-2], d[-1], d[-2]))
    i = max(k for k in range(n - 1) if t[k] <= x)
    s = (x - t[i]) / h[i]
    return v[i] * (1 + 2 * s) * (1 - s) ** 2 + h[i] * m[i] * s * (1 - s) ** 2 + v[i + 1] * s * s * (3 - 2 * s) + h[i] * m[i + 1] * s * s * (s - 1)
