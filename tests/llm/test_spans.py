import random

import numpy as np
import pytest

from ontoloom.llm import spans
from ontoloom.llm.spans import SharedSpans, anchors

SCHEMA = "doc_id long, text string, cls string, id int, n int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)


def brute(rows, k):
    texts = {}
    for i, t in rows:
        if i is not None and t is not None:
            texts.setdefault(i, set()).add(t)
    grams = {i: {t[j : j + k] for t in ts for j in range(len(t) - k + 1)} for i, ts in texts.items()}
    ids = sorted(grams)
    return {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if grams[a] & grams[b]}


def shared(rows, k):
    """Characters of each text inside spans that another text or copy has too."""
    out = {}
    for n, (i, t) in enumerate(rows):
        cover = np.zeros(len(t), bool)
        for m, (j, u) in enumerate(rows):
            if i != j:
                for x in range(len(t) - k + 1):
                    if t[x : x + k] in u:
                        cover[x : x + k] = True
        out[i] = int(cover.sum())
    return out


def corpus(seed, n=40, k=30):
    r = random.Random(seed)
    word = lambda m: "".join(r.choice("abcdef é😀") for _ in range(m))
    stock = [word(r.choice([k - 1, k, k + 1, 3 * k, k // 2 + 2])) for _ in range(8)]
    rows = []
    for i in range(n):
        parts = [word(r.randrange(0, 2 * k)) for _ in range(r.randrange(1, 5))]
        for _ in range(r.randrange(0, 3)):
            s = r.choice(stock)
            parts.insert(r.randrange(len(parts) + 1), s[r.choice([0, 0, 1]) :])
        rows.append((i, "".join(parts)))
    rows += [(n + 1, rows[0][1]), (n + 2, rows[0][1]), (n + 3, rows[1][1][:-1]), (n + 4, "a" * 90), (n + 5, "b" + "a" * 90), (n + 6, "ab" * 40), (n + 7, "ab" * 50)]
    return rows


@pytest.mark.parametrize(("seed", "hot", "chunk"), [(1, 64, 10**6), (2, 2, 10**6), (3, 4, 50), (4, 1, 10**6)])
def test_pairs_equal_brute_force(spark, seed, hot, chunk):
    rows = corpus(seed)
    got = SharedSpans(frame(spark, rows), min_len=30, hot=hot, chunk=chunk).pairs().collect()
    assert len(got) == len(set(got))
    assert {tuple(r) for r in got} == brute(rows, 30)


@pytest.mark.parametrize("hot", [64, 2])
def test_report_equals_brute_force(spark, hot):
    rows = corpus(7, n=20)
    got = {r.doc_id: r for r in SharedSpans(frame(spark, rows), min_len=30, hot=hot).report().collect()}
    want = shared(rows, 30)
    assert {i: r.shared_chars for i, r in got.items()} == {i: want[i] for i, t in rows if len(t) >= 30}
    assert all(r.share == r.shared_chars / r.n_chars for r in got.values())


def test_defined_cases(spark):
    t, u = "x" * 10 + "0123456789" * 20, "y" * 10 + "0123456789" * 20
    rows = [(1, t), (1, t), (1, u), (2, u), (3, t[:199]), (4, t[10:210]), (None, t), (5, None), (6, ""), (7, "0123456789" * 19 + "012345678")]
    got = {tuple(r) for r in SharedSpans(frame(spark, rows)).pairs().collect()}
    assert got == brute(rows, 200) and (1, 2) in got and (2, 4) in got
    assert SharedSpans(frame(spark, [])).pairs().count() == 0
    assert SharedSpans(frame(spark, [])).report().count() == 0
    with pytest.raises(ValueError):
        SharedSpans(frame(spark, []), min_len=1)


def test_hot_text_and_long_text(spark, monkeypatch):
    monkeypatch.setattr(spans, "BLOCK", 500)
    r = random.Random(3)
    long = "".join(r.choice("abcdefghij") for _ in range(20_000))
    rows = [(i, "same text " * 30) for i in range(60)] + [(100, long), (101, long[7000:7200]), (102, long[499:698]), (103, long[19_700:])]
    got = {tuple(x) for x in SharedSpans(frame(spark, rows)).pairs().collect()}
    assert len([p for p in got if p[1] < 60]) == 60 * 59 // 2
    assert {p for p in got if p[0] >= 60} == {(100, 101), (100, 103)}


def test_blocks_choose_the_same_anchors(monkeypatch):
    r = random.Random(5)
    text = "".join(r.choice("abcdefgh") for _ in range(5000))
    whole = anchors(text, spans._Roller(1), 20, 40)
    monkeypatch.setattr(spans, "BLOCK", 97)
    parts = anchors(text, spans._Roller(1), 20, 40)
    assert set(whole[0].tolist()) <= set(parts[0].tolist())
    assert sorted(zip(*(x.tolist() for x in whole))) == sorted(zip(*(x.tolist() for x in parts)))


def test_roller_equals_for_equal_substrings():
    roll = spans._Roller(1)
    a, b = roll("xx" + "abc😀d" * 9, 20), roll("abc😀d" * 9, 20)
    assert (a[2:] == b).all() and len(np.unique(b)) == 5
    assert len(roll("short", 20)) == 0
