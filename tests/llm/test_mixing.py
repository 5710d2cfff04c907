import base64

import pytest
from pyspark.sql import functions as F

from ontoloom.llm import mixing
from ontoloom.llm.mixing import TOKENIZER, Mixture, _encoding, budgets, count_tokens, source_name, token_counts

DOCS = "doc_id long, text string, source string, tokens int, copies string, h string"
TARGETS = "source string, target_share double, max_repeats int"


def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], DOCS)


def corpus(n=600):
    rows = []
    for i in range(n):
        s = "big" if i % 3 else ("Mid " if i % 2 else "small-one")
        rows.append((i, f"text number {i} " * (1 + i % 7), s))
    return rows + [(10_000, "never used", "unlisted"), (10_001, "no source", None), (10_002, None, "big"), (10_003, "", "BIG")]


def test_tokens_equal_the_library(spark):
    texts = ["Hello world's 12 été!\n\n  x", "", None, "a" * 50_000, " " * 20_000 + "end"]
    got = token_counts(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), "text", "n").orderBy("i").collect()
    with open(TOKENIZER, "rb") as f:
        e = _encoding(f.read())
    assert [r.n for r in got] == [0 if t is None else len(e.encode_ordinary(t)) for t in texts]
    assert e.decode(e.encode_ordinary(texts[0])) == texts[0]
    with open(TOKENIZER, "rb") as f:
        assert base64.b64decode(f.readline().split()[0])


def test_long_white_space(monkeypatch):
    with open(TOKENIZER, "rb") as f:
        ranks = f.read()
    texts = [a + w * 40 + b for a in ("", "x", "é ") for w in (" ", "\n", " \t", "\u2003\x1c", "\xa0") for b in ("", "end", " end", "\nx" + " " * 50 + "y")]
    plain = [count_tokens(t, ranks) for t in texts]
    monkeypatch.setattr(mixing, "LONG_SPACE", 10)
    assert [count_tokens(t, ranks) for t in texts] == plain
    monkeypatch.setattr(mixing, "LONG_SPACE", 50_000)
    assert count_tokens(" " * 3_000_000 + "x", ranks) > 0 and count_tokens("\n" * 3_000_000, ranks) > 0


def test_names(spark):
    df = spark.createDataFrame([(" Court-Portal ",), ("LAW REPORTS",), ("",), (" ",), (None,)], "s string")
    assert [r[0] for r in df.select(source_name(F.col("s"))).collect()] == ["court_portal", "law_reports", None, None, None]


def test_budgets(spark):
    schema = "source string, share double, repeats long, tokens long"
    t = spark.createDataFrame([("a", 0.5, 1, 1000), ("b", 0.3, 4, 100), ("c", 0.2, 2, 0)], schema)
    got = {r.source: r.wanted for r in budgets(t, None).collect()}
    assert got == {"a": 666, "b": 400}  # 5 to 3 in whole tokens
    assert {r.source: r.wanted for r in budgets(t, 10_000).collect()} == {"a": 1000, "b": 400}
    assert budgets(t.limit(0), None).count() == 0


def test_thresholds_equal_a_scan_in_order_of_hash(spark):
    d = docs(spark, corpus())
    t = spark.createDataFrame([("big", 0.6, 2), ("mid", 0.3, 3), ("small_one", 0.1, 1)], TARGETS)
    for total in (None, 2500, 7777):
        m = Mixture(d, t, total=total)
        sizes = m.sizes.collect()
        have = {s: sum(r.tokens for r in sizes if r.source == s) for s in ("big", "mid", "small_one")}
        share, repeats = {"big": 0.6, "mid": 0.3, "small_one": 0.1}, {"big": 2, "mid": 3, "small_one": 1}
        size = total or min(repeats[s] * have[s] / share[s] for s in have)
        got = {(r.source, r.doc_id): r.copies for r in m.rows().collect()}
        for s in have:
            left = min(repeats[s] * have[s], int(share[s] * size + 1e-5))
            whole = min(left // have[s], repeats[s])
            left -= whole * have[s]
            for r in sorted((x for x in sizes if x.source == s), key=lambda x: x.h):
                more = whole < repeats[s] and r.tokens <= left
                left = left - r.tokens if more else -1
                assert got.get((s, r.doc_id), 0) == whole + more


def test_many_targets(spark):
    t = spark.createDataFrame([(f"s{i}", 1 / 12_000, 1) for i in range(12_000)], TARGETS)
    d = docs(spark, [(i, "some words", f"s{i % 12_000}") for i in range(13_000)])
    m = Mixture(d, t)
    assert m.plan.count() == 12_000 and m.rows().count() >= 12_000


def test_shares_and_nesting(spark):
    d = docs(spark, corpus())
    t = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 3), ("small_one", 0.2, 2), ("absent", 0.0, 2), ("nothing", 0.1, 2)], TARGETS)
    m = Mixture(d, t)
    shares = {r.source: r for r in m.shares().collect()}
    largest = m.sizes.agg(F.max("tokens")).first()[0]
    total = sum(r.taken for r in shares.values())
    for s, want in (("big", 0.5), ("mid", 0.3), ("small_one", 0.2)):
        assert abs(shares[s].taken - want * total) <= 3 * largest
        assert shares[s].most_copies <= {"big": 1, "mid": 3, "small_one": 2}[s]
    assert shares["nothing"].taken == 0
    rows = m.rows().collect()
    assert len({r.doc_id for r in rows}) == len(rows) and not {10_000, 10_001} & {r.doc_id for r in rows}
    by = {}
    for r in rows:
        by.setdefault(r.source, set()).add(r.copies)
    assert all(max(c) - min(c) <= 1 for c in by.values())
    small, large = Mixture(d, t, total=3000).rows(), Mixture(d, t, total=6000).rows()
    assert {r.doc_id for r in small.collect()} <= {r.doc_id for r in large.collect()}  # thresholds nest


def test_budget_is_met_exactly_from_below(spark):
    d = docs(spark, [(i, "word", "a") for i in range(500)])
    t = spark.createDataFrame([("a", 1.0, 5)], TARGETS)
    assert Mixture(d, t, total=123).rows().agg(F.sum(F.col("tokens") * F.col("copies"))).first()[0] == 123
    assert Mixture(d, t, total=1203).rows().agg(F.sum(F.col("tokens") * F.col("copies"))).first()[0] == 1203
    assert Mixture(d, t, total=10**9).shares().first().taken == 2500


def test_defined_cases(spark):
    t = spark.createDataFrame([("a", 1.0, 1), (None, 0.5, 1), ("A", 0.5, 3), ("n", None, None)], TARGETS)
    empty = docs(spark, [])
    assert Mixture(empty, t).rows().count() == 0
    assert [r.share for r in Mixture(empty, t).shares().collect()] == [0.0, 0.0]
    assert Mixture(empty, t.limit(0)).shares().count() == 0
    d = docs(spark, [(1, "same", "a"), (1, "same", "a"), (None, "null id", "a")])
    assert Mixture(d, t).rows().count() == 3
