import random

from ontoloom.llm.leakage import Rule, best_run, build_index, find_in, leaked_items, tiles, words



def text(r, n):
    return ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(3, 9))) for _ in range(n)]


def test_words():
    t = "It was regis-\ntered,\n\n- 3 -\n\non 9.1.2005 (the Quay) for 73 448 crowns.\nPage 2 of 3 - 5 ZB 364/15\nRe-opened ███ at A.____ « dépôt »"
    assert words(t) == "it was registered on 912005 the quay for 73 448 crowns reopened at a dépôt".split()
    assert words("insur-\n\nPage 4 sur 5 - 5 OGP 598/13\n\nance") == ["insurance"]
    assert words("") == []


def test_tiles_and_runs():
    a = list(range(40))
    assert tiles(a, [99, *a, 98]) == [(0, 1, 40)]
    b = [*a[20:], 77, *a[:20]]
    got = tiles(a, b)
    assert sorted((i, k) for i, _, k in got) == [(0, 20), (20, 20)]  # reordered halves are still covered
    assert best_run(a, b, got, Rule())[0] == 20
    c = a.copy()
    c[9] = c[18] = c[27] = 99
    assert best_run(a, c, tiles(a, c), Rule()) == (40, 3)
    d = [*a[:15], *[500] * 5, *a[15:]]
    assert best_run(a, d, tiles(a, d), Rule()) == (40, 0)
    for seed in range(30):
        r = random.Random(seed)
        x, y = [r.randrange(4) for _ in range(25)], [r.randrange(4) for _ in range(30)]
        got = tiles(x, y)
        marks_x, marks_y = set(), set()
        for i, j, k in got:
            assert x[i : i + k] == y[j : j + k] and k >= 3
            assert not marks_x & set(range(i, i + k)) and not marks_y & set(range(j, j + k))
            marks_x |= set(range(i, i + k))
            marks_y |= set(range(j, j + k))


def planted(seed=1):
    """Items and documents with known runs: exact, altered, redacted, wrapped, too short, too altered, reordered."""
    r = random.Random(seed)
    items = [(i, text(r, 90)) for i in range(30)]
    docs, want = [], set()
    for d in range(60):
        body = text(r, 400)
        i, w = items[r.randrange(30)]
        n = r.choice([12, 20, 25, 34, 45, 80])
        a = r.randrange(0, 90 - n + 1)
        part = w[a : a + n]
        kind = r.choice(["exact", "altered", "redacted", "dropped", "wrapped", "header", "mangled"])
        at = list(range(r.randrange(3, 7), n - 4, 11))
        if kind == "altered":
            part = [("zz" + x) if k in at else x for k, x in enumerate(part)]
        elif kind == "redacted":
            part = ["█████" if k in at else x for k, x in enumerate(part)]
        elif kind == "dropped":
            part = [x for k, x in enumerate(part) if k not in at]
        elif kind == "mangled":
            part = [("zz" + x) if k % 4 == 0 else x for k, x in enumerate(part)]
        line = " ".join(part)
        if kind == "wrapped":
            line = ",\n".join(" ".join(part[k : k + 6]) for k in range(0, n, 6)).upper()
        elif kind == "header":
            line = " ".join(part[: n // 2]) + "\n\nSeite 3 von 7 - 4 AHV 344/13\n\n" + " ".join(part[n // 2 :])
        docs.append((d, " ".join(body[:200]) + " " + line + " " + " ".join(body[200:])))
        if n >= 34 and kind != "mangled":
            want.add((d, i))
    return items, docs, want


def test_planted_runs(spark):
    items, docs, want = planted()
    i = spark.createDataFrame([(k, " ".join(w), "x") for k, w in items], "item_id long, text string, doc_id string")
    d = spark.createDataFrame([(*x, "y") for x in docs], "doc_id long, text string, item_id string")
    got = leaked_items(d, i)
    assert {(r.doc_id, r.item_id) for r in got.filter("run > 0").collect()} == want
    blocks = leaked_items(d, i, block_chars=2000)
    assert {(r.doc_id, r.item_id) for r in blocks.filter("run > 0").collect()} == want


def test_reordered_is_reported(spark):
    r = random.Random(4)
    w = text(r, 80)
    body = text(r, 100)
    parts = [w[k : k + 16] for k in range(0, 80, 16)]
    mixed = [x for p in (parts[3], parts[0], parts[4], parts[2], parts[1]) for x in p]
    index = build_index([(7, " ".join(w))])
    got = find_in(" ".join(body + mixed + body), index, Rule())
    assert got and got[0][:2] == (7, 0) and got[0][3] > 0.9


def test_defined_cases(spark):
    items = spark.createDataFrame([(1, None), (None, "a b c d e f"), (2, ""), (3, "one two"), (4, " ".join(f"w{k}" for k in range(40)))], "item_id long, text string")
    whole = " ".join(f"w{k}" for k in range(40))
    docs = spark.createDataFrame([(1, None), (None, whole), (2, ""), (3, whole), (3, whole), (3, "other"), (4, "x " * 300_000 + whole)], "doc_id long, text string")
    assert {(r.doc_id, r.item_id, r.run) for r in leaked_items(docs, items).collect()} == {(3, 4, 40), (4, 4, 40)}
    assert leaked_items(docs.limit(0), items).count() == 0 and leaked_items(docs, items.limit(0)).count() == 0


def test_altered_words_near_the_ends():
    r = random.Random(8)
    w, body = text(r, 30), text(r, 60)
    index = build_index([(7, " ".join(w))])
    for at in [(1,), (2,), (1, 28), (2, 27), (1, 2), (1, 4, 27), (2, 14, 27), (4, 9, 14), (15, 20, 25)]:
        for new in (lambda x: ["zz" + x], lambda x: [], lambda x: ["█████"]):
            part = [y for k, x in enumerate(w) for y in (new(x) if k in at else [x])]
            for b in (part, part[::-1]):
                i = index if b is part else build_index([(7, " ".join(w[::-1]))])
                assert find_in(" ".join(body + b + body), i, Rule()) and find_in(" ".join(body + b + body), i, Rule())[0][:3] == (7, 30, len(at)), (at, b)
    short = w[:26]
    assert all(g[1] == 0 for g in find_in(" ".join(body + short + body), index, Rule()))


def test_neighbouring_copies():
    for seed in range(60):
        r = random.Random(seed)
        w, body = text(r, 90), text(r, 60)
        index = build_index([(7, " ".join(w))])
        copies = []
        for _ in range(2):
            at = r.sample(range(40), 3)
            copies.append([("zz" + x) if k in at else x for k, x in enumerate(w[20:60])])
        for b in (copies[0] + copies[1], copies[0] + body[:10] + copies[1]):
            got = find_in(" ".join(body + b + body), index, Rule())
            assert got and got[0][1] >= 30, seed


def test_a_copy_among_pieces():
    """A valid copy counts though longer pieces, or a longer stretch that is altered too much, stand in the same text."""
    r = random.Random(3)
    w, body = text(r, 90), text(r, 300)
    index = build_index([(7, " ".join(w))])
    copy = [("zz" + x) if k in (9, 20, 31) else x for k, x in enumerate(w[20:60])]
    for b in (w[20:40] + body[:3] + copy + body[3:6] + w[40:60], copy + body + [("zz" + x) if k % 4 == 0 else x for k, x in enumerate(w)]):
        got = find_in(" ".join(body[6:] + b + body[6:]), index, Rule())
        assert got and got[0][1:3] == (40, 3), b
