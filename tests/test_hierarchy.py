import random

import pytest
from pyspark.sql import functions as F

from ontoloom.operators import hierarchy as hierarchy_module
from ontoloom.operators.hierarchy import NODES, _strong_by_joins, _walk_partition, components, current_version, descendants, hierarchy, links_of, walk, with_counts


def closure(links):
    up = {}
    for c, p in links:
        if p is not None:
            up.setdefault(c, set()).add(p)
    out = {}
    for n in {x for c, p in links for x in (c, p) if x is not None}:
        seen, todo = set(), list(up.get(n, ()))
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += up.get(x, ())
        out[n] = seen
    return out


def graph(seed, n, parents):
    r = random.Random(seed)
    links = []
    for i in range(n):
        for _ in range(parents if r.random() < 0.3 else 1):
            links.append((f"n{i}", None if r.random() < 0.15 else f"n{r.randrange(n) if r.random() < 0.1 else max(0, i - r.randrange(1, 6))}"))
    return links


def follow(links, n):
    first = {}
    for c, p in links:
        if p is not None:
            first[c] = min(first.get(c, p), p)
    path, seen = [n], {n}
    while first.get(path[-1]) is not None and first[path[-1]] not in seen:
        path.append(first[path[-1]])
        seen.add(path[-1])
    return path[::-1], None if path[-1] in first else path[-1]


@pytest.mark.parametrize("parents", [1, 3])
def test_walk(parents):
    for seed in range(40):
        links = graph(seed, 25, parents)
        want = closure(links)
        names = sorted(want)
        above_of = [sorted({names.index(p) for c, p in links if c == n and p is not None}) for n in names]
        got = list(walk(above_of))
        assert len(got) == len(names)
        for n, (path, above, on_cycle, back) in zip(names, got):
            assert {names[x] for x in above} == want[n] and above == sorted(above)
            assert on_cycle == (n in want[n])
            assert [names[x] for x in path] == follow(links, n)[0]
            assert all(n in want[names[b]] for b in back)


@pytest.mark.parametrize("limit", [500_000, 3])
def test_distributed_equals_closure(spark, limit):
    links = graph(3, 60, 2) + [("loop", "loop"), ("alone", None), ("alone", None)]
    df = spark.createDataFrame([("t", c, p) for c, p in links], "tree string, node string, parent string")
    got = {r.node_id: r for r in hierarchy(df, component_links=limit).collect()}
    want = closure(links)
    assert got.keys() == want.keys()
    assert {r.node_id for r in hierarchy(df, component_links=limit).filter("on_cycle").collect()} == {n for n in want if n in want[n]}
    for n, r in got.items():
        assert set(r.ancestors) == want[n]
        assert r.on_cycle == (n in want[n])
        assert (r.path, r.root) == follow(links, n)


def test_deep_chain_and_descendants(spark):
    n = 3000
    df = spark.createDataFrame([("t", f"n{i:05d}", f"n{i - 1:05d}" if i else None) for i in range(n)], "tree string, node string, parent string")
    nodes = hierarchy(df)
    assert nodes.agg(F.max("depth")).first()[0] == n - 1
    small = hierarchy(df.filter("node < 'n00010'"))
    assert descendants(small).filter("node_id = 'n00000'").count() == 9
    assert with_counts(small).filter("n_descendants = 0").count() == 1


@pytest.mark.parametrize("limit", [500_000, 3])
def test_cycles_of_single_parents(spark, limit):
    links = [(c, p) for c, p in dict(graph(9, 80, 1)).items()] + [("x", "y"), ("y", "z"), ("z", "x"), ("in", "x")]
    df = spark.createDataFrame([("t", c, p) for c, p in links], "tree string, node string, parent string")
    want = closure(links)
    assert {r.node_id for r in hierarchy(df, component_links=limit).filter("on_cycle").collect()} == {n for n in want if n in want[n]}
    assert hierarchy(df.limit(0), component_links=limit).count() == 0


def test_defined_cases(spark):
    schema = "tree string, node string, parent string"
    assert hierarchy(spark.createDataFrame([], schema)).count() == 0
    df = spark.createDataFrame([("a", None, "x"), ("a", "b", "c")], schema)
    rows = hierarchy(links_of(df, "t", F.col("node"), F.col("parent"))).collect()
    assert {(r.node_id, r.depth, r.root) for r in rows} == {("b", 1, "c"), ("c", 0, "c")}


def test_current_version(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "y"), ("b", None, "z"), (None, 3, "w")], "k string, v long, p string")
    got = sorted(tuple(r) for r in current_version(df, "k", "v").select("k", "p").collect())
    assert got == [("a", "y"), ("a", "y"), ("b", "z")]


def test_back_edges_of_any_size(spark):
    links = graph(3, 60, 2) + [("loop", "loop"), ("p", "q"), ("q", "r"), ("r", "p"), ("in", "q")]
    df = spark.createDataFrame([("t", c, p) for c, p in links], "tree string, node string, parent string")
    small, large = ({r.node_id: r.back_edges for r in hierarchy(df, component_links=k).collect()} for k in (500_000, 1))
    assert small == large and large["loop"] == ["loop"] and sum(len(large[x]) for x in "pqr") == 1
    left = closure([(c, p) for c, p in links if p not in large[c]])
    assert any(n in up for n, up in closure(links).items()) and not any(n in up for n, up in left.items())


def test_many_components_in_one_task(spark):
    links = [(f"{t}", f"c{k}-{i}", f"c{k}-{(i - 1) % 4}" if k % 7 == 0 or i else None) for t in "ab" for k in range(300) for i in range(4)]
    df = spark.createDataFrame(links, "tree string, node string, parent string").repartition(1)
    rows = df.select("tree", F.col("node"), "parent", F.xxhash64("tree", F.split("node", "-")[0]).alias("component")).sortWithinPartitions("tree", "component").select("tree", "component", "node", "parent")
    want = sorted(hierarchy(df).drop("back_edges").collect())
    for chunk in (1, 10, 50_000):
        got = rows.mapInArrow(_walk_partition(most=50, chunk=chunk), NODES).drop("back_edges").collect()
        assert sorted(got) == want and len(got) == 2400
    assert sum(r.on_cycle for r in want) == 2 * 43 * 4


def test_components_by_stars_when_tasks_see_little(spark, monkeypatch):
    edges = [(i, i - 1) for i in range(1, 400)] + [(1000 + i, 1000 + (i * 7) % 50) for i in range(50)] + [(5000, 6000)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(16)
    alone = hierarchy_module._contract
    monkeypatch.setattr(hierarchy_module, "_contract", lambda batches: alone(batches, most=1))
    got = {r.node: r.component for r in components(df, in_one=5).collect()}
    assert {got.get(i, i) for i in range(400)} == {0} and got[6000] == 5000 and 5000 not in got
    monkeypatch.undo()
    assert got == {r.node: r.component for r in components(df).collect()}


@pytest.mark.parametrize("in_one", [10**6, 2])
def test_long_chains_by_joins(spark, in_one):
    """A chain with a node of two parents in a ring, a ring of single parents and side chains; no path is made."""
    n = 3000
    links = [(f"n{i:05d}", f"n{i - 1:05d}") for i in range(1, n)] + [("n00500", "n02000"), ("n02500", "x1"), ("x1", "x2"), ("r1", "r2"), ("r2", "r3"), ("r3", "r1"), ("in", "r1"), ("self", "self"), ("n00100", "r1"), ("n00100", "n00090")]
    df = spark.createDataFrame([("t", c, p) for c, p in links], "tree string, node string, parent string")
    got = {r.x: r.strong for r in _strong_by_joins(df, in_one).collect()}
    want = {f"n{i:05d}" for i in range(500, 2001)} | {"r1", "r2", "r3", "self"}
    assert set(got) == want and len(set(got.values())) == 3
    rows = hierarchy(df.filter("node != 'self'"), component_links=10, columns=()).filter("on_cycle").collect()
    assert {r.node_id for r in rows} == want - {"self"} and all(r.path is None and r.ancestors is None for r in rows)
    assert sum(len(r.back_edges) for r in rows) == 2
