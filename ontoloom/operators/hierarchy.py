"""Parent-child links to full hierarchies: paths, depth, root, ancestors, descendants and cycles.

Connected components are found by alternating star contraction on integer ids. Components up to
``component_links`` links are co-located whole and walked depth first with node colouring, one component in
memory at a time; larger ones are solved by pointer doubling over DataFrames, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping
from itertools import chain
from typing import TypeVar

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoloom.session import materialize

T = TypeVar("T", int, str)

NODES = "tree string, node_id string, path array<string>, depth long, root string, ancestors array<string>, on_cycle boolean, back_edges array<string>"


def links_of(df: DataFrame, tree: str, child, parent) -> DataFrame:
    """Distinct links of one tree in long form; a node without a parent has a null ``parent``."""
    return df.select(F.lit(tree).alias("tree"), child.alias("node"), parent.alias("parent")).filter(F.col("node").isNotNull()).distinct()


def current_version(df: DataFrame, key: str, version: str) -> DataFrame:
    """The rows of each key with its greatest version; ties are all kept, a null version is the least."""
    v = F.coalesce(F.col(version), F.lit(-(2**63)).cast("long"))
    last = df.groupBy(F.col(key).alias("__k")).agg(F.max(v).alias("__v"))
    return df.join(last, (F.col(key) == F.col("__k")) & (v == F.col("__v")), "left_semi")


def _contract(batches: Iterator[pa.RecordBatch], most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Links ``a, b`` of a task as stars around the least node of each part that the task can see.

    It is to components what a partial sum is to a sum: connections stay, and a task keeps a link per node. At most
    ``most`` links are held at once.
    """

    def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        ends = [np.concatenate([b.column(i).to_numpy() for b in held]) for i in (0, 1)]
        node, at = np.unique(np.concatenate(ends), return_inverse=True)
        x, y = at[: len(ends[0])], at[len(ends[0]) :]
        label = np.arange(len(node))
        while len(x):
            hi, lo = np.maximum(label[x], label[y]), np.minimum(label[x], label[y])
            apart = hi != lo
            x, y = x[apart], y[apart]
            np.minimum.at(label, hi[apart], lo[apart])
            while (label[label] != label).any():
                label = label[label]
        moved = np.flatnonzero(label != np.arange(len(node)))
        return pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[label[moved]])], names=["a", "b"])

    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.num_rows
        if size >= most:
            yield stars(held)
            held, size = [], 0
    if held:
        yield stars(held)


def components(edges: DataFrame, most_rounds: int = 64, in_one: int = 2_000_000) -> DataFrame:
    """The least node id of its component for each node but that one (``node, component``), from ``a, b`` edges.

    Every task first contracts the edges that it holds (``_contract``), so that few rows move. What is left goes
    to one task if a count proves that it holds them (``in_one`` links of two numbers), and otherwise through
    alternating star contraction: a large star links each node's larger neighbours to its least neighbour, a small star
    links its smaller ones; the number of rounds grows with the logarithm of the nodes. It ends once each node has one
    link and leads to a node without one. Minima are summed before rows move, and a hot node's rows are split by the
    skew join, so no star is collected.
    """
    now = materialize(edges.select("a", "b").filter("a != b").mapInArrow(_contract, "a long, b long"), "stars")
    for _ in range(most_rounds):
        if now.limit(in_one + 1).count() <= in_one:
            return now.coalesce(1).mapInArrow(_contract, "a long, b long").toDF("node", "component")
        ends = now.select(F.col("a").alias("x"), F.col("b").alias("up"), F.lit(False).alias("down")).unionByName(now.select(F.col("b").alias("x"), F.lit(None).cast("long").alias("up"), F.lit(True).alias("down")))
        ends = ends.groupBy("x").agg(F.min("up").alias("lo"), F.max("up").alias("hi"), F.bool_or("down").alias("down"))
        if not ends.filter("lo != hi OR (lo IS NOT NULL AND down)").limit(1).count():
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).distinct()
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
        big = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        least = big.groupBy("a").agg(F.min("b").alias("m"))
        small = big.join(least, "a").select("b", "m", "a")
        now = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).filter("a != b")
        now = materialize(now.mapInArrow(_contract, "a long, b long"), "stars")
    raise RuntimeError("components did not settle")


def _back_links(parents: Mapping[T, list[T]], group: Iterable[T]) -> dict[T, list[T]]:
    """Parents that are grey when the nodes of one strong component are walked from the least, parents by name."""
    inside, seen, grey = set(group), set(), set()
    back: dict[T, list[T]] = {}
    start = min(inside)
    stack = [(start, iter(parents[start]))]
    seen.add(start)
    grey.add(start)
    while stack:
        node, rest = stack[-1]
        for p in rest:
            if p in grey:
                back.setdefault(node, []).append(p)
            elif p in inside and p not in seen:
                seen.add(p)
                grey.add(p)
                stack.append((p, iter(parents[p])))
                break
        else:
            stack.pop()
            grey.discard(node)
    return back


def _strong(parents: list[list[int]]) -> list[list[int]]:
    """Strongly connected sets with a cycle, by depth-first traversal with colours.

    White nodes are not met yet, grey ones (``open_nodes``) belong to a set that is not closed, black ones are done.
    """
    white, black = -1, 1 << 62
    low = [white] * len(parents)
    open_nodes: list[int] = []
    out: list[list[int]] = []
    met = 0
    for start in range(len(parents)):
        if low[start] != white:
            continue
        stack: list[tuple[int, int, Iterator[int]]] = []
        node: int | None = start
        while True:
            if node is not None:
                low[node] = met
                open_nodes.append(node)
                stack.append((node, met, iter(parents[node])))
                met += 1
            node, order, rest = stack[-1]
            for p in rest:
                if low[p] == white:
                    node = p
                    break
                if low[p] < low[node]:
                    low[node] = low[p]
            else:
                stack.pop()
                if stack and low[node] < low[stack[-1][0]]:
                    low[stack[-1][0]] = low[node]
                if low[node] == order:
                    group = [open_nodes.pop()]
                    while group[-1] != node:
                        group.append(open_nodes.pop())
                    for x in group:
                        low[x] = black
                    if len(group) > 1 or node in parents[node]:
                        out.append(group)
                if not stack:
                    break
                node = None
    return out


def walk(parents: list[list[int]]) -> Iterator[tuple[list[int], list[int], bool, list[int]]]:
    """For each node of whole components: path from the top, ancestors, on_cycle and back edges.

    ``parents`` holds the parents of node 0, 1, ... in order of name, and nodes are numbered by name. Depth-first from
    each node to its parents with colours white, grey and black; a grey parent is a back edge. Nodes lie on a cycle
    if their strongly connected set has two nodes or a link to itself. The path follows the least parent and stops
    where it would repeat a node: its first node is then where the cycle is entered. Memory is in proportion to the
    links; paths and ancestors, which may be longer, are built as each node is given out.
    """
    n = len(parents)
    cyclic = [False] * n
    back: dict[int, list[int]] = {}
    for group in _strong(parents):
        for x in group:
            cyclic[x] = True
        back.update(_back_links(parents, group))
    first = [p[0] if p else -1 for p in parents]
    # nodes on a cycle of first parents, and nodes whose ancestors are just their path
    loop, alone, done = [False] * n, [False] * n, [False] * n
    for start in range(n):
        chain, node, here = [], start, set()
        while node >= 0 and not done[node] and node not in here:
            chain.append(node)
            here.add(node)
            node = first[node]
        if node in here:
            for x in chain[chain.index(node) :]:
                loop[x] = True
        for x in reversed(chain):
            done[x] = True
            alone[x] = not loop[x] and (first[x] < 0 or (len(parents[x]) == 1 and alone[first[x]]))
    for node in range(n):
        path, at = [node], first[node]
        if not loop[node]:
            while at >= 0 and not loop[at]:
                path.append(at)
                at = first[at]
            if at >= 0:
                path.append(at)
                entry, at = at, first[at]
            else:
                entry = -1
        else:
            entry = node
        while at != entry:
            path.append(at)
            at = first[at]
        if alone[node]:
            above = sorted(path[1:])
        else:
            found: set[int] = set()
            todo = list(parents[node])
            while todo:
                x = todo.pop()
                if x not in found:
                    found.add(x)
                    todo.extend(parents[x])
            above = sorted(found)
        path.reverse()
        yield path, above, cyclic[node], sorted(back.get(node, []))


def _walk_partition(most: int = 200_000, chunk: int = 50_000):
    """Components one after another from rows sorted by tree and component: those of ``chunk`` links at once, or one.

    A block of output holds about ``most`` names of paths and ancestors, or one node.
    """
    schema = pa.schema([("tree", pa.string()), ("node_id", pa.string()), ("path", pa.list_(pa.string())), ("depth", pa.int64()), ("root", pa.string()), ("ancestors", pa.list_(pa.string())), ("on_cycle", pa.bool_()), ("back_edges", pa.list_(pa.string()))])

    def solved(tree: str, links: pa.Table) -> Iterator[pa.RecordBatch]:
        child, parent = links.column("node").combine_chunks(), links.column("parent").combine_chunks()
        names = pc.unique(pa.concat_arrays([child, parent.drop_null()]))
        names = names.take(pc.sort_indices(names))
        x = pc.index_in(child, names).to_numpy()
        has = parent.is_valid().to_numpy(zero_copy_only=False)
        y = pc.index_in(parent.drop_null(), names).to_numpy()
        x = x[has]
        order = np.lexsort((y, x))
        parents = [p.tolist() for p in np.split(y[order], np.searchsorted(x[order], np.arange(1, len(names))))]
        rows: list[tuple] = []
        size = at = 0

        def lists(i: int) -> pa.ListArray:
            ends = np.cumsum([0, *[len(r[i]) for r in rows]])
            flat = np.fromiter(chain.from_iterable(r[i] for r in rows), np.int64, ends[-1])
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), names.take(pa.array(flat)))

        def block() -> pa.RecordBatch:
            top = [r[0][0] if not parents[r[0][0]] else None for r in rows]
            columns = [
                pa.array([tree] * len(rows), pa.string()), names.slice(at, len(rows)), lists(0), pa.array([len(r[0]) - 1 for r in rows], pa.int64()),
                names.take(pa.array(top, pa.int64())), lists(1), pa.array([r[2] for r in rows]), lists(3),
            ]
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        for r in walk(parents):
            rows.append(r)
            size += 20 + len(r[0]) + len(r[1])
            if size > most:
                yield block()
                at += len(rows)
                rows, size = [], 0
        if rows:
            yield block()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, key, start = 0, None, None

        def out() -> Iterator[pa.RecordBatch]:
            return solved(start, pa.Table.from_batches(held).select(["node", "parent"]))

        for b in batches:
            if not b.num_rows:
                continue
            comp = b.column("component").to_numpy()
            tree = b.column("tree").dictionary_encode()
            code = tree.indices.to_numpy()
            cuts = [0, *(np.flatnonzero((comp[1:] != comp[:-1]) | (code[1:] != code[:-1])) + 1).tolist(), b.num_rows]
            begin = 0  # rows from here on are not held yet
            for lo in cuts[:-1]:
                here = (tree.dictionary[int(code[lo])].as_py(), int(comp[lo]))
                if here == key:
                    continue
                if key is not None and (size + lo - begin >= chunk or here[0] != start):
                    if lo > begin:
                        held.append(b.slice(begin, lo - begin))
                    if held:
                        yield from out()
                    held, size, begin = [], 0, lo
                key, start = here, here[0]
            held.append(b.slice(begin))
            size += b.num_rows - begin
        if held:
            yield from out()

    return run


def _strong_batches(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Strongly connected sets of links ``tree, m, t`` that one task holds whole: ``tree, x, strong``, named by their least."""
    pdf = pd.concat(list(batches), ignore_index=True)
    for tree, own in pdf.groupby("tree", dropna=False):
        names, at = np.unique(np.concatenate([own.m.to_numpy(str), own.t.to_numpy(str)]), return_inverse=True)
        parents: list[list[int]] = [[] for _ in names]
        for x, y in zip(at[: len(own)].tolist(), at[len(own) :].tolist()):
            parents[x].append(y)
        for group in _strong(parents):
            yield pd.DataFrame({"tree": tree, "x": names[group].astype(object), "strong": str(names[min(group)])})


def _strong_by_joins(links: DataFrame, in_one: int) -> DataFrame:
    """``tree, x, strong`` of the nodes on cycles, by joins: nodes of one strong component have one ``strong``.

    Nodes with one parent are jumped over by pointer doubling, so a chain of any length takes as many rounds as its
    length has binary digits. A jump that never leaves such nodes ends on a ring of them. What is left are links
    between nodes with several parents; their strong components are found in one task if a count proves that it holds
    them (``in_one``), and else by closure of these links only. Nodes that were jumped over inside a component are
    marked by the same jumps.
    """
    up = materialize(links.filter("parent is not null").select("tree", F.col("node").alias("x"), F.col("parent").alias("y")).distinct(), "up")
    degree = up.groupBy("tree", "x").agg(F.count("*").alias("n"), F.min("y").alias("y"))
    jumps = [materialize(degree.filter("n = 1").select("tree", "x", "y"), "jumps")]
    for _ in range(jumps[0].count().bit_length()):
        ahead = jumps[-1].select("tree", F.col("x").alias("y"), F.col("y").alias("z"))
        far = materialize(jumps[-1].join(ahead, ["tree", "y"], "left").select("tree", "x", F.coalesce("z", "y").alias("y"), F.col("z").isNotNull().alias("moved")), "jumps")
        if not far.filter("moved").limit(1).count():
            break
        jumps.append(far.drop("moved"))
    single, last = jumps[0].select("tree", "x"), jumps[-1]
    # as many jumps as there are nodes end at a node without one parent, or on a ring
    on_ring = last.join(single.withColumnRenamed("x", "y"), ["tree", "y"], "left_semi").select("tree", F.col("y").alias("x")).distinct()
    ring = materialize(jumps[0].join(on_ring, ["tree", "x"], "left_semi").withColumn("strong", F.least("x", "y")), "ring")
    for _ in range(ring.count().bit_length()):
        ahead = ring.select("tree", F.col("x").alias("y"), F.col("y").alias("z"), F.col("strong").alias("other"))
        ring = materialize(ring.join(ahead, ["tree", "y"]).select("tree", "x", F.col("z").alias("y"), F.least("strong", "other").alias("strong")), "ring")
    multi = materialize(degree.filter("n > 1").select("tree", "x"), "multi")
    legs = up.join(multi, ["tree", "x"], "left_semi").select("tree", F.col("x").alias("m"), F.col("y").alias("p"))
    legs = legs.join(last.select("tree", F.col("x").alias("p"), F.col("y").alias("end")), ["tree", "p"], "left").select("tree", "m", "p", F.coalesce("end", "p").alias("t"))
    legs = materialize(legs.join(multi.withColumnRenamed("x", "t"), ["tree", "t"], "left_semi"), "legs")
    direct = legs.select("tree", "m", "t").distinct()
    if direct.limit(in_one + 1).count() <= in_one:
        core = direct.coalesce(1).mapInPandas(lambda b: _strong_batches(b), "tree string, x string, strong string")
    else:
        core = _mutual(direct)
    core = materialize(core, "strong")
    of = lambda c: core.withColumnRenamed("x", c)
    passed = legs.join(of("m"), ["tree", "m"]).join(of("t"), ["tree", "t", "strong"]).select("tree", F.col("p").alias("x"), "strong")
    passed = materialize(passed.join(single, ["tree", "x"], "left_semi").distinct(), "passed")
    if passed.limit(1).count():
        for jump in jumps:
            more = passed.join(jump, ["tree", "x"]).select("tree", F.col("y").alias("x"), "strong").join(single, ["tree", "x"], "left_semi")
            passed = materialize(passed.unionByName(more).distinct(), "passed")
    return ring.select("tree", "x", "strong").unionByName(core).unionByName(passed).distinct()


def _mutual(direct: DataFrame) -> DataFrame:
    """``tree, x, strong`` of links ``tree, m, t`` by their closure: nodes that reach each other are one component."""
    n, closure = -1, direct
    while (size := closure.count()) != n:
        n = size
        more = closure.select("tree", "m", F.col("t").alias("by")).join(closure.select("tree", F.col("m").alias("by"), "t"), ["tree", "by"]).select("tree", "m", "t")
        closure = materialize(closure.unionByName(more).distinct(), "closure")
    both = closure.join(closure.select("tree", F.col("t").alias("m"), F.col("m").alias("t")), ["tree", "m", "t"])
    return both.groupBy("tree", F.col("m").alias("x")).agg(F.min("t").alias("strong"))


def _back_batches(batches):
    """Back edges of strong components one after another, from links sorted by ``tree, strong``."""
    part, at = {}, None

    def done():
        back = _back_links(part, part)
        return pd.DataFrame([(at[0], x, sorted(y)) for x, y in back.items()], columns=["tree", "x", "back_edges"])

    for pdf in batches:
        for tree, strong, x, y in zip(pdf.tree, pdf.strong, pdf.x, pdf.ys):
            if (tree, strong) != at:
                if part:
                    yield done()
                part, at = {}, (tree, strong)
            part[x] = list(y)
    if part:
        yield done()


def _doubled(links: DataFrame, columns: Iterable[str], in_one: int) -> DataFrame:
    """The rows of ``NODES`` for components too large for one task, by joins; a strong component is walked by one task.

    Of ``path, depth, root`` and of ``ancestors`` only what ``columns`` names is made; the others are null.
    """
    up = materialize(links.filter("parent is not null").select("tree", F.col("node").alias("x"), F.col("parent").alias("y")).distinct(), "up")
    nodes = links.select("tree", F.col("node").alias("x")).unionByName(up.select("tree", F.col("y").alias("x"))).distinct()
    strong = materialize(_strong_by_joins(links, in_one), "strong")
    within = up.join(strong, ["tree", "x"]).join(strong.select("tree", F.col("x").alias("y"), "strong"), ["tree", "y", "strong"])
    within = within.groupBy("tree", "strong", "x").agg(F.sort_array(F.collect_list("y")).alias("ys"))
    back = within.repartition("tree", "strong").sortWithinPartitions("tree", "strong").mapInPandas(_back_batches, "tree string, x string, back_edges array<string>")
    out = nodes.join(strong.select("tree", "x", F.lit(True).alias("on_cycle")), ["tree", "x"], "left").join(back, ["tree", "x"], "left")
    names = "array<string>"
    if {"path", "depth", "root"} & set(columns):
        out = out.join(_paths(nodes, up), ["tree", "x"])
    else:
        out = out.select("*", F.lit(None).cast(names).alias("path"), F.lit(None).cast("long").alias("depth"), F.lit(None).cast("string").alias("root"))
    if "ancestors" in columns:
        closure = materialize(up, "closure")
        n = -1
        while (size := closure.count()) != n:
            n = size
            more = closure.select("tree", "x", F.col("y").alias("by")).join(closure.select("tree", F.col("x").alias("by"), "y"), ["tree", "by"]).select("tree", "x", "y")
            closure = materialize(closure.unionByName(more).distinct(), "closure")
        above = closure.groupBy("tree", "x").agg(F.sort_array(F.collect_list("y")).alias("ancestors"))
        out = out.join(above, ["tree", "x"], "left").withColumn("ancestors", F.coalesce("ancestors", F.array().cast(names)))
    else:
        out = out.withColumn("ancestors", F.lit(None).cast(names))
    return out.select("tree", F.col("x").alias("node_id"), "path", "depth", "root", "ancestors", F.coalesce("on_cycle", F.lit(False)).alias("on_cycle"), F.coalesce("back_edges", F.array().cast(names)).alias("back_edges"))


def _paths(nodes: DataFrame, up: DataFrame) -> DataFrame:
    """``tree, x, path, depth, root`` along the first parents, by pointer doubling."""
    first = up.groupBy("tree", "x").agg(F.min("y").alias("up"))
    step = materialize(nodes.join(first, ["tree", "x"], "left").select("tree", "x", "up", F.array("x").alias("path")), "step")
    while True:
        ahead = step.select("tree", F.col("x").alias("up"), F.col("up").alias("up2"), F.col("path").alias("path2"))
        step = step.join(ahead, ["tree", "up"], "left").select(
            "tree", "x", F.when(~F.arrays_overlap("path2", "path"), F.col("up2")).alias("up2"), "up",
            F.when(F.col("path2").isNull(), F.col("path")).otherwise(F.concat("path", F.expr("slice(path2, 1, CASE WHEN arrays_overlap(path2, path) THEN array_position(transform(path2, e -> array_contains(path, e)), true) - 1 ELSE size(path2) END)"))).alias("path"),
        )
        step = materialize(step.select("tree", "x", F.col("up2").alias("up"), "path"), "step")
        if not step.filter("up is not null").limit(1).count():
            break
    ends = step.withColumn("last", F.element_at("path", -1)).join(up.select("tree", F.col("x").alias("last")).distinct().withColumn("more", F.lit(True)), ["tree", "last"], "left")
    return ends.select("tree", "x", F.reverse("path").alias("path"), (F.size("path") - 1).cast("long").alias("depth"), F.when(F.col("more").isNull(), F.col("last")).alias("root"))


#: Columns of ``hierarchy`` that grow with the depth of a tree.
LONG = ("path", "depth", "root", "ancestors")


def hierarchy(links: DataFrame, component_links: int = 500_000, columns: Iterable[str] = LONG) -> DataFrame:
    """One row per node of ``tree, node, parent`` links (see ``links_of``).

    Returns ``tree, node_id, path`` (root first, down to the node), ``depth, root`` (null if the path leads into
    a cycle), ``ancestors`` (all, sorted; a node on a cycle is its own ancestor), ``on_cycle, back_edges`` (parents
    that were grey when the strong component of the node was walked from its least node, whatever the size of the
    component; without these links there is no cycle). A parent that is no node of its own is a node without a parent.

    Components of up to ``component_links`` links are walked whole. Larger ones go by joins, where of ``LONG`` only
    ``columns`` are made and others are null: a path per node of a chain of a million nodes has 10 ** 12 names.

    Cases: null nodes give nothing, a null parent makes a root, repeated links count once, several parents are
    allowed (``path`` follows the least by name), an empty table gives no rows.
    """
    whole, rest = _placed(links, component_links)
    out = whole.mapInArrow(_walk_partition(), NODES)
    return out if rest is None else out.unionByName(_doubled(rest, columns, component_links))


def _placed(links: DataFrame, component_links: int) -> tuple[DataFrame, DataFrame | None]:
    """Links with their component: those of small components co-located and sorted, those of large ones apart."""
    spark = links.sparkSession
    links = materialize(links.select("tree", "node", "parent").distinct(), "links")
    # ids are hashes: two names with one hash would only bring their components to one place
    a, b = F.xxhash64("tree", "node"), F.xxhash64("tree", "parent")
    comp = components(links.filter("parent is not null").select(a.alias("a"), b.alias("b")))
    placed = links.withColumn("id", a).join(comp.withColumnRenamed("node", "id"), "id", "left").select(
        "tree", F.coalesce("component", "id").alias("component"), "node", "parent"
    )
    placed = materialize(placed, "placed")
    sizes = placed.groupBy("component").agg(F.count("*").alias("n"))
    large = sizes.filter(F.col("n") > component_links).select("component")
    whole, rest = placed, None
    if large.limit(1).count():
        whole = placed.join(large, "component", "left_anti")
        rest = placed.join(large, "component", "left_semi")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return whole.repartition(parts, "component").sortWithinPartitions("tree", "component").select("tree", "component", "node", "parent"), rest


def descendants(nodes: DataFrame) -> DataFrame:
    """One row per node and descendant (``tree, node_id, descendant``) from the rows of ``hierarchy``."""
    return nodes.select("tree", F.explode("ancestors").alias("node_id"), F.col("node_id").alias("descendant"))


def with_counts(nodes: DataFrame) -> DataFrame:
    """``hierarchy`` rows with the number of descendants of each node."""
    n = descendants(nodes).groupBy("tree", "node_id").agg(F.count("*").alias("n_descendants"))
    return nodes.join(n, ["tree", "node_id"], "left").withColumn("n_descendants", F.coalesce("n_descendants", F.lit(0)).cast("long"))


__all__ = ["components", "current_version", "descendants", "hierarchy", "links_of", "walk", "with_counts"]
