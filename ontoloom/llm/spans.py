"""Long exact spans shared between records.

1. Every distinct text is cut into anchors: the substrings of ``min_len // 2`` characters whose hash is least in a
   window. Two texts that share ``min_len`` characters always choose a common anchor inside the shared span.
2. Anchors of two or more distinct texts are recurring passages. Anchors with the same set of texts form one group.
3. Around its recurring passages each text is cut out and streamed, per group, through an Aho-Corasick automaton of
   the whole passages of every text of the group, sharded so that a task compiles only the passages of its groups and
   reads only texts that hold them. Every occurrence is extended to both sides; a pair is confirmed when the common
   span is long enough.
4. A group of more than ``hot`` texts is never brought to one task: its texts are cut into all substrings of
   ``min_len`` around the passages, and texts with an equal substring are pairs (exact on 128 bits of hash).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ontoloom.session import broadcast_if_small, materialize

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
BLOCK = 1 << 18  #: characters that are hashed at once; longer texts go in overlapping blocks
ROWS = 256  #: rows of a batch that are turned into Python strings at once
FEW = 32  #: contexts of a passage that are compared pair by pair; more are compared by their windows
COPIES = 1024  #: rows of one key that a task pairs with others; more are split


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """Batches cut small, so that few texts are held as Python strings."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


class _Roller:
    """64-bit polynomial hashes of all substrings of one length."""

    def __init__(self, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.base = np.uint64((_BASE ^ (seed * 0x5851F42D4C957F2D)) & _MASK | 1)
        self.back = np.uint64(pow(int(self.base), -1, 1 << 64))
        self.of_char = rng.integers(0, 1 << 63, 1 << 16, dtype=np.uint64)
        self.powers = np.ones(1, np.uint64)
        self.inverse = np.ones(1, np.uint64)

    def __call__(self, text: str, k: int) -> np.ndarray:
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(c)
        if n < k:
            return np.empty(0, np.uint64)
        if n > len(self.powers):
            m = 2 * n
            self.powers = np.multiply.accumulate(np.r_[np.uint64(1), np.full(m - 1, self.base)])
            self.inverse = np.multiply.accumulate(np.r_[np.uint64(1), np.full(m - 1, self.back)])
        v = self.of_char[c & 0xFFFF]
        if (c > 0xFFFF).any():
            v = v + (c >> 16).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        h = np.zeros(n + 1, np.uint64)
        np.cumsum(v * self.powers[:n], out=h[1:])
        h = (h[k:] - h[:-k]) * self.inverse[: n - k + 1]
        h ^= h >> np.uint64(32)
        return h * np.uint64(0xD6E8FEB86659FD93)


def _slide(a: np.ndarray, w: int, f: np.ufunc) -> np.ndarray:
    """``f`` over all windows of ``w`` items, by doubling."""
    n = 1
    while 2 * n <= w:
        a = f(a[:-n], a[n:])
        n *= 2
    r = w - n
    return f(a[:-r], a[r:]) if r else a


def anchors(text: str, roll: _Roller, k: int, min_len: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct anchor hashes of a text with the first and last position where each was chosen."""
    w = min_len - k + 1
    hashes, places = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    pad = np.zeros(w - 1, np.uint64)
    for start in range(0, max(1, len(text) - min_len + 1), BLOCK):  # every window lies whole in one block
        h = roll(text[start : start + BLOCK + min_len - 1], k)
        if len(h) >= w:
            least = _slide(h, w, np.minimum)
            at = np.flatnonzero(_slide(np.r_[pad, least, pad], w, np.maximum) == h)
            hashes.append(h[at])
            places.append(at + start)
    h, at = np.concatenate(hashes), np.concatenate(places)
    u, first = np.unique(h, return_index=True)
    last = len(at) - 1 - np.unique(h[::-1], return_index=True)[1]
    return u, at[first], at[last]


def _anchor_batches(min_len: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = _Roller(1)
        seen: set[int] = set()  # repeated rows of a task
        for b in slices(batches):
            out = []
            for cls, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if cls in seen:
                    continue
                seen.add(cls)
                u, lo, hi = anchors(text, roll, k, min_len)
                if len(u):
                    out.append((u.view(np.int64), np.full(len(u), cls), lo.astype(np.int32), hi.astype(np.int32)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["h", "cls", "lo", "hi"])

    return run


def _common(a: tuple[str, str], b: tuple[str, str]) -> tuple[int, int]:
    """Length of the common end of the left contexts and of the common start of the right contexts."""
    n = min(len(a[0]), len(b[0]))
    x = n if a[0][len(a[0]) - n :] == b[0][len(b[0]) - n :] else _reach(lambda i: a[0][len(a[0]) - i :] == b[0][len(b[0]) - i :], n)
    n = min(len(a[1]), len(b[1]))
    y = n if a[1][:n] == b[1][:n] else _reach(lambda i: a[1][:i] == b[1][:i], n)
    return x, y


def _reach(ok, n: int) -> int:
    lo, hi = 0, n
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if ok(mid) else (lo, mid - 1)
    return lo


class _Shard:
    """Groups of one chunk: compiles their passages, streams their texts, confirms pairs."""

    def __init__(self, min_len: int, k: int, extents: bool) -> None:
        self.min_len, self.k, self.extents = min_len, k, extents
        self.pieces: list[tuple[int, int, int, str]] = []  # group, cls, start, text
        self.passages: set[tuple[int, str]] = set()
        self.chars = 0

    def add_group(self, group: int, rows: list[tuple[int, int, str, list[int]]]) -> None:
        """``rows``: cls, start, text around its passages, where they begin."""
        for cls, start, text, at in rows:
            self.pieces.append((group, cls, start, text))
            self.chars += len(text)
            self.passages.update((group, text[p - start : p - start + self.k]) for p in at)

    def confirm(self) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
        """Confirmed pairs, and the spans of each text where asked for."""
        pairs: set[tuple[int, int]] = set()
        spans: list[tuple[int, int, int]] = []
        if not self.passages:
            return [], []
        of_word: dict[str, list[int]] = {}
        for group, passage in self.passages:
            of_word.setdefault(passage, []).append(group)
        machine = ahocorasick.Automaton()
        for n, (passage, groups) in enumerate(of_word.items()):
            machine.add_word(passage, (n, groups))
        machine.make_automaton()
        k, side = self.k, self.min_len - self.k
        seen: dict[tuple[int, int], dict[tuple[str, str], dict[int, list[int]]]] = {}
        for group, cls, start, text in self.pieces:
            for end, (n, groups) in machine.iter(text):
                if group in groups:
                    p = end - k + 1
                    context = (text[max(0, p - side) : p], text[end + 1 : end + 1 + side])
                    seen.setdefault((group, n), {}).setdefault(context, {}).setdefault(cls, []).append(start + p)
        for contexts in seen.values():
            (self._compare if len(contexts) <= FEW else self._by_windows)(list(contexts.items()), side, pairs, spans)
        return list(pairs), spans

    def _compare(self, known: list, side: int, pairs: set, spans: list) -> None:
        for i, (a, of_a) in enumerate(known):
            if len(a[0]) + len(a[1]) >= side and len(of_a) > 1:
                self._join(pairs, of_a, of_a)
                self._extent(spans, of_a, len(a[0]), len(a[1]))
            for b, of_b in known[i + 1 :]:
                if not self.extents and all(c == d or (min(c, d), max(c, d)) in pairs for c in of_a for d in of_b):
                    continue
                if len(of_a) == 1 and len(of_b) == 1 and of_a.keys() == of_b.keys():
                    continue
                x, y = _common(a, b)
                if x + y >= side:
                    self._join(pairs, of_a, of_b)
                    self._extent(spans, of_a, x, y)
                    self._extent(spans, of_b, x, y)

    def _by_windows(self, known: list, side: int, pairs: set, spans: list) -> None:
        """The same in time in proportion to the contexts: those with an equal window around the passage share it."""
        told: set[frozenset[int]] = set()
        for x in range(side + 1):
            windows: dict[tuple[str, str], list[int]] = {}
            for i, ((left, right), _) in enumerate(known):
                if len(left) >= x and len(right) >= side - x:
                    windows.setdefault((left[len(left) - x :], right[: side - x]), []).append(i)
            for same in windows.values():
                classes = frozenset(c for i in same for c in known[i][1])
                if len(classes) > 1:
                    if classes not in told:
                        told.add(classes)
                        self._join(pairs, classes, classes)
                    for i in same:
                        self._extent(spans, known[i][1], x, side - x)

    @staticmethod
    def _join(pairs: set, a: Iterable[int], b: Iterable[int]) -> None:
        pairs.update((min(c, d), max(c, d)) for c in a for d in b if c != d)

    def _extent(self, spans: list, at: dict[int, list[int]], x: int, y: int) -> None:
        if self.extents:
            spans.extend((cls, p - x, p + self.k + y) for cls, ps in at.items() for p in ps)


def _confirm_batches(min_len: int, k: int, extents: bool, chunk: int):
    def out(shard: _Shard) -> pa.RecordBatch:
        pairs, spans = shard.confirm()
        if extents:
            c = [np.array(x, np.int64) for x in zip(*spans)] if spans else [np.empty(0, np.int64)] * 3
            return pa.RecordBatch.from_arrays([pa.array(x) for x in c], names=["cls", "lo", "hi"])
        c = [np.array(x, np.int64) for x in zip(*pairs)] if pairs else [np.empty(0, np.int64)] * 2
        return pa.RecordBatch.from_arrays([pa.array(x) for x in c], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, group, rows = _Shard(min_len, k, extents), None, []
        for b in slices(batches):
            for g, cls, start, text, at in zip(*(b.column(i).to_pylist() for i in range(5))):
                if g != group:
                    if rows:
                        shard.add_group(group, rows)
                    group, rows = g, []
                    if shard.chars > chunk:
                        yield out(shard)
                        shard = _Shard(min_len, k, extents)
                rows.append((cls, start, text, at))
        if rows:
            shard.add_group(group, rows)
        yield out(shard)

    return run


def _cut_batches(min_len: int, k: int):
    """Texts with their recurring anchors, cut to pieces: one per group and stretch of anchors that stand close together."""
    side = min_len - k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            anchor = b.column("anchor")
            grp, hot, lo, hi = (anchor.flatten().field(i).to_numpy(zero_copy_only=False) for i in range(4))
            ends = np.cumsum([0, *pc.list_value_length(anchor).to_pylist()])
            rows: list[tuple] = []
            for i, (cls, text) in enumerate(zip(b.column("cls").to_pylist(), b.column("text").to_pylist())):
                part = slice(ends[i], ends[i + 1])
                order = np.lexsort((lo[part], grp[part]))
                g, f, a, z = grp[part][order], hot[part][order], lo[part][order].astype(np.int64), hi[part][order].astype(np.int64)
                new = np.r_[True, g[1:] != g[:-1]]
                nth = np.cumsum(new) << 40
                reach = np.maximum.accumulate(z + nth) - nth  # within its group
                begin = np.flatnonzero(new | np.r_[True, a[1:] - reach[:-1] > min_len])
                for x, y in zip(begin.tolist(), [*begin[1:].tolist(), len(g)]):
                    start = max(0, int(a[x]) - side)
                    rows.append((int(g[x]), cls, start, text[start : int(reach[y - 1]) + min_len], np.unique(a[x:y]).tolist(), bool(f[x])))
            if rows:
                types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(zip(*rows), types)], names=["grp", "cls", "start", "text", "at", "hot"])

    return run


def _window_batches(min_len: int, places: bool):
    """All substrings of ``min_len`` of each piece, as two hashes, with where they start if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = _Roller(1), _Roller(2)
        for b in slices(batches):
            for cls, start, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                for at in range(0, max(1, len(text) - min_len + 1), BLOCK):
                    part = text[at : at + BLOCK + min_len - 1]
                    g = one(part, min_len)
                    out = [pa.array(g.view(np.int64)), pa.array(two(part, min_len).view(np.int64)), pa.array(np.full(len(g), cls, np.int64))]
                    if places:
                        out.append(pa.array((start + at + np.arange(len(g))).astype(np.int64)))
                    yield pa.RecordBatch.from_arrays(out, names=["g", "g2", "cls", "at"][: len(out)])

    return run


def _paired(rows: DataFrame, keys: list[str], item: str) -> DataFrame:
    """Pairs ``a < b`` of the items of each key; a key of many items is split, so no task pairs more than ``COPIES`` with all."""
    n = rows.groupBy(*keys).agg(F.ceil(F.count("*") / COPIES).alias("parts"), F.count("*").alias("items")).filter("items > 1").drop("items")
    rows = rows.select(*keys, item).join(n, keys)
    left = rows.select(*keys, F.col(item).alias("a"), F.pmod(F.xxhash64(item), F.col("parts")).alias("part"))
    right = rows.select(*keys, F.col(item).alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    return left.join(right, [*keys, "part"]).filter("a < b").select("a", "b")


class SharedSpans:
    """The stages of the search over one table; see the module's text.

    Cases: null ids and null texts take no part; texts shorter than ``min_len`` share nothing; an id that occurs
    with several texts stands for all of them and never pairs with itself; repeated rows change nothing; empty
    tables give no rows; other columns are not read. Equal texts are handled once and paired at the end.
    """

    def __init__(self, docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_len: int = 200, hot: int = 1000, chunk: int = 400_000) -> None:
        if min_len < 2:
            raise ValueError("min_len must be at least 2")
        self.min_len, self.k, self.hot, self.chunk = min_len, max(1, min_len // 2), hot, chunk
        self.spark = docs.sparkSession
        docs = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).filter(
            F.col("id").isNotNull() & F.col("text").isNotNull() & (F.char_length("text") >= min_len)
        )
        x, y = F.xxhash64("text").alias("x"), F.xxhash64("text", F.lit(1)).alias("y")
        texts = docs.select("id", x, y, F.char_length("text").alias("n")).distinct()
        lead = texts.groupBy("x", "y").agg(F.min("id").alias("lead"), F.count("*").alias("copies"))
        # a text goes by its least id; an id that leads several texts goes by its hash for all but the first
        twice = lead.groupBy(F.col("lead").alias("id")).agg(F.count("*").alias("k"), F.min(F.struct("x", "y")).alias("first")).filter("k > 1")
        other = (F.col("first").isNotNull()) & (F.struct("x", "y") != F.col("first"))
        lead = lead.join(broadcast_if_small(twice.select(F.col("id").alias("lead"), "first"), 40), "lead", "left").select(
            "x", "y", "lead", "copies", F.when(other, F.xxhash64("lead", "x", "y").bitwiseOR(F.lit(-(2**63)))).otherwise(F.col("lead")).alias("cls")
        )
        self.members = materialize(texts.join(lead, ["x", "y"]).select("id", "x", "cls", "n", "copies", (F.col("id") == F.col("lead")).alias("leads")), "members")
        special = self.members.filter(~F.col("leads") | (F.col("id") != F.col("cls"))).select("id", "x", "leads", "cls")
        self.docs = (
            docs.withColumn("x", F.xxhash64("text"))
            .join(broadcast_if_small(special, 40), ["id", "x"], "left")
            .filter(F.coalesce("leads", F.lit(True)))
            .select(F.coalesce("cls", "id").alias("cls"), "text")
        )
        self._find()

    def _find(self) -> None:
        found = materialize(self.docs.mapInArrow(_anchor_batches(self.min_len, self.k), "h long, cls long, lo int, hi int"), "anchors")
        # a set of texts goes by its least, its number and exclusive or: equal sets are equal in all three, and sets
        # that are taken for equal by chance are only looked at together
        recurring = found.groupBy("h").agg(F.min("cls").alias("a"), F.count("*").alias("n"), F.bit_xor("cls").alias("x")).filter("n > 1")
        recurring = materialize(recurring.select("h", F.xxhash64("a", "n", "x").alias("grp"), (F.col("n") > self.hot).alias("hot")), "recurring")
        self.any_hot = recurring.filter("hot").limit(1).count() > 0
        # the anchors of one text: as many as it has characters at most
        by_text = found.join(recurring, "h").groupBy("cls").agg(F.collect_list(F.struct("grp", "hot", "lo", "hi")).alias("anchor"))
        by_text = materialize(by_text, "recurring-by-text")
        texts = self.docs.join(broadcast_if_small(by_text.select("cls"), 24), "cls", "left_semi")
        cut = texts.join(by_text, "cls").select("cls", "text", "anchor").mapInArrow(_cut_batches(self.min_len, self.k), "grp long, cls long, start long, text string, at array<long>, hot boolean")
        self.cut = materialize(cut, "pieces") if self.any_hot else cut

    def _confirm(self, extents: bool) -> DataFrame:
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        schema = "cls long, lo long, hi long" if extents else "a long, b long"
        return (
            self.cut.filter("NOT hot")
            .select("grp", "cls", "start", "text", "at")
            .repartition(parts, "grp")
            .sortWithinPartitions("grp")
            .mapInArrow(_confirm_batches(self.min_len, self.k, extents, self.chunk), schema)
        )

    def _windows(self, places: bool) -> DataFrame:
        """Windows of hot groups that two or more texts share."""
        schema = "g long, g2 long, cls long" + (", at long" if places else "")
        win = self.cut.filter("hot").select("cls", "start", "text").mapInArrow(_window_batches(self.min_len, places), schema)
        win = materialize(win if places else win.distinct(), "windows")
        shared = win.groupBy("g", "g2").agg(F.min("cls").alias("a"), F.max("cls").alias("b")).filter("a != b").select("g", "g2")
        return win.join(shared, ["g", "g2"])

    def text_pairs(self) -> DataFrame:
        """Distinct pairs ``a < b`` of text classes that share a span."""
        pairs = self._confirm(False)
        if self.any_hot:
            win = materialize(self._windows(False), "shared-windows")
            # one window stands for all that have the same set of texts, as it does for anchors
            sets = win.groupBy("g", "g2").agg(F.min("cls").alias("a"), F.max("cls").alias("b"), F.count("*").alias("n"), F.sum(F.xxhash64("cls").cast("decimal(38,0)")).alias("total"))
            lead = sets.groupBy("a", "b", "n", "total").agg(F.min(F.struct("g", "g2")).alias("m")).select("m.g", "m.g2")
            pairs = pairs.unionByName(_paired(win.join(lead, ["g", "g2"]), ["g", "g2"], "cls"))
        return pairs.distinct()

    def classes(self) -> DataFrame:
        """``doc_id, class``: ids of equal texts have one class. With ``text_pairs`` all links, without pairs of copies."""
        return self.members.select(F.col("id").alias("doc_id"), F.col("cls").alias("class"))

    def _ids(self, pairs: DataFrame, side: str, name: str) -> DataFrame:
        """``pairs`` with the ids of the class in ``side``; a class of many copies is split over tasks."""
        parts = F.ceil(F.col("copies") / COPIES)
        m = self.members.select(F.col("cls").alias(side), F.col("id").alias(name), F.pmod(F.xxhash64("id"), parts).alias("part"))
        large = self.members.filter(F.col("copies") > COPIES).select(F.col("cls").alias(side), parts.alias("parts")).distinct()
        pairs = pairs.join(broadcast_if_small(large, 32), side, "left")
        pairs = pairs.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
        return pairs.join(m, [side, "part"]).drop(side, "part")

    def pairs(self) -> DataFrame:
        """Distinct pairs of ids, ``doc_a < doc_b``, whose texts share at least ``min_len`` characters."""
        pairs = self._ids(self._ids(self.text_pairs(), "a", "x"), "b", "y")
        same = _paired(self.members.filter("copies > 1").select("cls", "id"), ["cls"], "id")
        both = pairs.select("x", "y").unionByName(same.select(F.col("a").alias("x"), F.col("b").alias("y"))).filter("x != y")
        return both.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b")).distinct()

    def report(self) -> DataFrame:
        """One row per id: characters, characters inside spans shared with another text or copy, their share, copies."""
        spans = self._confirm(True)
        if self.any_hot:
            spans = spans.unionByName(self._windows(True).select("cls", F.col("at").alias("lo"), (F.col("at") + self.min_len).alias("hi")))
        by_text = W.partitionBy("cls").orderBy("lo", "hi")
        before = by_text.rowsBetween(W.unboundedPreceding, -1)
        covered = (
            spans.distinct()
            .withColumn("seen", F.coalesce(F.max("hi").over(before), F.col("lo")))
            .groupBy("cls")
            .agg(F.sum(F.greatest(F.lit(0), F.col("hi") - F.greatest("lo", "seen"))).alias("shared_chars"))
        )
        rows = self.members.join(covered, "cls", "left")
        shared = F.when(F.col("copies") > 1, F.col("n")).otherwise(F.coalesce("shared_chars", F.lit(0)))
        return rows.select(F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_chars"), shared.cast("long").alias("shared_chars"), (shared / F.col("n")).alias("share"), (F.col("copies") - 1).alias("copies"))


def shared_spans(docs: DataFrame, **options) -> DataFrame:
    """Pairs of documents with a long verbatim span in common; see ``SharedSpans``."""
    return SharedSpans(docs, **options).pairs()


__all__ = ["SharedSpans", "anchors", "shared_spans"]
