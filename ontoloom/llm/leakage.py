"""Evaluation texts that leak into a corpus, found by greedy string tiling on words.

The test items are a small fixed set; their five-word seeds are indexed once and given to every task behind a
check of their size, in blocks if there are more. Every document is read once, whole, where it lies: no text moves.
Per document, shared seeds that lie along one diagonal (or cover much of an item) name candidate items; each
candidate is tiled greedily: Karp-Rabin runs with falling search lengths mark the longest matches that do not
overlap. The tiles give the coverage of the item, in any order, and its longest run in order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoloom.llm.spans import slices

SEED = 5  #: words of a seed
BAND = 16  #: width of a diagonal band in words
_MIX = np.uint64(0x9E3779B97F4A7C15)

#: Lines that are page headers.
_HEADER = re.compile(r"^[ \t]*+(?:[-–—][ \t]*+\d++[ \t]*+[-–—]|(?:page|seite)[ \t]++\d++[ \t]++(?:of|von|sur|de)[ \t]++\d++\b[^\n]*)[ \t]*+$", re.I | re.M)
_SPLIT = re.compile(r"(?<=\w)[-‐‑][^\S\n]*+\n\s*+(?=\w)")
_NOT_WORD = re.compile(r"[^\w\s]+|_+")


def _parts(text: str) -> list[str]:
    """What stands between white space, in folded case, without page headers and splits at line ends."""
    t = text.casefold()
    if "\n" in t:
        # a split word whose halves a page header parted is joined once the header is gone
        t = _SPLIT.sub("", _HEADER.sub("\n", t))
    return t.split()


def _word(part: str) -> str:
    """A part without punctuation; hyphens join, so ``a-b`` is one word."""
    return part if part.isalnum() else _NOT_WORD.sub("", part)


def words(text: str) -> list[str]:
    """Words in folded case without punctuation, page headers and splits at line ends."""
    return [w for w in map(_word, _parts(text)) if w]


class Rule(NamedTuple):
    """What counts as a leak: a run of ``run`` item words with at most one in ``per`` missing, plus ``slack``."""

    run: int = 30
    per: int = 10
    slack: int = 1
    insert: int = 6  #: document words that may stand between two tiles of a run
    coverage: float = 0.6  #: share of an item, in any order, from which it is reported too


class Index(NamedTuple):
    ids: np.ndarray
    starts: np.ndarray
    tokens: np.ndarray
    vocab: dict[str, int]
    known: dict[str, int]  #: parts met so far with their token, -1 for other words, -2 for no word
    keys: np.ndarray
    first: np.ndarray
    count: np.ndarray
    item: np.ndarray
    pos: np.ndarray


def _seeds(t: np.ndarray) -> np.ndarray:
    """Hash of each run of ``SEED`` words; runs with an unknown word are marked by the largest value."""
    n = len(t) - SEED + 1
    h = np.zeros(n, np.uint64)
    low = t[:n].copy()
    for k in range(SEED):
        part = t[k : k + n]
        h = (h ^ (part.astype(np.uint64) + np.uint64(k + 1))) * _MIX
        h ^= h >> np.uint64(29)
        np.minimum(low, part, out=low)
    h[low < 0] = np.uint64(2**64 - 1)
    return h


def build_index(items: list[tuple[int, str]]) -> Index:
    vocab: dict[str, int] = {}
    ids, starts, parts, keys, item, pos = [], [0], [], [], [], []
    for i, text in items:
        t = np.array([vocab.setdefault(w, len(vocab)) for w in words(text)], np.int64)
        ids.append(i)
        starts.append(starts[-1] + len(t))
        parts.append(t)
        if len(t) >= SEED:
            h = _seeds(t)
            keys.append(h)
            item.append(np.full(len(h), len(ids) - 1, np.int32))
            pos.append(np.arange(len(h), dtype=np.int32))
    cat = lambda x, d: np.concatenate(x) if x else np.empty(0, d)
    k, it, po = cat(keys, np.uint64), cat(item, np.int32), cat(pos, np.int32)
    order = np.argsort(k, kind="stable")
    u, first, count = np.unique(k[order], return_index=True, return_counts=True)
    return Index(np.array(ids, np.int64), np.array(starts), cat(parts, np.int64).astype(np.int32), vocab, {}, u, first.astype(np.int32), count.astype(np.int32), it[order], po[order])


class _Running:
    """Karp-Rabin hashes of all windows of one text: any window by one subtraction from the running sums."""

    _BASE, _BACK = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

    def __init__(self, tokens: np.ndarray) -> None:
        n = len(tokens)
        powers = np.ones(n + 1, np.uint64)
        powers[1:] = self._BASE
        self.back = np.ones(n + 1, np.uint64)
        self.back[1:] = self._BACK
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((tokens.astype(np.uint64) + np.uint64(2)) * _MIX * np.multiply.accumulate(powers)[:n], out=self.sums[1:])
        self.back = np.multiply.accumulate(self.back)
        self.marked = np.zeros(n, bool)

    def windows(self, s: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the windows of ``s`` tokens that hold no marked one."""
        n = len(self.marked) - s + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        seen = np.cumsum(np.r_[0, self.marked])
        at = np.flatnonzero(seen[s:] == seen[:n])
        return at, (self.sums[at + s] - self.sums[at]) * self.back[at]


def _matches(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places ``i, j`` with ``x[i] == y[j]``."""
    order = np.argsort(x, kind="stable")
    lo, hi = np.searchsorted(x[order], y, "left"), np.searchsorted(x[order], y, "right")
    n = hi - lo
    at = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
    return order[at], np.repeat(np.arange(len(y)), n)


def _tokens(text: str, index: Index, most: int = 500_000) -> np.ndarray:
    """Tokens of a text's words, -1 for words that no item has; ``most`` parts are remembered."""
    parts, known = _parts(text), index.known
    for p in set(parts).difference(known):
        w = _word(p)
        known[p] = index.vocab.get(w, -1) if w else -2
    t = np.fromiter(map(known.__getitem__, parts), np.int64, len(parts))
    if len(known) > most:
        known.clear()
    return t[t != -2]


def tiles(a: np.ndarray | list[int], b: np.ndarray | list[int], shortest: int = 3, longest: int = 24, shift: tuple[int, int] | None = None) -> list[tuple[int, int, int]]:
    """Greedy string tiling by running Karp-Rabin: ``(start in a, start in b, length)``, none overlapping.

    With ``shift`` only matches whose start in ``b`` less that in ``a`` lies within it.
    """
    a, b = np.asarray(a, np.int64), np.asarray(b, np.int64)
    x, y = _Running(a), _Running(b)
    la, lb = a.tolist(), b.tolist()
    out: list[tuple[int, int, int]] = []
    s = longest
    while s >= shortest:
        (at, h), (bt, g) = x.windows(s), y.windows(s)
        ii, jj = _matches(h, g)
        ii, jj = at[ii], bt[jj]
        if shift is not None:
            near = (jj - ii >= shift[0]) & (jj - ii <= shift[1])
            ii, jj = ii[near], jj[near]
        inner = (ii > 0) & (jj > 0)
        p, q = np.maximum(ii - 1, 0), np.maximum(jj - 1, 0)
        # a match that goes on to the left is a part of another
        first = ~(inner & ~x.marked[p] & ~y.marked[q] & (a[p] == b[q]))
        free_a, free_b = (~x.marked).tolist(), (~y.marked).tolist()
        found: list[tuple[int, int, int]] = []
        for i, j in zip(ii[first].tolist(), jj[first].tolist()):
            k = 0  # equal hashes are compared token by token
            while i + k < len(la) and j + k < len(lb) and la[i + k] == lb[j + k] and free_a[i + k] and free_b[j + k]:
                k += 1
            if k >= s:
                found.append((k, i, j))
        found.sort(reverse=True)
        again = False
        for k, i, j in found:
            if x.marked[i : i + k].any() or y.marked[j : j + k].any():
                again = True  # what is left of an occluded match may still be a tile
            else:
                x.marked[i : i + k] = True
                y.marked[j : j + k] = True
                out.append((i, j, k))
        if not again:
            s = shortest if s > shortest and s // 2 < shortest else s // 2
    return sorted(out)


def _beyond(a: list[int], b: list[int], i: int, j: int, step: int, most: int) -> list[tuple[int, int]]:
    """``(item words, missing)`` by which a run grows that has ``i`` and ``j`` next in direction ``step``.

    Words that are altered or dropped, up to ``most`` in all, are stepped over if a word that is kept follows.
    """
    got = {0: 0}
    todo = [(i, j, 0, 0)]
    while todo:
        i, j, n, missing = todo.pop()
        for skip in range(most - missing + 1):
            for other in range(skip + 1):
                x, y, k = i + step * skip, j + step * other, 0
                while 0 <= x < len(a) and 0 <= y < len(b) and a[x] == b[y]:
                    x, y, k = x + step, y + step, k + 1
                if k and n + skip + k > got.get(missing + skip, 0):
                    got[missing + skip] = n + skip + k
                    todo.append((x, y, n + skip + k, missing + skip))
    return [(n, missing) for missing, n in got.items()]


def best_run(a: list[int], b: list[int], parts: list[tuple[int, int, int]], rule: Rule) -> tuple[int, int]:
    """Longest run of item words in order: its length and how many of its words are missing.

    Tiles follow each other in both texts; between two tiles words that are equal at the same distance count
    as kept. At both ends of a run words count too that are too few for a tile, beyond altered ones. Of the runs that obey the rule the longest counts; without one, the longest of all by kept words.
    """
    best, fallback = (0, 0), (0, 0)
    most = rule.run // rule.per + rule.slack
    # each state: start in item, end in item, end in document, missing words
    states: list[list[tuple[int, int]]] = []  # per tile: (start, missing) choices, few as they are pruned
    for x, (i, j, k) in enumerate(parts):
        own = [(i - n, missing) for n, missing in _beyond(a, b, i - 1, j - 1, -1, most)]
        for y in range(x):
            pi, pj, pk = parts[y]
            ga, gb = i - (pi + pk), j - (pj + pk)
            if ga < 0 or gb < 0 or gb > ga + rule.insert or ga > rule.run:
                continue
            miss = ga - (sum(a[pi + pk + z] == b[pj + pk + z] for z in range(ga)) if ga == gb else 0)
            own.extend((start, missing + miss) for start, missing in states[y])
        kept: dict[int, int] = {}
        for start, missing in own:
            kept[start] = min(missing, kept.get(start, missing))
        states.append(sorted(kept.items()))
        ends = _beyond(a, b, i + k, j + k, 1, most)
        for start, before in states[-1]:
            for more, after in ends:
                n, missing = i + k + more - start, before + after
                if missing <= n / rule.per + rule.slack:
                    best = max(best, (n, -missing))
                fallback = max(fallback, (n - missing, -missing))
    n, m = best if best[0] else (fallback[0] - fallback[1], fallback[1])
    return n, -m


def _spread(count: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each place its number from 0 to ``count`` less one, in parts of about ``most``: a place of many is split too."""
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    for lo in range(0, total, most):
        n = np.arange(lo, min(total, lo + most))
        places = np.searchsorted(ends, n, "right")
        yield places, n - (ends[places] - count[places])


def find_in(text: str, index: Index, rule: Rule, most: int = 1_000_000) -> list[tuple[int, int, int, float]]:
    """``item_id, run, missing, coverage`` of the candidate items of one document.

    Seeds that many items share are counted per item, ``most`` at a time; only candidates are looked at more closely.
    """
    t = _tokens(text, index)
    if len(t) < SEED or not len(index.keys):
        return []
    h = _seeds(t)
    at = np.searchsorted(index.keys, h)
    at[at == len(index.keys)] = 0
    hit = np.flatnonzero(index.keys[at] == h)
    if not len(hit):
        return []
    key = at[hit]
    # hits per item along two neighbouring diagonal bands, and distinct seeds per item in any order
    longest = int(np.diff(index.starts).max())
    width = (len(t) + longest) // BAND + 2
    codes, seeds = [], np.zeros(len(index.ids), np.int64)
    for places, which in _spread(index.count[np.unique(key)], most):
        ref = index.first[np.unique(key)[places]] + which
        np.add.at(seeds, index.item[ref], 1)
    for places, which in _spread(index.count[key], most):
        ref = index.first[key[places]] + which
        codes.append(np.unique(index.item[ref].astype(np.int64) * width + (hit[places] - index.pos[ref] + longest) // BAND, return_counts=True))
    u, back = np.unique(np.concatenate([x for x, _ in codes]), return_inverse=True)
    c = np.bincount(back, np.concatenate([x for _, x in codes])).astype(np.int64)
    both = c + np.where(np.r_[u[1:] == u[:-1] + 1, False], np.r_[c[1:], 0], 0)
    # a run of `run` words with the words missing that the rule allows keeps at least this many seeds
    gaps = rule.run // rule.per + rule.slack
    least = max(1, rule.run - gaps - (SEED - 1) * (gaps + 1))
    cand = set((u[both >= least] // width).tolist())
    length = np.diff(index.starts)
    cand |= set(np.flatnonzero((seeds > 0) & (seeds + SEED - 1 >= rule.coverage * length)).tolist())
    around = SEED * (gaps + 1)  # the end of a run that holds no seed is shorter
    out = []
    for x in sorted(cand):
        a = index.tokens[index.starts[x] : index.starts[x + 1]].astype(np.int64)
        i, place = _matches(_seeds(a), h[hit])
        d = hit[place]
        seen, seen_cover = (False, 0, 0), 0.0
        order = np.argsort(d, kind="stable")
        d, i = d[order], i[order]
        # stretches of the document whose seeds of this item lie close together
        for part in np.split(np.arange(len(d)), np.flatnonzero(np.diff(d) > len(a)) + 1):
            lo = max(0, int(d[part].min()) - around)
            hi = min(len(t), int(d[part].max()) + SEED + around)
            b = t[lo:hi]
            got = tiles(a, b)
            seen_cover = max(seen_cover, sum(k for _, _, k in got) / len(a))
            tilings = [(b, got)]
            # each copy of a passage by itself too: together they share the words of the item
            apart = part[np.argsort(d[part] - i[part], kind="stable")]
            copies = np.split(apart, np.flatnonzero(np.diff(d[apart] - i[apart]) > BAND) + 1)
            for copy in copies if len(copies) > 1 else []:
                if len(copy) >= least:
                    lo = max(0, int(d[copy].min()) - around)
                    hi = min(len(t), int(d[copy].max()) + SEED + around)
                    shifts = d[copy] - i[copy] - lo
                    b = t[lo:hi]
                    tilings.append((b, tiles(a, b, shift=(int(shifts.min()) - BAND // 2, int(shifts.max()) + BAND // 2))))
            for b, got in tilings:
                run, missing = best_run(a.tolist(), b.tolist(), got, rule)
                ok = run >= rule.run and missing <= run / rule.per + rule.slack
                seen = max(seen, (ok, run, -missing))
        ok, run, missing = seen
        if ok or seen_cover >= rule.coverage:
            out.append((int(index.ids[x]), run if ok else 0, -missing if ok else 0, seen_cover))
    return out


def leaked_items(
    docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", rule: Rule | None = None, block_chars: int = 4_000_000
) -> DataFrame:
    """``doc_id, item_id, run, missing, coverage``: items that a document contains, fully or in part.

    ``run`` is the longest stretch of consecutive item words in order that obeys ``rule`` (0 if none), ``coverage``
    the share of the item under tiles in any order, which catches reordered passages.

    Cases: null ids or texts take no part; empty texts and items shorter than a seed match nothing; repeated
    rows and several texts of one id count once with the best values; items beyond ``block_chars`` characters go
    in further blocks, each against all documents; empty tables give no rows; other columns are not read.
    """
    rule = rule or Rule()
    spark = docs.sparkSession
    i = items.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).filter(F.col("i").isNotNull() & F.col("t").isNotNull()).distinct()
    chars = i.agg(F.sum(F.char_length("t"))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    schema = "doc_id long, item_id long, run long, missing long, coverage double"
    out = None
    for block in range(blocks):
        rows = [(r.i, r.t) for r in i.filter(F.pmod(F.xxhash64("i"), F.lit(blocks)) == block).orderBy("i", "t").collect()]
        shared = spark.sparkContext.broadcast(build_index(rows))
        part = d.mapInArrow(_batches(shared, rule), schema)
        out = part if out is None else out.unionByName(part)
    return out.groupBy("doc_id", "item_id").agg(F.max(F.struct("run", "coverage", "missing")).alias("m"), F.max("coverage").alias("coverage")).select(
        "doc_id", "item_id", F.col("m.run").alias("run"), F.col("m.missing").alias("missing"), "coverage"
    )


def _batches(shared, rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = [(d, *r) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for r in find_in(t, shared.value, rule)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names=["doc_id", "item_id", "run", "missing", "coverage"])

    return run
