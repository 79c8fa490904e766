"""SimHash near-duplicates by a binary trie self-join; one document of each group alike, by an exact join of sets.

Fingerprints are strings of 64 bits, leaves of a binary trie. The join goes down the trie in pairs of nodes, adds up
the bits in which a pair's branches differ, and drops a pair as soon as that exceeds the error budget.

Node pairs are dealt out to tasks by blocks of bits: of ``blocks`` blocks, two fingerprints within the radius differ
by at most radius // blocks bits in one, so the pair meets in the cell of that block. A cell with too many rows is cut
into the pairs of nodes some bits further down that both exist and are within what is left of the budget, again and
again until no task holds more than it should. A cell passes on a spanning forest of its links, one row a
fingerprint, and components come from alternating large-star and small-star rounds over those rows.

The pipeline keeps one of near copies (``keep_one``) by sets of shingles, not by fingerprints: a fingerprint can miss a
pair that is alike. Sets that are alike share one of their rare shingles, and meet there. What is shuffled is small: of a
rare shingle some bits, of a pair that meets a row of bits that tells most unlike ones, and texts of the pairs left.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import SMALL, among, binary, lookup, partitions, shingle_hashes, sliced, table, text_or_empty, written

SHINGLE = 3


@dataclass(frozen=True)
class Linking:
    """radius: most differing bits of a link. confirm: most differing bits of the second fingerprint (None: no second).

    cell: most rows of a cell before it is cut ``step`` bits further down.
    """

    radius: int = 3
    blocks: int = 4
    confirm: int | None = None
    cell: int = 1 << 14
    step: int = 6


def majority(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes; 0 of none."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(data: bytes, shingle: int = SHINGLE) -> int:
    """The majority of the shingles' XXH64 (seed 42), repeats included; 0 without words."""
    return majority(shingle_hashes(data, shingle))


def _mixed(values: np.ndarray) -> np.ndarray:
    """Other hashes of hashes (the finisher of splitmix64)."""
    values = values + np.uint64(0x9E3779B97F4A7C15)
    values = (values ^ values >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ values >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return values ^ values >> np.uint64(31)


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, dtype=np.uint64).view(np.int64))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, fp, fp2, node) of each row.

    fp: the fingerprint as a signed long; fp2: 0; mark: a hash of the text, to tell apart rows of one doc_id; node:
    what the join links, here the fingerprint.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), _signed([fingerprint(x) for x in binary(batch, "text")])], names=["doc_id", "mark", "fp"])

    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("mark"), "text").mapInArrow(run, "doc_id long, mark long, fp long")
    return made.select("doc_id", "mark", "fp", F.lit(0).cast("long").alias("fp2"), F.col("fp").alias("node"))


def spans(blocks: int) -> list[tuple[int, int]]:
    """(shift, width) of each block, the uppermost first."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    return [(64 - b, b - a) for a, b in zip(edges, edges[1:])]


def rotated(values: np.ndarray, shift: int, width: int) -> np.ndarray:
    """Bits turned so that the block comes first: the order of a cell's trie."""
    left = 64 - shift - width
    return values if not left else (values << np.uint64(left)) | (values >> np.uint64(64 - left))


def masks(width: int, errors: int) -> list[int]:
    return [sum(1 << i for i in c) for n in range(1, errors + 1) for c in combinations(range(width), n)]


def _cells(prefix: np.ndarray, block: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """A cell's key: a hash of its block and of the upper ``depth`` bits of what it holds (no harm if two share one)."""
    return _mixed(prefix ^ _mixed(block.astype(np.uint64) << np.uint64(8) | depth.astype(np.uint64))).view(np.int64)


ROW = "cell long, block int, depth int, prefix long, turned long, fp2 long, node long, home boolean"


def _rows(prefix, block, depth, turned, fp2, node, home) -> pa.RecordBatch:
    columns = [_cells(prefix, block, depth), block.astype(np.int32), depth.astype(np.int32), prefix.view(np.int64), turned.view(np.int64), fp2, node, home]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=[c.split()[0] for c in ROW.split(", ")])


def _dealt(nodes: DataFrame, how: Linking) -> DataFrame:
    """Rows (ROW): each node at home in its own cell of each block, and as a guest in near cells.

    Of two cells that differ, the one with the smaller bits sends.
    """
    near = how.radius // how.blocks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, fp2, node = (batch.column(c).to_numpy() for c in ("fp", "fp2", "node"))
            for b, (shift, width) in enumerate(spans(how.blocks)):
                turned = rotated(fp.view(np.uint64), shift, width)
                down = np.uint64(64 - width)
                value = turned >> down
                for m in (0, *masks(width, near)):
                    target = value ^ np.uint64(m)
                    take = np.flatnonzero(target > value) if m else np.arange(len(fp))
                    if len(take):
                        yield _rows(target[take] << down, np.full(len(take), b), np.full(len(take), width), turned[take], fp2[take], node[take], np.full(len(take), not m))

    return nodes.select("fp", "fp2", "node").mapInArrow(run, ROW)


def _cut(rows: DataFrame, how: Linking) -> DataFrame:
    """Rows of cells as rows of the cells ``step`` bits further down: at home in one, guests in all within the budget."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, depth, prefix, turned, fp2, node = (batch.column(c).to_numpy() for c in ("block", "depth", "prefix", "turned", "fp2", "node"))
            home = batch.column("home").to_numpy(zero_copy_only=False)
            prefix, turned = prefix.view(np.uint64), turned.view(np.uint64)
            for at in np.unique(depth).tolist():  # few: blocks differ by a bit
                here = np.flatnonzero(depth == at)
                bits = min(how.step, 64 - at)
                down = np.uint64(64 - at - bits)
                spent = np.bitwise_count((turned[here] ^ prefix[here]) >> np.uint64(64 - at))
                own = turned[here] >> down & np.uint64((1 << bits) - 1)
                for m in (0, *masks(bits, min(bits, how.radius))):
                    target = own ^ np.uint64(m)
                    fits = spent + m.bit_count() <= how.radius
                    if m:
                        fits &= ~home[here] | (target > own)
                    take = here[fits]
                    if len(take):
                        yield _rows(prefix[take] | target[fits] << down, block[take], np.full(len(take), at + bits), turned[take], fp2[take], node[take], home[take] & (not m))

    return rows.mapInArrow(run, ROW)


class Forest:
    """Least-index union-find over 0..n-1, fed with arrays of links."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def roots(self, at: np.ndarray) -> np.ndarray:
        at = self.parent[at]
        while True:
            up = self.parent[at]
            if (up == at).all():
                return at
            at = up

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.roots(a), self.roots(b)
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.parent, np.maximum(x, y), np.minimum(x, y))


#: Node pairs that are gone through at a time, leaf pairs below which a node pair's are compared at once, and most
#: leaf pairs that are held at a time.
FRONT, LEAVES, PAIRS = 1 << 15, 64, 1 << 20


def _first_set(values: np.ndarray, low: np.ndarray, high: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """Where in each sorted range [low, high) the bit turns 1."""
    low, high = low.copy(), high.copy()
    while True:
        open_ = low < high
        if not open_.any():
            return low
        mid = (low + high) >> 1
        ones = (values[np.where(open_, mid, 0)] >> bit) & np.uint64(1) == 1
        high = np.where(open_ & ones, mid, high)
        low = np.where(open_ & ~ones, mid + 1, low)


def _compared(a, b, a0, b0, na, nb, radius: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The leaf pairs of node pairs that are within the radius, some PAIRS compared at a time."""
    total = na * nb
    group = np.cumsum(total) // PAIRS
    cuts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else []
    for lo, hi in zip(cuts, [*cuts[1:], len(total)]):
        n, m = total[lo:hi], nb[lo:hi]
        which = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        i, j = a0[lo:hi][which] + at // m[which], b0[lo:hi][which] + at % m[which]
        hit = np.bitwise_count(a[i] ^ b[j]) <= radius
        if same:
            hit &= i < j
        yield i[hit], j[hit]


def trie_join(a: np.ndarray, b: np.ndarray, ranges: list[np.ndarray], depth: np.ndarray, errors: np.ndarray, radius: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) of leaves within the radius, below node pairs given as ranges [a0, a1) x [b0, b1).

    Values of a range are sorted and share their first ``depth`` bits (within a and within b); ``errors`` bits of
    those differ. ``same``: a is b, and a pair comes once.
    """
    stack = [(*ranges, depth, errors)]
    while stack:
        a0, a1, b0, b1, d, e = stack.pop()
        if len(a0) > FRONT:
            half = len(a0) // 2
            stack += [tuple(x[half:] for x in (a0, a1, b0, b1, d, e)), tuple(x[:half] for x in (a0, a1, b0, b1, d, e))]
            continue
        na, nb = a1 - a0, b1 - b0
        wide = (d >= 64) & (na * nb > PAIRS)  # many leaves of one value
        if wide.any():
            mid = (a0 + a1) >> 1
            stack += [tuple(x[wide] for x in (a0, mid, b0, b1, d, e)), tuple(x[wide] for x in (mid, a1, b0, b1, d, e))]
            a0, a1, b0, b1, d, e, na, nb = (x[~wide] for x in (a0, a1, b0, b1, d, e, na, nb))
        small = (na * nb <= LEAVES) | (d >= 64)
        yield from _compared(a, b, a0[small], b0[small], na[small], nb[small], radius, same)
        a0, a1, b0, b1, d, e = (x[~small] for x in (a0, a1, b0, b1, d, e))
        if not len(a0):
            continue
        bit = (63 - d).astype(np.uint64)
        am, bm = _first_set(a, a0, a1, bit), _first_set(b, b0, b1, bit)
        own = (a0 == b0) & (a1 == b1) if same else np.zeros(len(a0), dtype=bool)
        parts = []
        for x0, x1, y0, y1, more, skip in ((a0, am, b0, bm, 0, None), (am, a1, bm, b1, 0, None), (a0, am, bm, b1, 1, None), (am, a1, b0, bm, 1, own)):
            keep = (x0 < x1) & (y0 < y1) & (e + more <= radius)
            if skip is not None:
                keep &= ~skip
            parts.append((x0[keep], x1[keep], y0[keep], y1[keep], d[keep] + 1, e[keep] + more))
        stack.append(tuple(np.concatenate(x) for x in zip(*parts)))


#: Pairs of a cell from which it is first sought whether one of its nodes is linked to most others.
DENSE = 1 << 18


class _Cells:
    """Whole cells: rows (cell, turned, fp2, node, home) in order of cell, homes before guests, turned."""

    def __init__(self, rows: list[np.ndarray], how: Linking) -> None:
        cell, turned, fp2, node, home = rows
        order = np.lexsort((turned, ~home, cell))
        cell, self.turned, self.fp2, node, home = (x[order] for x in (cell, turned, fp2, node, home))
        self.how = how
        self.names, self.index = np.unique(node, return_inverse=True)
        self.forest = Forest(len(self.names))
        self.starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        self.ends = np.r_[self.starts[1:], len(cell)]
        self.homes = self.starts + np.add.reduceat(home.astype(np.int64), self.starts)

    def _link(self, i: np.ndarray, j: np.ndarray) -> None:
        if self.how.confirm is not None:
            near = np.bitwise_count(self.fp2[i] ^ self.fp2[j]) <= self.how.confirm
            i, j = i[near], j[near]
        self.forest.link(self.index[i], self.index[j])

    def _across(self, a: np.ndarray, b: np.ndarray | None = None) -> None:
        """Links between rows a and b, or among a; both in order of turned."""
        other, zero = a if b is None else b, np.zeros(1, dtype=np.int64)
        if len(a) and len(other):
            ranges = [zero, zero + len(a), zero, zero + len(other)]
            for i, j in trie_join(self.turned[a], self.turned[other], ranges, zero, zero, self.how.radius, b is None):
                self._link(a[i], other[j])

    def _dense(self, a: np.ndarray, guests: np.ndarray) -> None:
        """Links among a, and from a to guests, as far as they connect anything.

        Rows linked to one centre are connected, so no pair of them is compared: a cell of near copies of one text
        takes time in proportion to its rows.
        """
        while len(a) * (len(a) + len(guests)) >= DENSE:
            near = np.zeros(len(a), dtype=np.int64)
            for values in (self.turned[a], self.fp2[a]):
                near += np.bitwise_count(values ^ np.uint64(majority(values)))
            centre = a[near.argmin()]
            found = [np.bitwise_count(self.turned[x] ^ self.turned[centre]) <= self.how.radius for x in (a, guests)]
            if self.how.confirm is not None:
                found = [f & (np.bitwise_count(self.fp2[x] ^ self.fp2[centre]) <= self.how.confirm) for f, x in zip(found, (a, guests))]
            if found[0].sum() * 8 < len(a):
                break
            for f, x in zip(found, (a, guests)):
                self.forest.link(self.index[x[f]], np.full(f.sum(), self.index[centre]))
            self._across(a[~found[0]], a[found[0]])
            self._across(a[~found[0]], guests[found[1]])
            self._across(a[found[0]], guests[~found[1]])
            a, guests = a[~found[0]], guests[~found[1]]
        self._across(a)
        self._across(a, guests)

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """(node, least node of its local component); nodes alone are left out."""
        n = self.homes - self.starts
        dense = n * (self.ends - self.starts) >= DENSE
        for b0, b1, same in ((self.starts, self.homes, True), (self.homes, self.ends, False)):
            live = ~dense & (n > 0) & (b0 < b1)
            zero = np.zeros(live.sum(), dtype=np.int64)
            for i, j in trie_join(self.turned, self.turned, [self.starts[live], self.homes[live], b0[live], b1[live]], zero, zero, self.how.radius, same):
                self._link(i, j)
        for at in np.flatnonzero(dense):
            self._dense(np.arange(self.starts[at], self.homes[at]), np.arange(self.homes[at], self.ends[at]))
        roots = self.forest.roots(np.arange(len(self.names)))
        linked = roots != np.arange(len(self.names))
        return self.names[linked], self.names[roots[linked]]


#: Rows of whole cells that are joined at a time, and bytes of a row.
ROWS, WIDTH = 1 << 17, 40


def _joined(dealt: DataFrame, how: Linking, rows: int) -> DataFrame:
    spark = dealt.sparkSession
    sorted_ = dealt.select("cell", "turned", "fp2", "node", "home").repartition(partitions(spark, rows * WIDTH), "cell").sortWithinPartitions("cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows):
            a, b = _Cells(rows, how).links()
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy().view(np.uint64), batch.column(3).to_numpy(), batch.column(4).to_numpy(zero_copy_only=False)])
            n += batch.num_rows
            if n >= ROWS:
                rows = [np.concatenate(x) for x in zip(*held)]
                cut = np.searchsorted(rows[0], rows[0][-1])  # the last cell may go on
                if cut:
                    yield out([x[:cut] for x in rows])
                held, n = [[x[cut:] for x in rows]], len(rows[0]) - cut
        if n:
            yield out([np.concatenate(x) for x in zip(*held)])

    return sorted_.mapInArrow(run, "a long, b long")


def links(nodes: DataFrame, how: Linking) -> DataFrame:
    """Links (a, b), b < a, that connect all nodes (fp, fp2, node) within the radius: forests of each cell."""
    dealt = _dealt(nodes, how)
    hot = lambda rows: rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("depth").alias("depth")).filter((F.col("n") > how.cell) & (F.col("depth") < 64)).select("cell")
    rows = nodes.count() * sum(1 + len(masks(width, how.radius // how.blocks)) // 2 for _, width in spans(how.blocks))
    large = written(hot(dealt))
    if large.isEmpty():
        return _joined(dealt, how, rows)
    parts = [dealt.join(large, "cell", "left_anti")]
    now = written(dealt.join(large, "cell", "left_semi"))
    while not now.isEmpty():
        deeper = _cut(now, how)
        deeper = written(deeper.join(deeper.filter("home").select("cell").distinct(), "cell", "left_semi"))  # node pairs that exist
        rows += deeper.count()
        large = written(hot(deeper))
        parts.append(deeper.join(large, "cell", "left_anti"))
        now = written(deeper.join(large, "cell", "left_semi"))
    return _joined(reduce(DataFrame.unionByName, parts), how, rows)


#: Edges of which a task makes stars at a time.
EDGES = 1 << 18


def _contracted(edges: DataFrame, total: int) -> DataFrame:
    """Edges (a, b), b < a, that connect what ``edges`` (``total`` rows) do: of some EDGES at a time, stars about the least node.

    A node in many cells has an edge from each. Here it gets one a run, before anything is shuffled; what runs have
    apart is left to the rounds.
    """

    def stars(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        names, index = np.unique(np.concatenate([a, b]), return_inverse=True)
        forest = Forest(len(names))
        forest.link(index[: len(a)], index[len(a) :])
        roots = forest.roots(np.arange(len(names)))
        linked = roots != np.arange(len(names))
        return pa.RecordBatch.from_arrays([pa.array(names[linked]), pa.array(names[roots[linked]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append([batch.column(c).to_numpy() for c in ("a", "b")])
            n += batch.num_rows
            if n >= EDGES:
                yield stars(*(np.concatenate(x) for x in zip(*held)))
                held, n = [], 0
        if n:
            yield stars(*(np.concatenate(x) for x in zip(*held)))

    return edges.select("a", "b").coalesce(max(1, -(-total // EDGES))).mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that can be reached, for nodes with an edge (a, b). Rounds are written to the shared folder."""
    now = written(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    total = now.count()
    now = written(_contracted(now, total))
    both_ends = lambda: now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    if total <= EDGES:  # one run has held them all
        return both_ends()
    now = written(now.distinct())
    was = None
    while True:
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40))).first())
        if state == was:
            return both_ends()
        was = state
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"), F.count("*").alias("n"))
        large = lookup(both, least, "a", 2 * state[0]).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = lookup(large, least, "a", state[0]).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        now = written(small)


def _nodes(marked: DataFrame) -> DataFrame:
    """(node, fp, fp2, least, n): its first document (unknown, doc_id, mark), null ids last, and its rows."""
    document = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "mark")
    return marked.groupBy("node", "fp", "fp2").agg(F.min(document).alias("least"), F.count("*").alias("n"))


def near_duplicates(docs: DataFrame, how: Linking = Linking()) -> DataFrame:
    """(doc_id, fp, component_id) of each row: its fingerprint and the smallest doc_id that links can reach.

    Equal fingerprints are one node, however many rows share it; only (doc_id, fingerprint) is shuffled, never text.
    Null and empty texts have fingerprint 0 and link like any other. A null doc_id is never a component's smallest
    unless the component has no other. Very long texts are read in parts. Other columns are left out; repeated rows
    come out as often as they are; an empty table gives an empty table.
    """
    marked = written(fingerprints(docs))
    nodes = written(_nodes(marked))
    found = written(components(links(nodes, how)))
    firsts = nodes.join(found, "node").groupBy("root").agg(F.min("least").alias("_least"), F.count("*").alias("n"))
    better = lookup(found, firsts, "root", found.count()).select("node", "_least")
    labelled = nodes.join(better, "node", "left").select("node", "n", F.coalesce("_least", "least").alias("least"))
    return lookup(marked, labelled, "node", marked.count()).select("doc_id", "fp", F.col("least.doc_id").alias("component_id"))


@dataclass(frozen=True)
class Similar:
    """Documents alike: sets of shingles of ``words`` words whose Jaccard similarity is ``share`` or more.

    Shingles have one order for all documents, rare ones first. Of two sets alike, the first shingle that they have in
    common is among the first 1 - share of either (the prefix), so all pairs meet in a prefix shingle's bucket: none is
    left to chance. What meets is then compared exactly. The order comes from ``sample`` documents' most frequent
    shingles, ``frequent`` at most; it decides how few unlike texts meet, not which pairs are found.
    """

    words: int = 5
    share: float = 0.8
    sample: int = 20_000
    frequent: int = 1 << 18
    leaders: int = 8


def _set(data: bytes, words: int) -> np.ndarray:
    return np.unique(shingle_hashes(data, words))


def _frequent(docs: DataFrame, alike: Similar) -> tuple[np.ndarray, np.ndarray]:
    """The sample's most frequent shingles, sorted, and in how many of its documents each is: two or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            for data in binary(batch, "text"):
                yield pa.RecordBatch.from_arrays([pa.array(_set(data, alike.words).view(np.int64))], names=["token"])

    parts = max(1, -(-docs.count() // alike.sample))
    some = docs.select("doc_id", "text").filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)) == 0).select("text")
    counts = written(some.mapInArrow(run, "token long").groupBy("token").agg(F.count("*").alias("n")).filter("n > 1"))
    floor, total = 2, 0
    for n, tokens in sorted(((r.n, r.tokens) for r in counts.groupBy("n").agg(F.count("*").alias("tokens")).collect()), reverse=True):
        total += tokens
        if total > alike.frequent:
            floor = n + 1
            break
    found = counts.filter(F.col("n") >= floor).toArrow()
    token, n = found.column("token").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(token)
    return token[order], n[order]


def prefix(shingles: np.ndarray, known: tuple[np.ndarray, np.ndarray], share: float) -> np.ndarray:
    """The first shingles of a sorted set in the order of all documents: in how many of the sample, then the hash itself.

    One of them is in any set that is ``share`` alike; an empty set has none.
    """
    size = len(shingles)
    if not size:
        return shingles
    token, n = known
    often = np.zeros(size, dtype=np.int64)
    if len(token):
        at = np.minimum(np.searchsorted(token, shingles), len(token) - 1)
        often = np.where(token[at] == shingles, n[at], 0)
    return shingles[np.argsort(often, kind="stable")[: size - math.ceil(share * size - 1e-9) + 1]]


#: Bytes of a prefix shingle's hash that are kept, and most bits of a set's row of bits.
TOKEN, BITS = 5, 1 << 16


def _odd(shingles: np.ndarray) -> bytes:
    """The set's size, and a bit for each value of some last bits of a hash: whether an odd number of the set's have it.

    Sets that differ in n shingles have rows of bits that differ in n at most. There are at least as many bits as
    shingles, up to BITS.
    """
    width = min(BITS, 1 << max(6, (len(shingles) - 1).bit_length()))
    odd = np.bincount((shingles & np.uint64(width - 1)).view(np.int64), minlength=width) & 1
    return len(shingles).to_bytes(8, "little") + np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _bits(data: bytes) -> tuple[int, np.ndarray]:
    return int.from_bytes(data[:8], "little"), np.frombuffer(data, np.uint64, offset=8)


def _can_be_alike(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray], share: float) -> bool:
    """Whether two sets can be alike by their sizes and bits (``_bits``); True of all that are."""
    (n, x), (m, y) = a, b
    while len(x) != len(y):  # the longer is folded
        x, y = (x, y) if len(x) > len(y) else (y, x)
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum()) <= (1 - share) / (1 + share) * (n + m) + 1e-6


def _are_alike(a: np.ndarray, b: np.ndarray, share: float) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= share * (len(a) + len(b) - both)


def sketches(docs: DataFrame, alike: Similar) -> DataFrame:
    """(doc_id, mark, node, size, tokens, bits) of each row: a hash of its set of shingles, the set's size, TOKEN bytes of
    each shingle of its prefix, and its row of bits."""
    known = docs.sparkSession.sparkContext.broadcast(_frequent(docs, alike))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sizes, nodes, tokens, bits = [], [], [], []
            for data in binary(batch, "text"):
                found = _set(data, alike.words)
                sizes.append(len(found))
                nodes.append(xxhash.xxh3_64_intdigest(found.tobytes()))
                tokens.append(prefix(found, known.value, alike.share).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :TOKEN].tobytes())
                bits.append(_odd(found))
            made = [batch.column("doc_id"), batch.column("mark"), _signed(nodes), pa.array(sizes, pa.int32()), pa.array(tokens, pa.binary()), pa.array(bits, pa.binary())]
            yield pa.RecordBatch.from_arrays(made, names=["doc_id", "mark", "node", "size", "tokens", "bits"])

    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("mark"), "text")
    return wanted.mapInArrow(run, "doc_id long, mark long, node long, size int, tokens binary, bits binary")


def _packed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _unpacked(data: bytes) -> bytes:
    return pa.decompress(memoryview(data)[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, data): the compressed texts of the documents ``wanted`` (node, least); a fifth of what their shingles take."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([_packed(x) for x in binary(batch, "text")], pa.binary())], names=["node", "data"])

    wanted = wanted.select("node", F.col("least.doc_id").alias("doc_id"), F.col("least.mark").alias("mark"))
    return among(docs.select("doc_id", "text"), wanted, "inner").select("node", "text").mapInArrow(run, "node long, data binary")


def _shared(rows: DataFrame) -> DataFrame:
    """Rows (token, …) whose token another row has as well."""
    return rows.withColumn("_n", F.count("*").over(Window.partitionBy("token"))).filter("_n > 1").drop("_n")


#: Prefix shingles that are dealt out at a time, bytes that one takes in a bucket's task, and rows of a bucket up to
#: which each is held against all others.
DEALT, HELD, BUCKET = 1 << 20, 40, 64


def _written_small(token: np.ndarray, node: np.ndarray, pos: np.ndarray, size: np.ndarray) -> bytes:
    """Four last bytes of each token, and the rest in planes of bytes, compressed: nodes in order take little."""
    apart = np.diff(node, prepend=0)
    planes = b"".join(x.view(np.uint8).reshape(len(x), -1).T.tobytes() for x in (apart, pos.astype(np.int32), size.astype(np.int32)))
    return len(token).to_bytes(8, "little") + token.astype(np.uint32).tobytes() + pa.compress(planes, codec="zstd", asbytes=True)


def _read_small(data: bytes) -> list[np.ndarray]:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(memoryview(data)[8 + 4 * n :], 16 * n, codec="zstd", asbytes=True), np.uint8).reshape(16, n)
    apart, pos, size = (np.ascontiguousarray(planes[a:b].T).view(kind).ravel() for a, b, kind in ((0, 8, np.int64), (8, 12, np.int32), (12, 16, np.int32)))
    return [np.frombuffer(data, np.uint32, n, offset=8), np.cumsum(apart), pos, size]


def _fit(size: np.ndarray, pos: np.ndarray, size2: np.ndarray, pos2: np.ndarray, share: float) -> np.ndarray:
    """Whether two sets that share a shingle at their ``pos``, the first in common, can be alike by their sizes."""
    need = np.ceil(share / (1 + share) * (size + size2) - 1e-9)
    return (np.minimum(size, size2) >= share * np.maximum(size, size2) - 1e-9) & (np.minimum(size - pos, size2 - pos2) >= need)


def _in_company(token: np.ndarray, node: np.ndarray, pos: np.ndarray, size: np.ndarray, share: float) -> np.ndarray:
    """Which rows have another of their token that they can be alike; all of a token of more than BUCKET rows."""
    order = np.lexsort((size, token))
    token, pos, size = token[order], pos[order], size[order]
    starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
    n = np.diff(np.r_[starts, len(token)])
    keep = np.repeat(n > BUCKET, n)
    end = np.repeat(starts + n, n)
    at = np.flatnonzero(np.repeat((n > 1) & (n <= BUCKET), n))
    for k in range(1, BUCKET):
        at = at[at + k < end[at]]
        if not len(at):
            break
        fits = at[_fit(size[at], pos[at], size[at + k], pos[at + k], share)]
        keep[fits] = keep[fits + k] = True
    return order[keep]


def _met(nodes: DataFrame, share: float) -> DataFrame:
    """(token, node, size, pos, own): the prefix shingles, at ``pos``, that nodes (node, size, tokens) share with another
    that they can be alike by both sizes and by what is left of both sets.

    own: the share of a set that comes before all of these, small in a text that others are copies of. Tokens are dealt
    out by their value in ``parts``; a task sends each part one row of many tokens. Two shingles may share a token:
    what meets is compared anyway.
    """
    spark = nodes.sparkSession
    tasks = partitions(spark, (nodes.agg(F.sum(F.length("tokens"))).first()[0] or 0) // TOKEN * HELD)
    parts = min(4 * tasks, 1 << 20)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            raw = np.frombuffer(b"".join(t for _, _, t in rows), np.uint8).reshape(-1, TOKEN)
            token = np.zeros((len(raw), 8), np.uint8)
            token[:, :TOKEN] = raw
            token = token.view("<u8").ravel()
            n = np.array([len(t) // TOKEN for _, _, t in rows])
            node, size = (np.repeat(np.array([r[i] for r in rows], np.int64), n) for i in (0, 1))
            pos = np.arange(len(token)) - np.repeat(np.cumsum(n) - n, n)
            part = (token * np.uint64(parts) >> np.uint64(8 * TOKEN)).view(np.int64)
            order = np.argsort(part, kind="stable")
            token, node, pos, size, part = (x[order] for x in (token, node, pos, size, part))
            cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            data = [_written_small(*(x[a:b] for x in (token, node, pos, size))) for a, b in zip(cuts, [*cuts[1:], len(part)])]
            return pa.RecordBatch.from_arrays([pa.array(part[cuts]), pa.array(data, pa.binary())], names=["part", "data"])

        held, n = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("node", "size", "tokens"))):
                if row[2]:
                    held.append(row)
                    n += len(row[2]) // TOKEN
                if n >= DEALT:
                    yield out(held)
                    held, n = [], 0
        if held:
            yield out(held)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(part: int, rows: list[bytes]) -> pa.RecordBatch:
            token, node, pos, size = (np.concatenate(x) for x in zip(*map(_read_small, rows)))
            at = _in_company(token, node, pos, size, share)
            return pa.RecordBatch.from_arrays([pa.array(token[at].astype(np.int64) | part << 32), pa.array(node[at]), pa.array(size[at]), pa.array(pos[at])], names=["token", "node", "size", "pos"])

        now, held = None, []
        for batch in batches:
            for part, data in zip(batch.column("part").to_pylist(), batch.column("data").to_pylist()):
                if part != now and held:
                    yield out(now, held)
                    held = []
                now = part
                held.append(data)
        if held:
            yield out(now, held)

    dealt = nodes.select("node", "size", "tokens").mapInArrow(deal, "part long, data binary").repartition(tasks, "part").sortWithinPartitions("part")
    rows = written(dealt.mapInArrow(meet, "token long, node long, size int, pos int"))
    return rows.withColumn("own", F.min("pos").over(Window.partitionBy("node")) / F.col("size"))


def _ranked(rows: DataFrame, most: int) -> DataFrame:
    """``rows`` with ``lead``: whether a node leads, as one of the first ``most`` in every bucket that it is in."""
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("token").orderBy("own", "node")))
    return ranked.withColumn("lead", F.max("_rank").over(Window.partitionBy("node")) <= most).drop("_rank")


def _proposed(rows: DataFrame, share: float) -> DataFrame:
    """(node, leader, lead): the pairs of a leader and another node of a bucket that can be alike by their sizes and by
    what is left after the bucket's shingle; two leaders come once. No more than rows times leaders of a bucket."""
    led = rows.filter("lead").select("token", F.col("node").alias("leader"), F.col("size").alias("_size"), F.col("pos").alias("_pos"))
    need = F.ceil(share / (1 + share) * (F.col("size") + F.col("_size")) - 1e-9)
    fits = (F.least("size", "_size") >= share * F.greatest("size", "_size") - 1e-9) & (F.least(F.col("size") - F.col("pos"), F.col("_size") - F.col("_pos")) >= need)
    once = F.when(F.col("lead"), F.col("node") > F.col("leader")).otherwise(True)
    return rows.join(led, "token").filter(once & fits).select("node", "leader", "lead").distinct()


#: Nodes that are compared with a leader in one task.
SHARE = 4096


def _judged(pairs: DataFrame, data: DataFrame, read: Callable[[bytes], object], judge: Callable[[object, object], bool]) -> DataFrame:
    """Those of written pairs (node, leader, lead) that ``judge`` finds alike by what ``read`` makes of their ``data`` (node, data).

    A leader's data comes once to a task, before that of the nodes that are compared with it.
    """
    ways = F.floor(F.col("n") / SHARE) + 1  # a large group's members are dealt out to several copies of its leader's data
    total = pairs.count()
    sent = F.broadcast if total <= SMALL else lambda rows: rows  # few pairs go to where the data are
    counts = pairs.groupBy("leader").agg(F.count("*").alias("n"))
    way = F.pmod(F.xxhash64("node"), ways)
    ours = data.join(sent(lookup(pairs, counts, "leader", total).select("leader", way.alias("way"), "node", "lead")), "node").select("leader", "way", F.lit(1).alias("after"), "node", "lead", "data")
    copies = counts.select("leader", F.explode(F.sequence(F.lit(0).cast("long"), ways - 1)).alias("way"))
    theirs = data.withColumnRenamed("node", "leader").join(sent(copies), "leader").select("leader", "way", F.lit(0).alias("after"), F.col("leader").alias("node"), F.lit(True).alias("lead"), "data")
    dealt = theirs.unionByName(ours).repartition(partitions(pairs.sparkSession, total * 2048), "leader", "way").sortWithinPartitions("leader", "way", "after")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        theirs = None
        for batch in sliced(batches):
            keep = []
            for after, data in zip(batch.column("after").to_pylist(), batch.column("data").to_pylist()):
                if not after:
                    theirs = read(data)
                keep.append(bool(after) and judge(theirs, read(data)))
            yield batch.select(["node", "leader", "lead"]).filter(pa.array(keep, pa.bool_()))

    return dealt.mapInArrow(run, "node long, leader long, lead boolean")


def _alike(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, alike: Similar) -> DataFrame:
    """Those of written pairs (node, leader, lead) whose sets are alike: by their bits first, then by their texts."""
    words, share = alike.words, alike.share
    close = written(_judged(pairs, nodes.select("node", F.col("bits").alias("data")), _bits, lambda a, b: _can_be_alike(a, b, share)))
    wanted = close.select("node").unionByName(close.select(F.col("leader").alias("node"))).distinct()
    texts = written(_texts(docs, nodes.select("node", "least").join(wanted, "node", "left_semi")))
    return _judged(close, texts, lambda x: _set(_unpacked(x), words), lambda a, b: _are_alike(a, b, share)).distinct()


def _beaten(like: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node): of leaders alike (``like``: node, leader, lead), those that go: in order of how many each is like, then of
    their first documents, a leader stays if none before it that stays is like it."""
    pairs = like.filter("lead").select("node", "leader")
    both = written(pairs.unionByName(pairs.select(F.col("leader").alias("node"), F.col("node").alias("leader"))))
    if both.isEmpty():
        return both.select("node")
    degree = like.select("leader").unionByName(pairs.select(F.col("node").alias("leader"))).groupBy("leader").agg(F.count("*").alias("n")).withColumnRenamed("leader", "node")
    known = degree.join(both.select("node").distinct(), "node", "left_semi").join(nodes.select("node", "least"), "node")
    groups = components(both.select(F.col("node").alias("a"), F.col("leader").alias("b")))
    sorted_ = both.join(known.join(groups, "node"), "node").repartition("root").sortWithinPartitions("root", F.desc("n"), "least", "node").select("root", "node", "leader")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, gone = None, set()
        for batch in batches:
            found = []
            for root, node, other in zip(*(batch.column(c).to_pylist() for c in ("root", "node", "leader"))):
                if root != group:
                    group, gone = root, set()
                if node not in gone and other not in gone:
                    gone.add(other)
                    found.append(other)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["node"])

    return sorted_.mapInArrow(run, "node long")


def covered(docs: DataFrame, nodes: DataFrame, alike: Similar) -> DataFrame:
    """(node): the nodes (node, least, size, tokens, bits) that are left out for a node that stays, and is as alike as it takes.

    Rounds: of each bucket some nodes lead, and are compared with all that they meet. Of leaders alike, the one that is
    like most nodes stays (the first document's, if others are like as many); what is like one that stays goes, and the
    others go on. A bucket of few nodes is settled at once, one of many near copies by a few of them. Where leaders
    leave out little, the next round has more of them; rounds end when no two nodes meet.
    """
    out, most = [], alike.leaders
    rows = written(_met(nodes, alike.share))
    left = rows.count()
    while left:
        rows = written(_ranked(rows, most))
        like = written(_alike(docs, nodes, written(_proposed(rows, alike.share)), alike))
        beaten = written(_beaten(like, nodes))
        gone = like.filter("not lead").join(beaten.withColumnRenamed("node", "leader"), "leader", "left_anti").select("node").distinct()
        out += [beaten, written(gone)]
        rows = written(_shared(rows.filter("not lead").drop("lead").join(out[-1], "node", "left_anti")))
        was, left = left, rows.count()
        if left * 2 > was:
            most *= 4
    return reduce(DataFrame.unionByName, out) if out else nodes.select("node").limit(0)


def keep_one(docs: DataFrame, alike: Similar = Similar()) -> DataFrame:
    """``docs`` without the documents that are alike one that stays; all columns stay.

    Documents with the same set of shingles are copies, of which the smallest doc_id stays (null last). Of others, no
    two that stay are alike, and a document goes only if it is itself alike one that stays. Null and empty
    texts are copies of each other. Rows alike in doc_id and text are one document and come out once; very long texts
    are read in parts; an empty table gives an empty table.
    """
    marked = written(sketches(docs, alike))
    document = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "mark")
    nodes = marked.groupBy("node").agg(F.min(document).alias("least"), F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("size", "tokens", "bits")])
    nodes = written(nodes.withColumn("num", F.monotonically_increasing_id()))  # in order, unlike a hash: such lists pack small
    marked = marked.drop("size", "tokens", "bits")
    gone = covered(docs, nodes.drop("node").withColumnRenamed("num", "node"), alike).select(F.col("node").alias("num"), F.lit(True).alias("_gone"))
    fate = nodes.join(gone, "num", "left").select("node", "n", "least", F.coalesce("_gone", F.lit(False)).alias("gone"))
    own = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "mark")
    dropped = lookup(marked, fate, "node", marked.count()).filter(F.col("gone") | ~own.eqNullSafe(F.col("least"))).select("doc_id", "mark").distinct()
    out = among(docs, written(dropped), "left_anti")
    if not marked.groupBy("doc_id", "mark").count().filter("count > 1").isEmpty():
        out = out.withColumn("_own", F.xxhash64(text_or_empty())).dropDuplicates(["doc_id", "_own"]).drop("_own")
    return out


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
