"""Wedges looked up where their closing edges lie, so that a wedge never leaves its task.

The closing edges (src, dst) are cut into cells: ranges of src with near-equal numbers of edges.  The
neighbour list of a head goes once to each cell in which a wedge of it may close, from its first entry there on,
and wedges are made from it there, a bounded number at a time.  What is shuffled is lists, at most
cells x edges ids and no more than the wedges; where near ids are linked, little more than the edges.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wedgeworks.functions.columns import whole

#: Edges of a cell, wedges made at a time, and bits of an exact table or of dense rows, that a task holds.
CELL, BATCH, BITS = 1 << 22, 1 << 20, 1 << 29
#: Quantiles of src from which cells are cut; tasks for each core of the cluster.
GRID, PER_CORE = 4096, 2
#: Edges for which a further task pays.
LEAST = 1 << 15
#: Bytes that a step from id to id may take.
WIDTHS = {1: "<u1", 2: "<u2", 8: "<i8"}
#: No id is greater.
TOP = (1 << 63) - 1
#: Bits looked at in the time that a wedge takes; wedges with an equal head and src are then counted in words.
WORTH = 512


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The ranges starts[i], .., starts[i] + counts[i] - 1, one after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + counts, counts)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a column of lists."""
    at = column.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]].astype(np.int64), at - at[0]


def _packed(ids: np.ndarray, off: np.ndarray) -> tuple[pa.Array, pa.Array, pa.Array]:
    """First id, bytes of a step, and steps from id to id, of sorted lists, none empty: one, two or eight bytes each."""
    steps = np.diff(ids, prepend=0)
    steps[off[:-1]] = 0
    most = np.maximum.reduceat(steps.view(np.uint64), off[:-1])
    of = np.where(most < 1 << 8, 1, np.where(most < 1 << 16, 2, 8))
    width = np.repeat(of, np.diff(off))
    ends = np.concatenate([[0], np.cumsum(width)])
    data = np.zeros(ends[-1], np.uint8)
    for w, kind in WIDTHS.items():
        pick = width == w
        if pick.any():
            data[_spread(ends[:-1][pick], width[pick])] = steps[pick].astype(kind).view(np.uint8)
    packed = pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer(ends[off].astype(np.int32)), pa.py_buffer(data)])
    return pa.array(ids[off[:-1]]), pa.array(of.astype(np.int32)), packed


def _unpacked(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of the lists that ``_packed`` made."""
    first, of, packed = (part.column(c) for c in ("first", "width", "steps"))
    first, of = first.to_numpy(zero_copy_only=False), of.to_numpy(zero_copy_only=False)
    at = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1].astype(np.int64)
    data, at = np.frombuffer(packed.buffers()[2], np.uint8)[at[0] : at[-1]], at - at[0]
    counts = np.diff(at) // of
    off = np.concatenate([[0], np.cumsum(counts)])
    steps, width = np.zeros(off[-1], np.int64), np.repeat(of, counts)
    for w, kind in WIDTHS.items():
        rows = of == w
        if rows.any():
            steps[width == w] = data[_spread(at[:-1][rows], np.diff(at)[rows])].view(kind)
    steps = np.cumsum(steps)
    return steps - np.repeat(steps[off[:-1]] - first, counts), off


def shape(edges: DataFrame, cell: int = CELL) -> tuple[list[int], int, int, int]:
    """(first src of each cell but the first, most neighbours dst > src of a vertex, edges, greatest src), in one pass."""
    return shape_by_degree(edges.groupBy("src").agg(F.count("*").alias("d")), cell)


def shape_by_degree(per: DataFrame, cell: int = CELL) -> tuple[list[int], int, int, int]:
    """``shape`` from the number of neighbours dst > src of each vertex: (src, d)."""
    weighed = per.select("src", "d", F.explode(F.sequence(F.lit(0).cast("long"), whole(F.col("d"), 64))).alias("_k"))
    grid = F.percentile_approx("src", [i / GRID for i in range(1, GRID)], 4 * GRID)
    most, total, cuts, top = weighed.agg(F.max("d"), F.sum(F.when(F.col("_k") == 0, F.col("d"))), grid, F.max("src")).first()
    total = total or 0
    tasks = min(PER_CORE * per.sparkSession.sparkContext.defaultParallelism, total // LEAST + 1)
    n = min(GRID, max(-(-total // cell), tasks))
    return sorted({cuts[i * GRID // n - 1] for i in range(1, n)}), most or 0, total, top or 0


def _deal(cuts: list[int], kinds: tuple[bool, bool], top: int = TOP):
    """Rows (u, out) to rows (cell, kind, key, first, width, steps): closing lists (kind 0) to the cell of u, and lists of
    heads (kind 1), key being how many of the ids, the first ones, are lesser ends in that cell.  Nothing closes wedges
    whose lesser end is beyond ``top``, the greatest src, so they aren't dealt."""
    bounds = np.array(cuts, np.int64)

    def rows(cell, kind, key, ids, starts, counts):
        done, i = np.concatenate([[0], np.cumsum(counts)]), 0
        while i < len(cell):
            j = max(i + 1, int(np.searchsorted(done, done[i] + BATCH, "right")) - 1)
            first, width, steps = _packed(ids[_spread(starts[i:j], counts[i:j])], done[i : j + 1] - done[i])
            columns = [pa.array(cell[i:j].astype(np.int32)), pa.array(np.full(j - i, kind, np.int32)), pa.array(key[i:j].astype(np.int64)), first, width, steps]
            yield pa.RecordBatch.from_arrays(columns, ["cell", "kind", "key", "first", "width", "steps"])
            i = j

    def run(parts):
        for batch in parts:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                u = part.column("u").to_numpy(zero_copy_only=False).astype(np.int64)
                ids, off = _flat(part.column("out"))
                counts = np.diff(off)
                if kinds[0]:
                    yield from rows(np.searchsorted(bounds, u, "right"), 0, u, ids, off[:-1], counts)
                if kinds[1] and len(ids):
                    cell, row = np.searchsorted(bounds, ids, "right"), np.repeat(np.arange(len(u)), counts)
                    new = np.ones(len(ids), bool)
                    new[1:] = (cell[1:] != cell[:-1]) | (row[1:] != row[:-1])
                    starts = np.flatnonzero(new)
                    end = off[row[starts] + 1]
                    lesser = np.minimum(np.append(starts[1:], len(ids)), end - 1) - starts
                    if top < TOP:
                        done = np.concatenate([[0], np.cumsum(ids <= top)])
                        lesser = np.minimum(lesser, done[np.append(starts[1:], len(ids))] - done[starts])
                    ok = lesser > 0
                    starts, end, lesser = starts[ok], end[ok], lesser[ok]
                    yield from rows(cell[starts], 1, lesser, ids, starts, end - starts)

    return run


def _hash(x: np.ndarray, y: np.ndarray, bits: int, seed: int = 0) -> np.ndarray:
    """Top ``bits`` bits of a hash of two ids."""
    mixed = (x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 0xD1342543DE82EF95 & (1 << 64) - 1)) ^ (y.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0x94D049BB133111EB)
    return mixed >> np.uint64(64 - bits)


def _set(table: np.ndarray, at: np.ndarray) -> None:
    """Sets the bits ``at``, all different and still unset."""
    np.add.at(table, at >> at.dtype.type(3), np.uint8(1) << (at & at.dtype.type(7)).astype(np.uint8))


def _test(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    one = at.dtype.type
    return (table[at >> one(3)] >> (at & one(7)).astype(np.uint8)) & np.uint8(1) != 0


class Closing:
    """The edges of a cell: vertices ``src`` with their sorted neighbours ``dst`` beyond them."""

    def __init__(self, src: np.ndarray, counts: np.ndarray, dst: np.ndarray):
        order = np.argsort(src, kind="stable")
        starts = np.cumsum(counts) - counts
        self.dst = dst[_spread(starts[order], counts[order])].astype(np.int64)
        self.src, self.counts = src[order].astype(np.int64), counts[order]
        self.starts = np.cumsum(self.counts) - self.counts
        self.last = self.dst[self.starts + self.counts - 1] if len(src) else self.src
        self.table = None

    def row(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each id among src, and whether it is there."""
        if not len(self.src):
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        at = np.minimum(np.searchsorted(self.src, x), len(self.src) - 1)
        return at, self.src[at] == x

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(self.src)), self.counts), self.dst

    def find(self, row: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Place of each edge (src[row], y) among dst, or -1: a binary search in each row at once."""
        low, high = self.starts[row], self.starts[row] + self.counts[row]
        end = high
        while len(low) and (high > low).any():
            mid = (low + high) >> 1
            less = (high > low) & (self.dst[np.minimum(mid, len(self.dst) - 1)] < y)
            low, high = np.where(less, mid + 1, low), np.where(less, high, mid)
        hit = low < end
        hit[hit] = self.dst[low[hit]] == y[hit]
        return np.where(hit, low, -1)

    def hold(self, method: str, probes: tuple[int, int]) -> None:
        """Builds the table that ``closed`` looks into."""
        row, y = self.edges()
        span = self.last - self.src
        self.bases = np.cumsum(span) - span
        if method == "bloom":
            self.bits, self.probes = max(6, math.ceil(math.log2(probes[0]))), probes[1]
            table = np.zeros(1 << self.bits, bool)
            for k in range(self.probes):
                table[_hash(self.src[row], y, self.bits, k)] = True
            self.table = np.packbits(table, bitorder="little")
        elif method == "any" and (self.last.astype(float) - self.src).sum() <= BITS:  # as float: spans of 64-bit ids overflow
            self.bits = 0
            self.table = np.zeros((int(span.sum()) >> 3) + 1, np.uint8)
            _set(self.table, self.bases[row] + y - self.src[row] - 1)
        else:
            self.bits = max(6, min(29, math.ceil(math.log2(len(y) + 1)) + 5))
            self.table = np.zeros(1 << self.bits - 3, np.uint8)
            _set(self.table, np.unique(_hash(self.src[row], y, self.bits)))

    def closed(self, row: np.ndarray, y: np.ndarray, method: str) -> np.ndarray:
        """Positions of the wedges (src[row], y) with an edge; method bloom: and of the few that its filter lets pass."""
        if not self.bits:
            pick = np.flatnonzero(y <= self.last[row])
            r = row[pick]
            return pick[_test(self.table, self.bases[r] + y[pick] - self.src[r] - 1)]
        x = self.src[row]
        pick = np.flatnonzero(_test(self.table, _hash(x, y, self.bits)))
        if method != "bloom":
            return pick[self.find(row[pick], y[pick]) >= 0]
        for k in range(1, self.probes):
            pick = pick[_test(self.table, _hash(x[pick], y[pick], self.bits, k))]
        return pick


def _wedges(closing: Closing, part: pa.RecordBatch, prune: bool):
    """(row, y) of the wedges of a batch's heads whose lesser end has edges in the cell, a bounded number at a time."""
    lesser = part.column("key").to_numpy(zero_copy_only=False)
    ids, off = _unpacked(part)
    at = _spread(off[:-1], lesser)
    row, there = closing.row(ids[at])
    at, row, end = at[there], row[there], np.repeat(off[1:], lesser)[there]
    done = np.concatenate([[0], np.cumsum(end - at - 1)])
    i = 0
    while i < len(at):
        j = max(i + 1, int(np.searchsorted(done, done[i] + BATCH, "right")) - 1)
        for first in range(0, int(done[j] - done[i]) if j == i + 1 else 1, BATCH):
            start, count = at[i:j] + 1 + first, end[i:j] - at[i:j] - 1 - first
            count = np.minimum(count, BATCH) if j == i + 1 else count
            y, r = ids[_spread(start, count)], np.repeat(row[i:j], count)
            if prune:
                keep = y <= closing.last[r]
                y, r = y[keep], r[keep]
            yield r, y
        i = j


def _dense(closing: Closing, parts):
    """Number of closed wedges by whole rows of bits: for dense cells."""
    columns = np.unique(closing.dst)
    words = -(-len(columns) // 64)
    table = np.zeros((len(closing.src), words * 8), np.uint8)
    row, y = closing.edges()
    c = np.searchsorted(columns, y)
    _set(table.reshape(-1), row * (words * 64) + c)
    table, total = table.view(np.uint64), 0
    for part in parts:
        ids, off = _unpacked(part)
        for n, a, b in zip(part.column("key").to_pylist(), off[:-1].tolist(), off[1:].tolist(), strict=True):
            mine = np.zeros(words * 64, bool)
            c = np.minimum(np.searchsorted(columns, ids[a:b]), len(columns) - 1)
            c = c[columns[c] == ids[a:b]]
            mine[c] = True
            r, there = closing.row(ids[a : a + n])
            r, mine = r[there], np.packbits(mine, bitorder="little").view(np.uint64)
            step = max(1, BATCH // words)
            for k in range(0, len(r), step):  # ids greater than src alone are in its row
                total += int(np.bitwise_count(table[r[k : k + step]] & mine).sum(dtype=np.int64))
    return total


def _look_up(method: str, prune: bool, group: bool, listed: bool, shape_of: Callable[[int], tuple[int, int]]):
    def task(closing: Closing, heads):
        """Counts, or the edges of the cell that close a wedge."""
        if method == "array" and len(closing.src):
            columns = len(np.unique(closing.dst))
            if len(closing.src) * columns <= BITS and columns * len(closing.src) <= WORTH * len(closing.dst):
                return _dense(closing, heads)
        way = {"array": "any", "verified": "bloom"}.get(method, method)
        closing.hold(way, shape_of(max(1, len(closing.dst))))
        total, hit = 0, np.zeros(len(closing.dst) if listed else 0, bool)
        for part in heads:
            for row, y in _wedges(closing, part, prune):
                times = None
                if group:  # equal ends are checked once
                    low, width = (int(y.min()), int(y.max()) - int(y.min()) + 1) if len(y) else (0, 1)
                    if len(closing.src) * width < 1 << 62:
                        keys, times = np.unique(row * width + (y - low), return_counts=True)
                        row, y = keys // width, keys % width + low
                found = closing.closed(row, y, way)
                if method == "verified":
                    found = found[closing.find(row[found], y[found]) >= 0]
                if listed:
                    hit[closing.find(row[found], y[found])] = True
                total += int(times[found].sum()) if times is not None else len(found)
        return hit if listed else total

    def run(parts):
        src, counts, dst = [], [], []
        closing = None

        def heads():
            """Batches of heads; those of closing lists, which come first, are kept."""
            for part in parts:
                kind = part.column("kind").to_numpy(zero_copy_only=False)
                n = int(np.searchsorted(kind, 1))
                if n:
                    ids, off = _unpacked(part.slice(0, n))
                    src.append(part.column("key").slice(0, n).to_numpy(zero_copy_only=False).copy())
                    counts.append(np.diff(off))
                    dst.append(ids)
                if n < part.num_rows:
                    for at in range(n, part.num_rows, 256):
                        yield part.slice(at, min(256, part.num_rows - at))

        rest = heads()
        first = next(rest, None)
        if first is None:
            return
        closing = Closing(*(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (src, counts, dst)))

        def every():
            yield first
            yield from rest

        got = task(closing, every())
        if listed:
            at = np.flatnonzero(got)
            row = np.searchsorted(closing.starts, at, "right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(closing.src[row]), pa.array(closing.dst[at])], ["src", "dst"])
        else:
            yield pa.RecordBatch.from_arrays([pa.array([got], pa.int64())], ["n"])

    return run


#: What ``_deal`` makes.
DEALT = "cell int, kind int, key long, first long, width int, steps binary"


def _united(bits: int):
    """Lists dealt to a cell to rows (u, out): for each lesser end there, the greater ids of all lists that hold it."""

    def run(parts):
        kept = [(part.column("key").to_numpy(zero_copy_only=False).copy(), *_unpacked(part)) for part in parts]
        if not kept:
            return
        columns = np.unique(np.concatenate([np.unique(ids) for _, ids, _ in kept]))
        rows = np.unique(np.concatenate([ids[_spread(off[:-1], key)] for key, ids, off in kept]))
        words = -(-len(columns) // 64)
        step = max(1, bits // (64 * words))
        for at in range(0, len(rows), step):  # rows of bits, a bounded number at a time
            some = rows[at : at + step]
            table = np.zeros((len(some), words), np.uint64)
            for key, ids, off in kept:
                for n, a, b in zip(key.tolist(), off[:-1].tolist(), off[1:].tolist(), strict=True):
                    r = ids[a : a + n]
                    r = np.searchsorted(some, r[(r >= some[0]) & (r <= some[-1])])
                    if len(r):
                        mine = np.zeros(words * 64, bool)
                        mine[np.searchsorted(columns, ids[a:b])] = True
                        table[r] |= np.packbits(mine, bitorder="little").view(np.uint64)
            own = np.searchsorted(columns, some)
            few = max(1, BATCH // (64 * words))
            for i in range(0, len(some), few):
                found = np.unpackbits(table[i : i + few].view(np.uint8), axis=1, bitorder="little").view(bool)
                found &= np.arange(words * 64) > own[i : i + few, None]
                at_row, at_column = np.nonzero(found)
                off = np.searchsorted(at_row, np.arange(len(found) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(some[i : i + few]), pa.ListArray.from_arrays(pa.array(off), pa.array(columns[at_column]))], ["u", "out"])

    return run


def united(lists: DataFrame, cuts: list[int], bits: int = BITS) -> DataFrame:
    """(u, out): the greater ids that share a list (out: sorted, distinct) with u, sorted; none for the greatest of all.

    Each list goes once to each cell in which it has a lesser end, so pairs are never shuffled; they meet as rows of bits.
    """
    dealt = lists.select(F.lit(0).cast("long").alias("u"), "out").mapInArrow(_deal(cuts, (False, True)), DEALT)
    return dealt.repartitionById(len(cuts) + 1, F.col("cell")).mapInArrow(_united(bits), "u long, out array<long>")


def look_up(heads: DataFrame | None, closing: DataFrame, cuts: list[int], method: str = "any", prune: bool = False, group: bool = False, listed: bool = False, shape_of=lambda n: (64 * n, 1), top: int = TOP) -> DataFrame:
    """Wedges x < y of the lists ``heads`` (u, out), sorted by id, that an edge of ``closing`` (u, out) closes.

    Returns their number in each cell as (n), or with ``listed`` the closing edges (src, dst).  ``heads`` None: those of
    ``closing``.  Methods: any (an exact table of bits over each vertex's range of neighbours, or hash if that is large),
    hash (a table of hashes, then the edges), bloom (a filter of ``shape_of`` (edges) bits and probes: some wedges too
    many), verified (that filter, then the edges), array (rows of bits where the cell is dense, else any).
    ``prune``: wedges beyond the lesser end's greatest neighbour go first.  ``group``: equal ends of a batch are checked once.
    ``top``: the greatest u of ``closing``, if known.
    """
    if heads is None:
        dealt = closing.mapInArrow(_deal(cuts, (True, True), top), DEALT)
    else:
        dealt = closing.mapInArrow(_deal(cuts, (True, False)), DEALT).unionByName(heads.mapInArrow(_deal(cuts, (False, True), top), DEALT))
    placed = dealt.repartitionById(len(cuts) + 1, F.col("cell")).sortWithinPartitions("kind")
    return placed.mapInArrow(_look_up(method, prune, group, listed, shape_of), "src long, dst long" if listed else "n long")
