"""Triangles among members that share groups, counted from the groups: the graph's edges are never rows or lists.

Members of exactly the same groups have the same neighbours and are linked to each other, so they become one vertex
that counts as often.  Vertices are dealt to blocks.  The task of a block gets the groups of its own and of all later
vertices, makes rows of bits from them, its own once and each later block's in turn, and counts by matrix products.
What is shuffled is memberships, each once for its block and every earlier one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wedgeworks.plans.cells import BITS, WORTH, _flat, _spread

#: Vertices of a block at most, and for which a further block pays; words of a row in one product; tasks for each core.
ROWS, LEAST, WORDS, PER_CORE = 1 << 11, 1 << 8, 1 << 5, 4


def _bits(table: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(table).view(np.uint8), axis=1, bitorder="little").view(bool)


class Linked:
    """Vertices 0, 1, .. with their groups, as rows of bits: whom each is linked to among the later ones."""

    def __init__(self, vertex: np.ndarray, group: np.ndarray, n: int, bits: int):
        self.n, self.words = n, -(-n // 64)
        order = np.lexsort((vertex, group))
        self.vertex, group = vertex[order], group[order]
        starts = np.flatnonzero(np.diff(group, prepend=-1)) if len(group) else np.zeros(0, np.int64)
        self.bounds = list(zip(starts.tolist(), np.append(starts[1:], len(group)).tolist(), strict=True))
        self.held = [self._row(*x) for x in self.bounds] if len(self.bounds) * self.words * 64 <= bits else None

    def _row(self, a: int, b: int) -> np.ndarray:
        row = np.zeros(self.words * 64, bool)
        row[self.vertex[a:b]] = True
        return np.packbits(row, bitorder="little").view(np.uint64)

    def rows(self, low: int, high: int) -> np.ndarray:
        """Of the vertices low, .., high - 1, from the word of ``low`` on."""
        skip, end = low // 64, -(-high // 64)
        table = np.zeros((high - low, self.words - skip), np.uint64)
        for k, (a, b) in enumerate(self.bounds):
            i, j = np.searchsorted(self.vertex[a:b], (low, high)) + a
            if i < j:
                table[self.vertex[i:j] - low] |= (self.held[k] if self.held else self._row(a, b))[skip:]
        later = _bits(table[:, : end - skip])
        later &= np.arange(skip * 64, end * 64) > np.arange(low, high)[:, None]
        table[:, : end - skip] = np.packbits(later, axis=1, bitorder="little").view(np.uint64)
        return table


def _tally(linked: Linked, times: np.ndarray, ends: list[int]) -> int:
    """Triangles whose first vertex is in the first block; blocks end at ``ends``, vertex v counts ``times[v]`` times."""
    kind = np.float32 if times.sum() < 1 << 24 else np.float64  # whole numbers up to the sum are exact
    weight = np.zeros(linked.words * 64, kind)
    weight[: linked.n] = times
    twice = times * (times - 1) // 2
    here = slice(0, ends[0])
    exact = lambda a, b: int((a.astype(object) * b.astype(object)).sum())
    total = exact(twice[here], times[here] - 2) // 3
    first = linked.rows(0, ends[0])
    for low, high in zip([0, *ends], ends):
        skip = low // 64
        near = _bits(first[:, skip : -(-high // 64)])[:, low - skip * 64 : high - skip * 64]
        if not near.any():
            continue
        total += exact(twice[here], near @ times[low:high]) + exact(times[here], near @ twice[low:high])
        second = first if low == 0 else linked.rows(low, high)
        common = np.zeros((ends[0], high - low), kind)
        for at in range(skip, linked.words, WORDS):
            third = slice(at, at + WORDS)
            common += (_bits(first[:, third]) * weight[at * 64 : (at + WORDS) * 64]) @ _bits(second[:, at - skip : at - skip + WORDS]).astype(kind).T
        common[~near] = 0
        for i in range(0, ends[0], LEAST):
            part = slice(i, i + LEAST)
            total += exact(times[here][part], common[part].astype(np.int64) @ times[low:high])
    return total


def _count(bits: int):
    def run(parts):
        kept = [(*(part.column(c).to_numpy(zero_copy_only=False).copy() for c in ("block", "u", "n")), *_flat(part.column("held"))) for part in parts]
        kept = [x for x in kept if len(x[0])]
        if not kept:
            return
        block, u, times, held = (np.concatenate([x[k] for x in kept]) for k in range(4))
        counts = np.concatenate([np.diff(x[4]) for x in kept])
        order = np.lexsort((u, block))
        group = np.unique(held, return_inverse=True)[1][_spread((np.cumsum(counts) - counts)[order], counts[order])]
        linked = Linked(np.repeat(np.arange(len(u)), counts[order]), group, len(u), bits)
        ends = np.append(np.flatnonzero(np.diff(block[order])) + 1, len(u)).tolist()
        yield pa.RecordBatch.from_arrays([pa.array([_tally(linked, times[order].astype(np.int64), ends)], pa.int64())], ["n"])

    return run


def named(rows: DataFrame, group: list[str]):
    """A hash of the group, as short as tells all groups of the table apart; None if none does."""
    names = rows.select(*group).distinct()
    tried = [F.hash(*group).cast("long"), F.xxhash64(*group)]
    found = names.agg(F.count("*"), *(F.countDistinct(h) for h in tried)).first()
    return next((h for h, different in zip((F.hash(*group), F.xxhash64(*group)), found[1:], strict=True) if different == found[0]), None)


def alike(held: DataFrame) -> DataFrame:
    """(u, n, held): the least and the number of the members ``_m`` whose groups ``_g`` are exactly ``held``."""
    sets = held.groupBy("_m").agg(F.sort_array(F.collect_list("_g")).alias("held"))
    return sets.groupBy("held").agg(F.min("_m").alias("u"), F.count("*").alias("n")).select("u", "n", "held")


def count_by_groups(rows: DataFrame, group: list[str], member: str, most: int = ROWS, bits: int = BITS) -> DataFrame | None:
    """(n) by block: triangles of members, two being linked if they share a group.  None where the graph is so sparse
    that its pairs are fewer than what this plan sends, or its rows of bits nearly empty.

    Groups are of strings, whole numbers or times; members are integral.
    """
    rows = rows.select(*group, F.col(member).cast("long").alias("_m")).dropna()
    name = named(rows, group)
    if name is None:
        return None
    held = rows.select(name.alias("_g"), "_m").distinct()
    vertices = alike(held)
    k = F.col("count")
    pairs = held.groupBy("_g").count().agg(F.sum(k * (k - 1) / 2)).first()[0] or 0
    n, ids = vertices.agg(F.count("*"), F.sum(F.size("held"))).first()
    most = max(1, min(most, bits // max(n, 1)))
    blocks = max(-(-n // most), min(PER_CORE * rows.sparkSession.sparkContext.defaultParallelism, n // LEAST + 1))
    if n**2 > WORTH * max(pairs, n) or blocks * (ids or 0) > max(pairs, ids or 0):
        return None
    block = F.pmod(F.xxhash64("u"), F.lit(blocks)).cast("int")
    sent = vertices.withColumn("block", block).select("block", "u", "n", "held", F.explode(F.sequence(F.lit(0), "block")).alias("_to"))
    return sent.repartitionById(blocks, F.col("_to")).drop("_to").mapInArrow(_count(bits), "n long")
