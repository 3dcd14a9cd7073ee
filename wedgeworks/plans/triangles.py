"""Triangle counting: exact plans that differ in joins only, and an approximate one."""

from __future__ import annotations

import math
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wedgeworks.operators.edges import oriented, settled
from wedgeworks.plans.cells import look_up, shape, shape_by_degree

#: Largest edge table, in bytes of its ids, that the broadcast plan sends to every executor, and the share of the
#: driver's memory that these bytes may be: the table that it builds takes some five times as much.
BROADCAST_BYTES, BROADCAST_SHARE = 256 << 20, 32
#: Share of absent keys that the approximate filter may admit.
TOLERANCE = 1e-9


def _count(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("triangles"))


def adjacency(edges: DataFrame, orient: str) -> DataFrame:
    """(u, out): sorted out-neighbours of each vertex under the orientation."""
    return oriented(edges, orient).groupBy("u").agg(F.sort_array(F.collect_list("v")).alias("out"))


def common_neighbours(edges: DataFrame, orient: str = "auto") -> DataFrame:
    """(u, v, common): for each oriented edge, the out-neighbours that both ends share.

    Each triangle is in exactly one row.  Under the orientations auto and degree an array has at most
    sqrt(2 |E|) ids.  Wedges never become rows.
    """
    orient = settled(edges, orient)
    lists = adjacency(edges, orient)
    sent = lists.where(F.size("out") > 1)
    if orient == "id":  # ids grow along paths: only those after v can be common
        later = F.slice(F.col("out"), F.col("_i") + 2, F.size("out"))
        sent = sent.select("u", "out", F.posexplode("out").alias("_i", "v")).where(F.col("_i") < F.size("out") - 1).select("u", "v", later.alias("out"))
    else:
        sent = sent.select("u", F.explode("out").alias("v"), "out")
    other = lists.select(F.col("u").alias("v"), F.col("out").alias("_other"))
    return sent.join(other, "v").select("u", "v", F.array_intersect("out", "_other").alias("common"))


def _looked_up(edges: DataFrame, orient: str, listed: bool = False, **how) -> DataFrame:
    """Wedges of each vertex's out-neighbours, looked up in the cells of their closing edges."""
    cuts, most, total, top = shape(edges)
    heads = None if _by(orient, most, total) == "id" else adjacency(edges, "degree")
    return look_up(heads, adjacency(edges, "id"), cuts, listed=listed, top=top, **how)


def _by(orient: str, most: int, total: int) -> str:
    """As ``settled`` does, from what is known already."""
    return orient if orient != "auto" else "id" if most**2 <= 2 * total else "degree"


def summed(counts: DataFrame) -> DataFrame:
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("triangles"))


def count_by_arrays(edges: DataFrame, orient: str = "auto") -> DataFrame:
    """Lists of both ends of an edge are intersected: by rows of bits in a dense cell, else each id is looked up."""
    return summed(_looked_up(edges, orient, method="array"))


def count_by_lists(lists: DataFrame, orient: str = "auto") -> DataFrame:
    """``count_by_arrays`` of a graph that is given as lists (u, out) of greater neighbours, sorted by id: where vertices
    are ordered by id, its edges never become rows."""
    lists = lists.where(F.size("out") > 0)
    cuts, most, total, top = shape_by_degree(lists.select(F.col("u").alias("src"), F.size("out").cast("long").alias("d")))
    heads = None if _by(orient, most, total) == "id" else adjacency(lists.select(F.col("u").alias("src"), F.explode("out").alias("dst")), "degree")
    return summed(look_up(heads, lists, cuts, method="array", top=top))


def count_by_arcs(arcs: DataFrame) -> DataFrame:
    """Distinct arcs (src, dst) from x to y, x to z and y to z, y < z, whether or not arcs rise: the triangles, where all do."""
    if arcs.where("src >= dst").isEmpty():
        return count_by_arrays(arcs)
    closing = arcs.where("src < dst")
    cuts, _, _, top = shape(closing)
    return summed(look_up(adjacency(arcs, "id"), adjacency(closing, "id"), cuts, method="array", top=top))


def triangles(edges: DataFrame, orient: str = "auto") -> DataFrame:
    """Every triangle once, as a < b < c."""
    rows = common_neighbours(edges, orient).select("u", "v", F.explode("common").alias("w"))
    return rows.select(F.array_sort(F.array("u", "v", "w")).alias("_t")).select(*(F.col("_t")[i].alias(c) for i, c in enumerate("abc")))


def _ordered_wedges(edges: DataFrame, orient: str) -> DataFrame:
    """Two out-neighbours src < dst of each head, which has at most sqrt(2 |E|) of them but by id, hubs included."""
    e = oriented(edges, settled(edges, orient))
    b = e.select(F.col("u").alias("h"), F.col("v").alias("y"))
    return e.select(F.col("u").alias("h"), F.col("v").alias("x")).join(b, "h").where("x < y").select("h", F.col("x").alias("src"), F.col("y").alias("dst"))


def count_by_joins(edges: DataFrame, orient: str = "auto", hint: str | None = None) -> DataFrame:
    """Wedges joined with the edges that close them, in cells of these edges; with a ``hint``, by that
    physical join, which shuffles the wedges unless it is a broadcast."""
    if not hint:
        return summed(_looked_up(edges, orient))
    closing = edges.select("src", "dst")
    return _count(_ordered_wedges(edges, orient).join(closing.hint(hint), ["src", "dst"], "left_semi"))


def count_by_hash(edges: DataFrame, orient: str = "auto") -> DataFrame:
    return summed(_looked_up(edges, orient, method="hash"))


def count_by_broadcast(edges: DataFrame, orient: str = "auto", limit: int | None = None) -> DataFrame:
    """The closing edges go to every executor if their ids fit ``limit`` bytes, else the hash plan runs."""
    if limit is None:
        limit = min(BROADCAST_BYTES, edges.sparkSession._jvm.Runtime.getRuntime().maxMemory() // BROADCAST_SHARE)
    return count_by_joins(edges, orient, "broadcast") if edges.count() * 16 <= limit else count_by_hash(edges, orient)


def count_by_multiplicity(edges: DataFrame, orient: str = "auto") -> DataFrame:
    """Equal wedge ends of a batch are counted first, then checked once."""
    return summed(_looked_up(edges, orient, group=True))


def count_pruned(edges: DataFrame) -> DataFrame:
    """Ordered wedges whose greater end lies within the lesser one's neighbours, then checked."""
    return summed(_looked_up(edges, "id", method="hash", prune=True))


def count_raw(symmetric: DataFrame) -> DataFrame:
    """Unordered heads: every triangle is found three times, and the total divided by three."""
    edges = symmetric.where("head < tail").select(F.col("head").alias("src"), F.col("tail").alias("dst"))
    heads = symmetric.groupBy(F.col("head").alias("u")).agg(F.sort_array(F.collect_list("tail")).alias("out"))
    cuts, _, _, top = shape(edges)
    return look_up(heads, adjacency(edges, "id"), cuts, top=top).agg(F.expr("coalesce(sum(n), 0L) div 3").alias("triangles"))


def closing_edges(edges: DataFrame) -> DataFrame:
    """Edges that close at least one wedge whose head is less than both ends."""
    return _looked_up(edges, "id", listed=True)


def bloom_shape(n: int, tolerance: float = TOLERANCE) -> tuple[int, int]:
    """(bits, probes) of a Bloom filter of n keys, n rounded up to a power of two, that admits a share
    ``tolerance`` of absent keys."""
    if not 0 < tolerance < 1:
        raise ValueError("a tolerance lies between 0 and 1")
    room = 1 << max(0, math.ceil(math.log2(max(n, 1))))
    bits = math.ceil(room * -math.log(tolerance) / math.log(2) ** 2)
    return bits, max(1, round(bits / room * math.log(2)))


def count_by_bloom(edges: DataFrame, orient: str = "auto", tolerance: float = TOLERANCE) -> DataFrame:
    """APPROXIMATE: wedges that a Bloom filter of each cell's edges admits, never fewer than the triangles."""
    return summed(_looked_up(edges, orient, method="bloom", shape_of=partial(bloom_shape, tolerance=tolerance)))


def count_by_bloom_verified(edges: DataFrame, orient: str = "auto", tolerance: float = TOLERANCE) -> DataFrame:
    """Exact: wedges that the Bloom filter admits, looked up among the edges."""
    return summed(_looked_up(edges, orient, method="verified", shape_of=partial(bloom_shape, tolerance=tolerance)))


STRATEGIES = {
    "array": count_by_arrays,
    "join": count_by_joins,
    "hash": count_by_hash,
    "broadcast": count_by_broadcast,
    "multiplicity": count_by_multiplicity,
    "pruned": count_pruned,
    "bloom": count_by_bloom,
    "bloom_verified": count_by_bloom_verified,
}


def triangle_count(edges: DataFrame, strategy: str = "array") -> DataFrame:
    """One row with the number of triangles of a canonical edge table."""
    return STRATEGIES[strategy](edges)
