"""Owners of vertices, balanced cuts, and reports on the borders between parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wedgeworks.functions.columns import owner, whole


def with_owners(symmetric: DataFrame, nv: int, parts: int) -> DataFrame:
    return symmetric.select("head", "tail", owner(F.col("head"), nv, parts).alias("head_owner"), owner(F.col("tail"), nv, parts).alias("tail_owner"))


def owner_by_cuts(vertex: Column, cuts: list[int]) -> Column:
    """Part of a vertex under explicit cuts (part p starts at cuts[p]; the last of equal cuts holds the ids).

    A tree of comparisons: a row takes as many as the logarithm of the number of parts.
    """

    def pick(low: int, high: int) -> Column:
        if high - low == 1:
            return F.lit(low).cast("long")
        middle = (low + high) // 2
        return F.when(vertex < F.lit(cuts[middle]), pick(low, middle)).otherwise(pick(middle, high))

    return pick(0, len(cuts))


def first_id(part: Column, nv: int, parts: int) -> Column:
    """First id of a part in closed form."""
    return whole(part * F.lit(nv), parts).cast("long")


def local_id(vertex: Column, part: Column, nv: int, parts: int) -> Column:
    """Number of a vertex within a part."""
    return vertex - first_id(part, nv, parts)


def global_id(local: Column, part: Column, nv: int, parts: int) -> Column:
    """The vertex with a number within a part."""
    return local + first_id(part, nv, parts)


def local_ids(ids: DataFrame, nv: int, parts: int) -> DataFrame:
    """(id, owner, local): each vertex's part and its number there."""
    owned = ids.select("id", owner(F.col("id"), nv, parts).alias("owner"))
    return owned.withColumn("local", local_id(F.col("id"), F.col("owner"), nv, parts))


def balanced_cuts(offsets: DataFrame, total: int, nv: int, parts: int) -> list[int]:
    """First ids of the parts, each taking ids until it has total div parts entries.

    ``offsets`` is (id, offset).  Each cut depends on the one before: parts - 1 lookups of one row each.
    """
    capacity, cuts, at = total // parts, [0], 0
    for p in range(1, parts):
        least = cuts[-1] if p == 1 else cuts[-1] + 1
        row = offsets.where((F.col("id") >= least) & (F.col("offset") >= at + capacity)).agg(F.min(F.struct("id", "offset"))).first()[0]
        if row is None:
            cuts += [nv] * (parts - p)
            break
        cuts.append(row[0])
        at = row[1]
    return cuts


def cut_matrix(symmetric: DataFrame, cuts: list[int]) -> DataFrame:
    """Entries by their ends' owners under explicit cuts."""
    part = lambda c: owner_by_cuts(F.col(c), cuts).alias(f"{c}_owner")
    return symmetric.select(part("head"), part("tail")).groupBy("head_owner", "tail_owner").agg(F.count("*").alias("entries"))


def owner_cut_matrix(symmetric: DataFrame, nv: int, parts: int) -> DataFrame:
    return with_owners(symmetric, nv, parts).groupBy("head_owner", "tail_owner").agg(F.count("*").alias("entries"))


def process_degree(symmetric: DataFrame, nv: int, parts: int) -> DataFrame:
    """Number of other parts that each part has an edge to."""
    cut = owner_cut_matrix(symmetric, nv, parts).where("head_owner != tail_owner")
    return cut.groupBy("head_owner").agg(F.count("*").alias("neighbours"))


def boundary_edges(symmetric: DataFrame, nv: int, parts: int) -> DataFrame:
    """Entries inside one part whose tail has a neighbour in another part."""
    owned = with_owners(symmetric, nv, parts)
    rim = owned.where("head_owner != tail_owner").select(F.col("head").alias("tail")).distinct()
    return owned.where("head_owner = tail_owner").join(rim, "tail", "left_semi").select("head", "tail", "head_owner")
