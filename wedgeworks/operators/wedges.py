"""Wedges: pairs u < v of neighbours of one head.

A head with n neighbours has n (n - 1) / 2 wedges; totals come from ranks and from the listed
triangles wherever possible, and the pairs themselves are made only where a predicate needs both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wedgeworks.functions.columns import owner, whole, within_range
from wedgeworks.operators.stats import edge_range

#: Ids of one segment of an adjacency list; a hub's list is ranked segment by segment.
SEGMENT = 1 << 16


def wedge_count(symmetric: DataFrame) -> DataFrame:
    d = symmetric.groupBy("head").agg(F.count("*").alias("d"))
    total = F.sum(whole(F.col("d") * (F.col("d") - 1), 2))
    return d.agg(F.coalesce(total, F.lit(0)).cast("long").alias("wedges"))


def later_neighbours(symmetric: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(head, tail, later): for each entry, the head's neighbours greater than the tail, that is the wedges
    in which the tail is the lesser end."""
    cut = symmetric.select("head", "tail", whole(F.col("tail"), segment).alias("_seg"))
    counts = cut.groupBy("head", "_seg").agg(F.count("*").alias("_n"))
    after = Window.partitionBy("head").orderBy(F.col("_seg").desc()).rowsBetween(Window.unboundedPreceding, -1)
    beyond = counts.select("head", "_seg", F.coalesce(F.sum("_n").over(after), F.lit(0)).alias("_beyond"))
    ranked = cut.withColumn("_rank", F.row_number().over(Window.partitionBy("head", "_seg").orderBy(F.col("tail").desc())) - 1)
    return ranked.join(beyond, ["head", "_seg"]).select("head", "tail", (F.col("_rank") + F.col("_beyond")).cast("long").alias("later"))


def wedges(symmetric: DataFrame) -> DataFrame:
    """All wedges as rows (head, u, v).  Their number is quadratic in the degrees."""
    a = symmetric.select("head", F.col("tail").alias("u"))
    return a.join(symmetric.select("head", F.col("tail").alias("v")), "head").where("u < v")


def pruned_wedges(symmetric: DataFrame) -> DataFrame:
    """Wedges that neighbour ranges cannot rule out: v in the range of u's neighbours, u at least v's least."""
    ranges = edge_range(symmetric)
    entry = symmetric.join(ranges.withColumnRenamed("id", "tail"), "tail")
    a = entry.select("head", F.col("tail").alias("u"), F.col("min_nbr").alias("low"), F.col("max_nbr").alias("high"))
    b = entry.select("head", F.col("tail").alias("v"), F.col("min_nbr").alias("v_low"))
    keep = within_range(F.col("v"), F.col("low"), F.col("high")) & (F.col("u") >= F.col("v_low")) & (F.col("u") < F.col("v"))
    return a.join(b, "head").where(keep).select("head", "u", "v")


def pruned_wedge_count(symmetric: DataFrame) -> DataFrame:
    return pruned_wedges(symmetric).agg(F.count("*").alias("wedges"))


def adjacent_wedge_count(symmetric: DataFrame, nv: int, parts: int) -> DataFrame:
    """Pruned wedges whose two ends have one owner, or owners with an edge between them: no others can close.

    Wedges are counted by pair of owners before the filter, so at most parts x parts rows are shuffled a task.
    """
    own = lambda c: owner(F.col(c), nv, parts)
    per = pruned_wedges(symmetric).groupBy(own("u").alias("_a"), own("v").alias("_b")).agg(F.count("*").alias("n"))
    linked = symmetric.select(own("head").alias("_a"), own("tail").alias("_b")).distinct()
    kept = per.where("_a = _b").unionByName(per.where("_a != _b").join(linked, ["_a", "_b"], "left_semi"))
    return kept.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("wedges"))


def _per_owner_pair(symmetric: DataFrame, found: DataFrame, nv: int, parts: int) -> DataFrame:
    """(head_owner, lesser_owner, wedges, closed).  ``found`` lists each triangle a < b < c once; it closes
    one wedge at each corner, with lesser ends b, a and a."""
    own = lambda c: owner(F.col(c), nv, parts)
    every = later_neighbours(symmetric).groupBy(own("head").alias("head_owner"), own("tail").alias("lesser_owner")).agg(F.sum("later").alias("wedges"))
    corners = F.explode(F.array(F.struct(own("a").alias("h"), own("b").alias("l")), F.struct(own("b").alias("h"), own("a").alias("l")), F.struct(own("c").alias("h"), own("a").alias("l"))))
    corner = found.groupBy(own("a").alias("_a"), own("b").alias("_b"), own("c").alias("_c")).agg(F.count("*").alias("n"), F.first("a").alias("a"), F.first("b").alias("b"), F.first("c").alias("c"))
    closed = corner.select(corners.alias("_x"), "n").groupBy(F.col("_x.h").alias("head_owner"), F.col("_x.l").alias("lesser_owner")).agg(F.sum("n").alias("closed"))
    joined = every.join(closed, ["head_owner", "lesser_owner"], "left")
    return joined.select("head_owner", "lesser_owner", F.col("wedges").cast("long"), F.coalesce("closed", F.lit(0)).cast("long").alias("closed")).where("wedges > 0")


def wedge_status_by_owner(symmetric: DataFrame, found: DataFrame, nv: int, parts: int) -> DataFrame:
    """Closed and open wedges between different owners, by head's and lesser end's owner."""
    rows = _per_owner_pair(symmetric, found, nv, parts).where("head_owner != lesser_owner")
    return rows.select("head_owner", "lesser_owner", "closed", (F.col("wedges") - F.col("closed")).alias("open"))


def wedge_locality(symmetric: DataFrame, found: DataFrame, nv: int, parts: int) -> DataFrame:
    """Wedges and closed ones, by whether head and lesser end have one owner."""
    rows = _per_owner_pair(symmetric, found, nv, parts)
    return rows.groupBy((F.col("head_owner") == F.col("lesser_owner")).alias("local")).agg(F.sum("wedges").cast("long").alias("wedges"), F.sum("closed").cast("long").alias("closed"))


def ghost_counts(symmetric: DataFrame, nv: int, parts: int) -> DataFrame:
    """Wedges to be checked elsewhere, by head's and lesser end's owner."""
    own = lambda c: owner(F.col(c), nv, parts)
    rows = later_neighbours(symmetric).groupBy(own("head").alias("head_owner"), own("tail").alias("lesser_owner")).agg(F.sum("later").cast("long").alias("wedges"))
    return rows.where("head_owner != lesser_owner and wedges > 0")


def wedges_per_vertex(symmetric: DataFrame, nv: int, parts: int) -> DataFrame:
    """Per head, the wedges to be checked elsewhere."""
    away = later_neighbours(symmetric).where(owner(F.col("head"), nv, parts) != owner(F.col("tail"), nv, parts))
    return away.groupBy(F.col("head").alias("id")).agg(F.sum("later").cast("long").alias("wedges")).where("wedges > 0")
