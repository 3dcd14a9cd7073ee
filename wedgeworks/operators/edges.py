"""Edge tables.

A canonical table has one row (src, dst[, weight]) per undirected edge, src < dst.
A symmetric table has both directions as (head, tail[, weight]).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def canonicalize(pairs: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """Distinct undirected edges: self-loops, nulls, repeats and reversals go."""
    proper = pairs.where(F.col(a) != F.col(b))
    return proper.select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")).distinct()


def symmetrize(edges: DataFrame) -> DataFrame:
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    there = edges.select(F.col("src").alias("head"), F.col("dst").alias("tail"), *rest)
    return there.unionByName(edges.select(F.col("dst").alias("head"), F.col("src").alias("tail"), *rest))


def oriented(edges: DataFrame, by: str = "degree") -> DataFrame:
    """(u, v): each edge once, from its lesser to its greater end.

    ``id`` compares ids.  ``degree`` compares (degree, id), which leaves no vertex more than
    sqrt(2 |E|) out-neighbours, hubs included.
    """
    if by == "id":
        return edges.select(F.col("src").alias("u"), F.col("dst").alias("v"))
    if by != "degree":
        raise ValueError(f"unknown orientation {by!r}")
    degrees = symmetrize(edges.select("src", "dst")).groupBy("head").agg(F.count("*").alias("d"))
    ranked = edges.join(degrees.select(F.col("head").alias("src"), F.col("d").alias("da")), "src").join(
        degrees.select(F.col("head").alias("dst"), F.col("d").alias("db")), "dst"
    )
    up = F.struct("da", "src") < F.struct("db", "dst")
    return ranked.select(F.when(up, F.col("src")).otherwise(F.col("dst")).alias("u"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("v"))


def settled(edges: DataFrame, by: str = "auto") -> str:
    """The orientation to use: of ``auto``, ``id`` where no vertex has more than sqrt(2 |E|) greater neighbours.

    That is the bound that ``degree`` keeps on any graph, so its two joins gain nothing there.  One
    aggregation by vertex, combined before its shuffle, tells.
    """
    if by != "auto":
        return by
    most, total = edges.groupBy("src").agg(F.count("*").alias("d")).agg(F.max("d"), F.sum("d")).first()
    return "id" if (most or 0) ** 2 <= 2 * (total or 0) else "degree"


def listing(symmetric: DataFrame, most: int = 100_000) -> DataFrame:
    """The directed entries in (head, tail) order, at most ``most``: a report for people."""
    return symmetric.orderBy("head", "tail").limit(most)
