"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wedgeworks.llm.common import materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step.  ``edges`` has each link once, as (u, v) with u > v.

    Each node's neighbours (large: all of them; small: the smaller ones) are pointed to the least of
    them and the node itself.  Only minima are gathered per node, so a hub needs no memory of its size.
    """
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every linked node; component is the smallest node reachable.

    ``links`` has two columns of ids; direction, repeats, nulls and self-links don't matter.
    """
    a, b = links.columns
    edges = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    edges = materialise(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    state = None
    for _ in range(rounds):
        edges = materialise(_star(_star(edges, True), False))
        new = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == state:
            break
        state = new
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
