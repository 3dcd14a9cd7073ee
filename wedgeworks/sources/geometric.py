"""Random geometric graphs from a deterministic stream, and the radius join beneath them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wedgeworks.functions.columns import distance, is_power_of_two, lehmer, unit, whole
from wedgeworks.sources.blocks import radius_pairs

#: The value of pi in the radius rule (fixed value).
PI = 3.14159


def radius(n: int) -> float:
    return (math.sqrt(math.log(n) / (PI * n)) + math.sqrt(2.0736 / n)) / 2


def check_strips(n: int, strips: int) -> None:
    """Preconditions of generation in ``strips`` horizontal strips that touch only their neighbours."""
    if not is_power_of_two(strips) or n % strips or not 1 / strips > radius(n):
        raise ValueError(f"{n} points cannot be dealt into {strips} strips")


def points(spark: SparkSession, n: int, seed: int | None = None, strips: int = 1) -> DataFrame:
    """(id, x, y) in the unit square: from the fixed stream, or pseudo-random under ``seed``.

    Of the stream, the first n values are x, the next n are y.  With strips, y is rescaled
    into the strip of the point's id.
    """
    check_strips(n, strips)
    ids = spark.range(n)
    if seed is None:
        x, y = unit(lehmer(F.col("id"))), unit(lehmer(F.col("id") + F.lit(n)))
    else:
        # by id, so that the points don't depend on the partitions
        x, y = (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(axis)), F.lit(1 << 53)) / F.lit(float(1 << 53)) for axis in (0, 1))
    if strips > 1:
        y = F.call_function("div", F.col("id") * F.lit(strips), F.lit(n)) * F.lit(1.0 / strips) + y / F.lit(float(strips))
    return ids.select("id", x.alias("x"), y.alias("y"))


def radius_join(rows: DataFrame, r: float, grid: tuple[Column, Column], apart: Column, keep: list[str], key: str = "id") -> DataFrame:
    """Pairs src < dst of rows at most ``r`` apart.

    ``grid`` gives two coordinates that differ by no more than the distance; cells are r wide, so
    partners lie in the same or an adjoining cell.  Each row is looked up in its own cell and in
    four of the eight around it, which meets every pair of cells once.  ``apart`` is the
    distance between a row and its partner's columns, which are named with ``_b`` appended.
    """
    cell = [F.floor(c / F.lit(r)).cast("long") for c in grid]
    celled = rows.select(key, *keep, cell[0].alias("_cx"), cell[1].alias("_cy"))
    around = [(0, 0), (1, 0), (0, 1), (1, 1), (1, -1)]
    steps = F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j")) for i, j in around))).alias("_s")
    sent = celled.select("*", steps).select(key, *keep, (F.col("_cx") + F.col("_s.i")).alias("_cx"), (F.col("_cy") + F.col("_s.j")).alias("_cy"), ((F.col("_s.i") == 0) & (F.col("_s.j") == 0)).alias("_own"))
    other = celled.select(F.col(key).alias(f"{key}_b"), *(F.col(c).alias(f"{c}_b") for c in keep), "_cx", "_cy")
    met = sent.join(other, ["_cx", "_cy"]).where(~F.col("_own") | (F.col(key) < F.col(f"{key}_b"))).withColumn("distance", apart).where(F.col("distance") <= F.lit(r))
    return met.select(F.least(key, f"{key}_b").alias("src"), F.greatest(key, f"{key}_b").alias("dst"), "distance")


def geometric_edges(spark: SparkSession, n: int, seed: int | None = None, unit_weight: bool = True, strips: int = 1) -> DataFrame:
    """Edges (src, dst, weight) between points within radius(n); weight 1 or the distance."""
    apart = distance([(F.col("x"), F.col("x_b")), (F.col("y"), F.col("y_b"))])
    met = radius_join(points(spark, n, seed, strips), radius(n), (F.col("x"), F.col("y")), apart, ["x", "y"])
    return met.select("src", "dst", (F.lit(1.0) if unit_weight else F.col("distance")).alias("weight"))


def random_edges(spark: SparkSession, edges: DataFrame, n: int, percent: float, unit_weight: bool = True, near: DataFrame | None = None, strips: int = 1) -> DataFrame:
    """``edges`` and percent / 100 times as many picks from the stream after the points' values.

    Pick k takes three values: two ids modulo n and a weight in [0.01, 1).  Picks of one vertex, of
    an edge that exists, and repeats (the first stays) are dropped.  With ``near``, the points (id, x, y),
    an edge within a strip or between strips that touch weighs its length; others keep the drawn weight.
    """
    picks = int(edges.count() * percent / 100)
    value = lambda j: lehmer(F.col("id") * F.lit(3) + F.lit(2 * n + j))
    drawn = spark.range(picks).select("id", (value(0) % n).alias("p"), (value(1) % n).alias("q"), (F.lit(0.01) + F.lit(0.99) * unit(value(2))).alias("w"))
    drawn = drawn.where("p != q").groupBy(F.least("p", "q").alias("src"), F.greatest("p", "q").alias("dst")).agg(F.min_by("w", "id").alias("weight"))
    new = drawn.join(edges, ["src", "dst"], "left_anti")
    if near is not None and not unit_weight:
        for end in ("src", "dst"):
            new = new.join(near.select(F.col("id").alias(end), F.col("x").alias(f"x_{end}"), F.col("y").alias(f"y_{end}")), end)
        strip = lambda c: whole(F.col(c) * F.lit(strips), n)
        length = distance([(F.col("x_src"), F.col("x_dst")), (F.col("y_src"), F.col("y_dst"))])
        touch = F.abs(strip("src") - strip("dst")) <= 1
        new = new.select("src", "dst", F.when(touch, length).otherwise(F.col("weight")).alias("weight"))
    return edges.unionByName(new.withColumn("weight", F.lit(1.0)) if unit_weight else new)


def embedding_edges(rows: DataFrame, r: float) -> DataFrame:
    """Pairs of vectors at most r apart (Euclidean, in double precision)."""
    return radius_pairs(rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("e")), r)
