"""Degrees, neighbour ranges, offsets and distribution statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wedgeworks.functions.columns import owner, whole

#: Vertices whose degrees one task sums in order.
BLOCK = 1 << 20


def degree(symmetric: DataFrame) -> DataFrame:
    return symmetric.groupBy(F.col("head").alias("id")).agg(F.count("*").alias("degree"))


def edge_range(symmetric: DataFrame) -> DataFrame:
    """Least and greatest neighbour of each vertex that has any."""
    return symmetric.groupBy(F.col("head").alias("id")).agg(F.min("tail").alias("min_nbr"), F.max("tail").alias("max_nbr"))


def csr_offsets(symmetric: DataFrame, nv: int, block: int = BLOCK) -> DataFrame:
    """(id, degree, offset) of all ids below nv, isolated ones included.

    Prefix sums by blocks of ids: block totals (nv / block rows) are summed in order, and a window inside
    each block adds the rest, so no task sees more than one block.
    """
    spark = symmetric.sparkSession
    every = spark.range(nv).join(degree(symmetric), "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))
    every = every.withColumn("_block", whole(F.col("id"), block))
    totals = every.groupBy("_block").agg(F.sum("degree").alias("_sum"))
    before = Window.partitionBy(F.lit(0)).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_block").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = every.withColumn("_upto", F.sum("degree").over(inside))
    return local.join(bases, "_block").select("id", "degree", (F.col("_base") + F.col("_upto") - F.col("degree")).cast("long").alias("offset"))


def dist_stats(symmetric: DataFrame, nv: int, parts: int) -> DataFrame:
    """One row: sum, maximum, mean, mean square, variance and deviation of the parts' entry counts (empty parts count)."""
    counts = symmetric.groupBy(owner(F.col("head"), nv, parts).alias("id")).agg(F.count("*").alias("n"))
    every = symmetric.sparkSession.range(parts).join(counts, "id", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    base = every.agg(
        F.sum("n").alias("total"), F.max("n").alias("largest"), (F.sum("n") / F.lit(float(parts))).alias("mean"), (F.sum(F.col("n") * F.col("n")) / F.lit(float(parts))).alias("mean_square")
    )
    variance = F.abs(F.col("mean_square") - F.col("mean") * F.col("mean"))
    return base.select("total", "largest", "mean", "mean_square", variance.alias("variance"), F.sqrt(variance).alias("deviation"))


def vertex_bound(symmetric: DataFrame) -> int:
    """One more than the greatest id; 0 for an empty graph."""
    return (symmetric.agg(F.max("tail")).first()[0] + 1) if symmetric.take(1) else 0


def empty_edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "src long, dst long")
