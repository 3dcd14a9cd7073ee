"""Graphs projected from relational tables: canonical edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wedgeworks.plans.cells import BITS, GRID, PER_CORE, united


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cooccurrence(rows: DataFrame, group: list[str], member: str) -> DataFrame:
    """Distinct pairs a < b of members that share a group, dealt by a, so that lists by a need no further shuffle."""
    held = rows.select(*group, member).repartition(*group).distinct()
    a, b = held.withColumnRenamed(member, "src"), held.withColumnRenamed(member, "dst")
    return a.join(b, group).where("src < dst").select("src", "dst").repartition("src").distinct()


def neighbour_lists(rows: DataFrame, group: list[str], member: str, bits: int = BITS) -> DataFrame:
    """(u, out): members beyond u that share a group with it, sorted: the graph of ``cooccurrence``, as lists.

    Where groups are large, they go to ranges of members, whose rows of bits they fill; where that would shuffle more
    ids than there are pairs, pairs are shuffled.  Members are integral; a group's members must fit a row.
    """
    held = rows.select(*group, F.col(member).cast("long").alias("_m")).dropna().distinct()
    lists = held.groupBy(*group).agg(F.sort_array(F.collect_list("_m")).alias("out"))
    k = F.size("out").cast("long")
    ids, pairs = lists.agg(F.sum(k), F.sum(k * (k - 1) / 2)).first()
    different = held.select("_m").distinct()
    grid = F.percentile_approx("_m", [i / GRID for i in range(1, GRID)], 4 * GRID)
    vertices, marks = different.agg(F.count("*"), grid).first()
    cells = max(-(-(vertices**2) // bits), PER_CORE * rows.sparkSession.sparkContext.defaultParallelism)
    if cells > GRID or cells * (ids or 0) >= (pairs or 0):
        edges = cooccurrence(rows.withColumn(member, F.col(member).cast("long")), group, member)
        return edges.groupBy(F.col("src").alias("u")).agg(F.sort_array(F.collect_list("dst")).alias("out"))
    return united(lists, sorted({marks[i * GRID // cells - 1] for i in range(1, cells)}), bits)


def part_coorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cooccurrence(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_partkey")


def supp_coorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cooccurrence(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_suppkey")


def part_supp(spark: SparkSession, sf_dir: str, shift: int = 10_000_000) -> DataFrame:
    """Distinct arcs from parts to suppliers, which are shifted: bipartite if beyond all parts, else ids of both may be alike."""
    part, supplier = (F.col(c).cast("long") for c in ("l_partkey", "l_suppkey"))  # 32-bit keys may not bear the shift
    return table(spark, sf_dir, "lineitem").select(part.alias("src"), (supplier + F.lit(shift)).alias("dst")).dropna().distinct()


def user_hour(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """Users by kind and hour of their events, and the columns that group them."""
    rows = table(spark, sf_dir, "events").select("event_type", F.date_trunc("hour", "ts").alias("hour"), "user_id")
    return rows, ["event_type", "hour"]
