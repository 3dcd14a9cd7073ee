"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Word pattern of every operator: a run of anything but space and \t\n\v\f\r.
#: ``bytes.split()`` splits UTF-8 at exactly these six bytes.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; one beside the warehouse's tables only where none is named."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        found = f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"  # shared like the tables
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, so that later passes see the same partitions."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def forget(spark: SparkSession) -> None:
    """Have the files of shuffles and checkpoints that nothing refers to any more deleted: Spark does so only when
    the driver happens to collect its garbage, and until then each step's files add to the disk in use."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Keys at most that are sent to every executor to pick rows by.
SENT_KEYS = 500_000


def among(rows: DataFrame, key: str, keys: DataFrame, most: int = SENT_KEYS) -> DataFrame:
    """The rows whose key is in ``keys`` (one column of that name, distinct).

    Up to ``most`` keys go to every executor, so that the rows that don't matter are never shuffled.
    """
    keys = materialise(keys)
    return rows.join(F.broadcast(keys) if keys.count() <= most else keys, key, "left_semi")


def total_bytes(docs: DataFrame, text: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(text))).first()[0] or 0


def global_prefix(
    df: DataFrame,
    order: list[str],
    measures: dict[str, str],
    group: list[str] | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Exclusive running sums over a total order, without a single-task window.

    Rows are range-partitioned by ``group + order``; each partition's totals are
    summed, the totals of earlier partitions (of the same group) become the
    partition's base, and a window inside the partition adds the rest.  The base
    table has one row per partition and group present in it.  A group of any size
    spreads over many partitions.

    ``measures`` maps an output column (sum before this row) to an input column;
    ``<output>_all`` is the group's total.  Null keys sort first and form a group.
    """
    group = group or []
    n = partitions or shuffle_partitions(df.sparkSession)
    dealt = materialise(df.repartitionByRange(n, *group, *order).withColumn("_pid", F.spark_partition_id()))
    part = [*group, "_pid"]
    totals = dealt.groupBy(*part).agg(*(F.sum(c).alias(f"_t_{o}") for o, c in measures.items()))
    before = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    base = totals.select(
        *(F.col(c).alias(f"_k_{c}") for c in part),
        *(F.coalesce(F.sum(f"_t_{o}").over(before), F.lit(0)).alias(f"_b_{o}") for o in measures),
        *(F.sum(f"_t_{o}").over(whole).alias(f"{o}_all") for o in measures),
    )
    inside = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = dealt.select("*", *((F.sum(c).over(inside) - F.col(c)).alias(f"_l_{o}") for o, c in measures.items()))
    on = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in part))
    return local.join(base, on).select(
        *(F.col(f"`{c}`") for c in df.columns),
        *((F.col(f"_b_{o}") + F.col(f"_l_{o}")).alias(o) for o in measures),
        *(f"{o}_all" for o in measures),
    )


def pieces(parts, rows: int = 256):
    """Arrow batches cut into small ones, so that a worker holds few texts as objects at a time."""
    for part in parts:
        for at in range(0, part.num_rows, rows):
            yield part.slice(at, rows)


def release() -> None:
    """Give the system back what a worker no longer needs: workers live on from task to task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the C library, where it has one
    if trim:
        trim(0)


def freed(run):
    """``run``, an iterator over batches, that leaves the worker small when it ends."""

    def wrapped(parts):
        try:
            yield from run(parts)
        finally:
            release()

    return wrapped


def mix64(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values: a mixer of two multiplications (a published one-to-one mapping)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
