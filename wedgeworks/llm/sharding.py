"""Contiguous shards of near-equal bytes (native DataFrame operations only).

Global byte-size prefix sums come from per-partition totals; the order of
``doc_id`` is cut where a row's midpoint passes a multiple of total / shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wedgeworks.llm.common import global_prefix

SHARDS = 16


def byte_shards(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, size, text_crc32, shard, slot, shard_bytes_before.

    A row's size is the UTF-8 bytes of its text plus 1.  Shards are ranges of
    ``key``; each one's bytes differ from total / shards by at most one row's
    size.  ``slot`` counts from 0 inside a shard.

    Null text: no bytes (size 1, checksum 0).  Null key: sorts first.  Repeated
    keys or rows: each row is placed, ties by checksum and size.  A row larger
    than a shard's share fills its shard, and the shards it covers stay empty.
    Empty table: no rows.  Other columns are ignored.
    """
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit(""))).alias("text_crc32"),
        F.lit(1).cast("long").alias("_one"),
    )
    placed = global_prefix(rows, ["doc_id", "text_crc32", "size"], {"_at": "size", "_row": "_one"}).select(
        "doc_id",
        "size",
        "text_crc32",
        "_at",
        "_row",
        F.expr(f"cast(((2 * _at + size) * {shards}L) div (2 * _at_all) as int)").alias("shard"),
    )
    starts = placed.groupBy("shard").agg(F.min("_row").alias("_first"), F.min("_at").alias("_from"))
    # at most `shards` rows
    return placed.join(F.broadcast(starts), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("_row") - F.col("_first")).alias("slot"), (F.col("_at") - F.col("_from")).alias("offset")
    )
