"""Corpus pipeline: toxicity, near-duplicate join, decontamination, mixing, sharding.

Each stage works on all rows that the one before it kept; each but the last returns the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wedgeworks.llm.common import table
from wedgeworks.llm.decontamination import without_items
from wedgeworks.llm.mixing import mixed
from wedgeworks.llm.ngram_join import without_copies
from wedgeworks.llm.sharding import byte_shards
from wedgeworks.llm.token_files import new_path
from wedgeworks.llm.toxicity import fit, without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop toxic documents; the model learns from the labels of this stage's own rows."""
    return without_toxic(docs, fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of linked ones: five-word shingles, 80 percent of the union in common."""
    return without_copies(docs, n=5, percent=80, classes=3)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    return without_items(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that the sources meet their target weights."""
    return mixed(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard, slot and byte offset of every row."""
    return byte_shards(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]
#: The toxicity model and the fingerprints have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written to the shared folder and read again."""
    docs, path = table(spark, sf_dir, "documents"), new_path(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
    return docs
