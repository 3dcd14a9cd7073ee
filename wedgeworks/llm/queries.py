"""The registered queries of this subpackage: production parameters, whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wedgeworks.llm.common import table


def op1_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wedgeworks.llm.repetition import repetition

    return repetition(table(spark, sf_dir, "documents"))


def op2_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wedgeworks.llm.compression import classify, fit

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return classify(docs, fit(docs, labels)).select("doc_id", "held_out", "score", "predicted")


def op3_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wedgeworks.llm.sharding import byte_shards

    return byte_shards(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wedgeworks.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).documents.select("doc_id", "size", "source_size", "target", "taken")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wedgeworks.llm.toxicity import fit, score_texts

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return score_texts(docs, fit(docs, labels)).select("doc_id", "held_out", "score", "predicted")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wedgeworks.llm.substrings import removed_strings

    return removed_strings(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wedgeworks.llm.lines import deduplicated

    return deduplicated(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from wedgeworks.llm.token_files import checksums, new_path, read, write

    path = new_path(spark, "tokens")
    write(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path)
    return checksums(read(spark, path))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wedgeworks.llm.ngram_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wedgeworks.llm.decontamination import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_repetition,
        op2_compression,
        op3_byte_shards,
        op4_mix,
        op5_toxicity,
        op6_decontamination,
        op7_suffix_dedup,
        op8_line_dedup,
        op9_token_files,
        op10_ngram_join,
    )
}
