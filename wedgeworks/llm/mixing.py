"""Mixing sources to target weights by Sainte-Lague apportionment (native only).

Each source's documents, in seeded order, form one stream of words cut into
blocks of equal length.  A fixed number of seats, each worth one block, goes to
the sources by highest quotients; consecutive seats make up an output shard, so
every shard has integer quotas of its own.  A source's k-th seat takes the k-th
block of the source's seeded block order, starting again when all are used.

A source whose target is few blocks would miss it by a large share, or get no seat
at all.  It takes no part in the contest: it takes its target to the word, its whole
stream in full laps and the head of the stream as a last, partial seat.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wedgeworks.llm.common import WORD, global_prefix, materialise

SEATS = 1 << 16
SHARD_SEATS = 1 << 10
#: Sources with a target below so many blocks take it to the word.
FEW_BLOCKS = 64
REPEATS = 3
SEED = "mix-1"


@dataclass
class Mix:
    """documents: doc_id, source, size, source_size, target, taken (one row per input row).
    sources: source, weight, source_size, target, seats.  schedule: shard, seat, source, block, lap, words;
    a source of few blocks has its whole stream as block 0, and its seats come last.
    """

    documents: DataFrame
    sources: DataFrame
    schedule: DataFrame


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), repeats: int = REPEATS) -> DataFrame:
    """Water-filled targets: weight shares of all words, none above repeats x its own.

    ``sizes`` has one row per source (``_null``, ``_source``, ``source_size``).  A source is
    capped when its cap per weight lies under the level that the rest would reach; in
    ascending order of cap per weight the capped ones form a prefix.
    """
    rank = Window.partitionBy(F.lit(0)).orderBy("_null", "_source")
    table = F.array(*(F.lit(w) for w in weights))
    ranked = sizes.withColumn("weight", F.element_at(table, (F.row_number().over(rank) - 1) % len(weights) + 1).cast("long"))
    ranked = ranked.withColumn("_cap", F.col("source_size") * repeats).withColumn("_ratio", F.col("_cap") / F.col("weight"))
    by_ratio = Window.partitionBy(F.lit(0)).orderBy("_ratio", "_null", "_source").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    filled = ranked.select(
        "*",
        F.coalesce(F.sum("_cap").over(by_ratio), F.lit(0)).alias("_caps"),
        F.coalesce(F.sum("weight").over(by_ratio), F.lit(0)).alias("_weights"),
        F.sum("source_size").over(everything).alias("_total"),
        F.sum("weight").over(everything).alias("_all"),
    ).withColumn("_level", (F.col("_total") - F.col("_caps")) / (F.col("_all") - F.col("_weights")))
    # the level is that of the first source which it does not cap
    level = F.min(F.when(F.col("_ratio") >= F.col("_level"), F.struct("_ratio", "_null", "_source", "_level"))).over(everything)
    return filled.withColumn("_at", level["_level"]).withColumn(
        "target", F.when(F.col("_at").isNull(), F.col("_cap").cast("double")).otherwise(F.least(F.col("_cap").cast("double"), F.col("weight") * F.col("_at")))
    )


def mix(docs: DataFrame, seats: int = SEATS, shard_seats: int = SHARD_SEATS, seed: str = SEED, weights: tuple[int, ...] = (1, 2, 3), key: str = "doc_id", text: str = "text", source: str = "source") -> Mix:
    """Mix all documents; see the module for the method.

    A document's size is its number of words.  ``taken`` counts its words in the
    blocks taken, laps included; at most 3 x its size.  A source's taken words
    differ from its target by a few blocks of (all words / seats) words, if that target is
    FEW_BLOCKS blocks or more; by half a word at most, if it is less and a block is more than a word.

    Null text or no words: size 0, taken 0.  Null source: a source of its own,
    after all others.  Null or repeated keys: each row is a part of its source's
    stream, ties by size.  Texts of any length are counted whole.  Empty table: no rows, no seats.
    Other columns are ignored, whatever their names.
    """
    rows = docs.select(
        F.col(key).alias("doc_id"),
        F.col(source).alias("source"),
        F.col(source).isNull().alias("_null"),
        F.coalesce(F.col(source), F.lit("")).alias("_source"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))).alias("_h"),
    )
    stream = materialise(global_prefix(rows, ["_h", "doc_id", "size"], {"_at": "size"}, ["_null", "_source"]))
    sizes = stream.groupBy("_null", "_source").agg(F.max("_at_all").alias("source_size"))
    block = F.greatest(F.lit(1), F.expr(f"cast((_total + {seats} - 1) div {seats} as long)"))
    sources = source_targets(sizes, weights).withColumn("_block", block)
    sources = sources.withColumn("_blocks", F.expr("(source_size + _block - 1) div _block"))
    sources = sources.withColumn("_fair", F.floor(F.col("target") / F.col("_block")).cast("long"))
    sources = sources.withColumn("_few", (F.col("_block") > 1) & (F.col("target") < FEW_BLOCKS * F.col("_block")))
    sources = sources.withColumn("_words", F.when(F.col("_few"), F.round("target")).otherwise(0).cast("long"))
    sources = sources.withColumn("_seats", F.greatest(F.lit(0), F.expr("(_total - sum(_words) over (partition by 0) + _block - 1) div _block")))
    number = sources.count()
    sources = materialise(sources)  # one row per source
    large = sources.where("not _few")
    rivals = large.count()

    # Quotients: seat k of a source has target / (2k - 1).  A source's seats stay within the number
    # of sources of its fair share, so each one's quotients up to there hold all that can win.
    contest = large.where("target > 0").select(
        "_null",
        "_source",
        "target",
        "_blocks",
        "_block",
        "source_size",
        "_seats",
        F.explode(F.expr(f"sequence(1L, least({REPEATS} * _blocks, _fair + {rivals}L + 1L))")).alias("_k"),
    )
    quotient = F.col("target") / (2 * F.col("_k") - 1)
    order = Window.partitionBy(F.lit(0)).orderBy(quotient.desc(), "_null", "_source", "_k")
    seated = contest.withColumn("seat", F.row_number().over(order) - 1).where("seat < _seats")  # at most `seats` + sources^2 rows
    hashed = large.where("_blocks > 0").select("_null", "_source", "_blocks", F.explode(F.expr("sequence(0L, _blocks - 1)")).alias("block"))
    tag = F.md5(F.concat_ws(":", F.lit(seed), F.col("_null").cast("string"), F.col("_source"), F.col("block").cast("string")))
    seeded = hashed.withColumn("_rank", F.row_number().over(Window.partitionBy("_null", "_source").orderBy(tag, "block")) - 1)  # at most seats + sources
    schedule = (
        seated.withColumn("_rank", F.expr("(_k - 1) % _blocks"))
        .withColumn("lap", F.expr("(_k - 1) div _blocks"))
        .join(seeded.drop("_blocks"), ["_null", "_source", "_rank"])
        .select("seat", "_null", "_source", "block", "lap", F.expr("least(_block, source_size - block * _block)").alias("words"))
    )
    laps = sources.where("_words > 0").select("*", F.explode(F.expr("sequence(0L, (_words - 1) div source_size)")).alias("lap"))
    after = Window.partitionBy(F.lit(0)).orderBy(F.desc("target"), "_null", "_source", "lap")  # at most 3 rows per source
    last_seats = laps.select(
        (F.col("_seats") + F.row_number().over(after) - 1).alias("seat"), "_null", "_source", F.lit(0).cast("long").alias("block"), "lap", F.expr("least(source_size, _words - lap * source_size)").alias("words")
    )
    schedule = schedule.withColumn("seat", F.col("seat").cast("long")).unionByName(last_seats).withColumn("shard", F.expr(f"cast(seat div {shard_seats} as int)"))
    schedule = materialise(schedule)
    used = schedule.groupBy("_null", "_source", "block").agg(F.count("*").alias("_reps"))
    upto = Window.partitionBy("_null", "_source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        hashed.join(used, ["_null", "_source", "block"], "left")
        .withColumn("_reps", F.coalesce("_reps", F.lit(0)))
        .withColumn("_before", F.coalesce(F.sum("_reps").over(upto), F.lit(0)))
        .select("_null", "_source", "block", "_reps", "_before")
    )
    seats_of = schedule.groupBy("_null", "_source").agg(F.count("*").alias("seats"))
    shown = F.when(F.col("_null"), F.lit(None)).otherwise(F.col("_source")).alias("source")

    # Words taken before position x of a stream: whole blocks before it, then part of its own block.
    # The block table has at most seats + sources rows, so broadcasting it is bounded by the parameter.
    few = sources.select("_null", "_source", "target", "_block", "_blocks", "source_size", "_few", "_words")
    few = F.broadcast(few) if number <= seats else few
    at = stream.join(few, ["_null", "_source"]).select(
        "doc_id", "source", "size", "_null", "_source", "source_size", "target", "_block", "_few", "_words", "_at", (F.col("_at") + F.col("size")).alias("_end")
    )
    last = F.greatest(F.col("_end") - 1, F.lit(0))
    at = at.withColumn("_b0", F.expr("_at div _block")).withColumn("_b1", F.floor(last / F.col("_block")).cast("long"))
    small = number <= seats
    for side in ("0", "1"):
        lookup = blocks.select("_null", "_source", F.col("block").alias(f"_b{side}"), F.col("_reps").alias(f"_r{side}"), F.col("_before").alias(f"_p{side}"))
        at = at.join(F.broadcast(lookup) if small else lookup, ["_null", "_source", f"_b{side}"], "left")
    count = lambda x, side: F.expr(f"_p{side} * _block + _r{side} * ({x} - _b{side} * _block)")
    # few blocks: full laps, then the words before the end of the partial one
    head = lambda x: F.expr(f"(_words div source_size) * {x} + least({x}, _words % source_size)")
    taken = F.when(F.col("size") == 0, F.lit(0)).when(F.col("_few"), head("_end") - head("_at")).otherwise(count("_end", "1") - count("_at", "0")).cast("long")
    documents = at.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))
    listed = sources.join(seats_of, ["_null", "_source"], "left").select(shown, "weight", "source_size", "target", F.coalesce("seats", F.lit(0)).alias("seats"))
    return Mix(documents, listed, schedule.select("shard", "seat", shown, "block", "lap", "words"))


def mixed(docs: DataFrame, seed: str = SEED, seats: int = SEATS, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the mix takes its words.

    taken / size is rounded up with the probability of its fraction, decided by a hash of the row's
    key, text and source, so that whole documents make up each source's target.  No row comes more than
    3 times; rows without words come once, as they cost nothing.  Rows alike in key, source and
    size share their taken words evenly.  Null keys and sources are values like others.  Columns of any
    name pass through.  Texts of any length are counted whole.  Empty table: no rows.
    """
    names = {"doc_id": key, "text": text, "source": source}
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), *(F.col(f"`{c}`").alias(n) for n, c in names.items()))
    per = mix(rows, seats, seed=seed).documents.groupBy("doc_id", "source", "size").agg((F.sum("taken") / F.count("*")).alias("_taken"))
    per = per.select(F.col("doc_id").alias("_key"), F.col("source").alias("_from"), F.col("size").alias("_size"), "_taken")
    rows = rows.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
    joined = rows.join(per, F.col("doc_id").eqNullSafe(F.col("_key")) & F.col("source").eqNullSafe(F.col("_from")) & (F.col("size") == F.col("_size")))
    chance = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text", "source"), F.lit(1 << 20)) / (1 << 20)
    copies = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.floor(F.col("_taken") / F.col("size") + chance)).cast("int")
    return joined.select("_row", F.explode(F.array_repeat(F.lit(0), copies))).select("_row.*")
