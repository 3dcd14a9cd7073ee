"""Jaccard join on word n-gram sets with token-combination prefixes.

Sets are put in one global order (tokens that are frequent in the whole corpus
last).  Two sets that reach the threshold share more tokens of their extended
prefixes than there are classes of frequent tokens.  A token held by few prefixes
is indexed alone; one held by many, alone within a cell of like sizes if few hold
it there; of those still held by many, pairs in one class: the extended prefix is
so long that, whatever tokens differ, a rare token or a pair in one class stays
common.  Nodes that meet in a pair held by many are put in an order of their own, by
how many of them hold each token: tokens of one node alone can't be shared, which
bounds the sizes it may link with, and its rarest shared tokens are its prefix there.
Candidates are verified on the words themselves.

Equal sets are one node.  Most links come from first rounds, which compare each
node with few others (the least and greatest node of its tokens; among nodes that
meet in frequent pairs, the one with the fewest tokens of its own).  The index then gives
only candidates of different components, so that a group of near copies never
becomes all of its pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wedgeworks.llm.common import among, forget, freed, materialise, mix64, pieces
from wedgeworks.llm.components import components

#: Least number of classes of frequent tokens, and the most prefixes that hold a rare token or pair.
CLASSES, RARE = 4, 16
#: Large sets have a class for each so many tokens that a linked set may lack, so that their pairs grow with their size.
PER_CLASS = 8
#: A token in at least this share of a batch's documents may be frequent in the corpus; the list of these is
#: bounded by mean set size / share, whatever the number of documents.
COMMON = 1 / 200
#: Words whose hashes a worker keeps, and rows it holds as objects at a time.
MEMO, ROWS = 100_000, 128
LEAST_BATCH = 200


class _Hashes(dict):
    def __missing__(self, word):
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < MEMO:
            self[word] = value
        return value


def shingle_hashes(text: bytes, n: int, words: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles; of the whole sequence if it is shorter."""
    split = text.lower().split()
    if not split:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, split), np.uint64, len(split))
    m = min(n, len(h))
    out = np.full(len(h) - m + 1, m, np.uint64)
    for j in range(m):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - m + 1 + j])
    return np.unique(out)


def shingles(text: bytes, n: int) -> set[tuple[bytes, ...]]:
    split = text.lower().split()
    m = min(n, len(split))
    return set(zip(*(split[j : len(split) - m + 1 + j] for j in range(m)), strict=True)) if split else set()


def allowed(size: int, percent: int) -> int:
    """Tokens of a set that a linked set may lack."""
    return size - -(-size * percent // 100)


class Bands:
    """Ranges of set sizes: linked sets lie in one band or in neighbours.

    Cell g holds the sets of bands g - 1 and g, so that every two linked sets meet in the cell of the
    larger one's band.  Each cell has its number of classes.
    """

    def __init__(self, percent: int, classes: int):
        self.width = math.log(100 / min(percent, 99)) * 1.0001  # a little more, so that rounding can't part linked sets
        top = int(math.log(2.0**40) / self.width) + 2
        self.classes = [max(classes, allowed(int(math.exp((g + 1) * self.width)) + 1, percent) // PER_CLASS) for g in range(top)]

    def of(self, size: int) -> int:
        return int(math.log(size) / self.width) if size else 0


def _common(n: int):
    def run(parts):
        words = _Hashes()
        held, docs = [], 0

        def out():
            found, count = np.unique(np.concatenate(held), return_counts=True)
            pick = count >= max(3, COMMON * docs)
            return pa.RecordBatch.from_arrays([pa.array(found[pick].view(np.int64)), pa.array(count[pick].astype(np.int64))], ["token", "n"])

        for part in pieces(parts, ROWS):
            for text in part.column(0).to_pylist():
                held.append(shingle_hashes(text, n, words))
                docs += 1
                if docs >= 2000:
                    yield out()
                    held, docs = [], 0
        if docs >= LEAST_BATCH:
            yield out()

    return run


def common_tokens(texts: DataFrame, n: int, total: int) -> list[int]:
    """Tokens that batches all over the corpus report often: a token in a share COMMON of all documents is
    reported by some batch.  Only the order of tokens depends on this list, never the result."""
    found = texts.mapInArrow(freed(_common(n)), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return [r["token"] for r in found.where(F.col("n") >= max(3, COMMON / 2 * total)).select("token").collect()]


def _sets(n: int, percent: int, bands: Bands, common: bytes):
    """size, its band, 128-bit hash of the set, and its extended prefix."""

    def run(parts):
        words, last = _Hashes(), np.frombuffer(common, np.uint64)
        for part in pieces(parts, ROWS):
            size, band, h1, h2, prefix = [], [], [], [], []
            for text in part.column("_text").to_pylist():
                found = shingle_hashes(text, n, words)
                d = xxhash.xxh3_128_intdigest(found.tobytes())
                size.append(len(found))
                band.append(bands.of(len(found)))
                h1.append((d >> 64) - (1 << 63))
                h2.append((d & (1 << 64) - 1) - (1 << 63))
                if len(last) and len(found):
                    at = np.minimum(np.searchsorted(last, found), len(last) - 1)
                    often = last[at] == found
                    found = np.concatenate([found[~often], found[often]])
                prefix.append(found[: allowed(len(found), percent) + 1 + bands.classes[band[-1] + 1]].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(size, pa.int64()), pa.array(band, pa.int32()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(prefix, pa.list_(pa.int64()))],
                ["doc_id", "size", "band", "h1", "h2", "prefix"],
            )

    return run


def _tokens(n: int):
    """All tokens of each text, with the first half of its set's hash."""

    def run(parts):
        words = _Hashes()
        for part in pieces(parts, ROWS):
            found = [shingle_hashes(t, n, words) for t in part.column("_text").to_pylist()]
            h1 = [(xxhash.xxh3_128_intdigest(x.tobytes()) >> 64) - (1 << 63) for x in found]
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(h1, pa.int64()), pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64()))], ["node", "h1", "tokens"])

    return run


def _verify(n: int, percent: int):
    def run(parts):
        for part in pieces(parts, ROWS):
            keep = []
            previous, left = None, set()
            for x, y in zip(part.column("_ta").to_pylist(), part.column("_tb").to_pylist(), strict=True):
                if x != previous:
                    previous, left = x, shingles(x, n)
                right = shingles(y, n)
                both = len(left & right)
                keep.append(both > 0 and 100 * both >= percent * (len(left) + len(right) - both))
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def verified(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose word n-gram sets reach the threshold, checked on the words."""
    kind = pairs.schema["a"].dataType.simpleString()
    pairs = materialise(pairs)
    texts = among(texts, "doc_id", _ends(pairs))
    with_a = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("_text").alias("_ta")), "a")
    both = with_a.join(texts.select(F.col("doc_id").alias("b"), F.col("_text").alias("_tb")), "b").select("a", "b", "_ta", "_tb")
    return materialise(both.mapInArrow(freed(_verify(n, percent)), f"a {kind}, b {kind}").distinct())


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()


def _least_common(percent: int):
    """Prefix tokens that linked sets share, at least: of sizes _na and _nb, with prefixes of _la and _lb tokens.

    Sets of n and m tokens that link have t = percent (n + m) / (100 + percent) in common.  A set's prefix
    lacks at most n - t of these, and common tokens come in one order, so the two prefixes share the
    lesser of what each has left.
    """
    common = F.expr(f"({percent}L * (_na + _nb) + {percent + 99}L) div {100 + percent}L")
    return F.least(*(F.col(f"_l{x}") - F.col(f"_n{x}") + common for x in "ab"))


def plausible(pairs: DataFrame, prefixes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose prefixes share as many tokens as the threshold demands; no linked pair goes."""
    prefixes = among(prefixes, "doc_id", _ends(pairs))
    side = lambda x: prefixes.select(F.col("doc_id").alias(x), F.col("size").alias(f"_n{x}"), F.col("prefix").alias(f"_p{x}"), F.size("prefix").alias(f"_l{x}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    return both.where(F.size(F.array_intersect("_pa", "_pb")) >= _least_common(percent)).select("a", "b").distinct()


def _enough(pairs: DataFrame, sets: DataFrame, celled: DataFrame, percent: int, rare: int) -> DataFrame:
    """The pairs (a, b, shared) that may share enough prefix tokens: ``shared`` rare ones, and of frequent ones
    at most what either has.  Sizes alone are compared here, no tokens."""
    frequent = celled.where(F.col("_held") > rare).groupBy(F.col("node").alias("doc_id")).agg(F.countDistinct("token").alias("_f"))
    plain = sets.select("doc_id", "size", F.size("prefix").alias("_l")).join(frequent, "doc_id", "left").groupBy("doc_id", "size").agg(F.max("_l").alias("_l"), F.max(F.coalesce("_f", F.lit(0))).alias("_f"))
    side = lambda x: plain.select(F.col("doc_id").alias(x), F.col("size").alias(f"_n{x}"), F.col("_l").alias(f"_l{x}"), F.col("_f").alias(f"_f{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.where(F.col("shared") + F.least("_fa", "_fb") >= _least_common(percent)).select("a", "b").distinct()


def _apart(index: DataFrame, near) -> DataFrame:
    """Pairs (a, b) of different components that share a key of the index (key, cell, node, n, band, component,
    one), with the sum of ``one`` over the keys."""
    right = index.select("key", "cell", F.col("node").alias("b"), F.col("n").alias("m"), F.col("band").alias("_band"), F.col("component").alias("_other"))
    met = (F.col("node") < F.col("b")) & (F.col("component") != F.col("_other")) & near(F.col("n"), F.col("m")) & (F.greatest("band", "_band") == F.col("cell"))
    return index.join(right, ["key", "cell"]).where(met).groupBy(F.col("node").alias("a"), "b").agg(F.sum("one").alias("shared"))


def _with_component(rows: DataFrame, group: DataFrame) -> DataFrame:
    return rows.join(group, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _met_often(hot: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """(node, n, alone, token, at): of the nodes ``hot``, each one's rarest shared tokens and their places, ``alone`` of
    the n tokens, which come first, being its own.

    Tokens are ranked by how many of these nodes hold them.  A set lacks at most allowed(n) tokens of a linked
    one, and lacks all of those that it alone holds: beyond that number it has no links here; else
    one token more than the rest of the allowance is sure to meet.
    """
    kind = hot.schema["node"].dataType.simpleString()
    own = among(texts, "doc_id", hot.select(F.col("node").alias("doc_id"))).select(F.col("doc_id").alias("node"), "_text")
    sets = own.mapInArrow(freed(_tokens(n)), f"node {kind}, h1 long, tokens array<long>").distinct()
    sets = sets.select("node", "h1", F.size("tokens").cast("long").alias("n"), F.explode("tokens").alias("token"))
    sets = materialise(sets)
    held = sets.groupBy("token").agg(F.count("*").alias("held")).where("held > 1")
    per = sets.join(held, "token").groupBy("node", "h1", "n").agg(F.sort_array(F.collect_list(F.struct("held", "token"))).alias("_t"))  # bounded by a set's size
    spare = F.expr(f"n - (n * {percent}L + 99) div 100").cast("int")
    per = per.withColumn("alone", F.col("n") - F.size("_t")).where(F.col("alone") <= spare)
    some = F.slice("_t", F.lit(1), (spare - F.col("alone") + 1).cast("int"))["token"]
    return per.select("node", "n", "alone", F.posexplode(some).alias("at", "token")).withColumn("at", F.col("alone") + F.col("at"))


def jaccard_components(docs: DataFrame, n: int = 3, percent: int = 90, classes: int = CLASSES, rare: int = RARE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    Words are runs of anything but space and \\t\\n\\v\\f\\r, A-Z lower-cased.  A text's set holds its
    distinct n-word shingles; with fewer words, the whole sequence.  Two documents link if 100 x the
    intersection is at least ``percent`` x the union; component_id is the smallest doc_id reachable.

    Null or empty text, or no words: size 0, linked with nothing, its own id.  Null doc_id: linked
    with nothing, component null.  Rows that repeat a doc_id are one document, linked by any of its texts.  Empty table: no rows.
    Very long texts are taken whole, a set in memory at a time.  Other columns are ignored, whatever their names.
    ``percent`` must be such that sets smaller than classes + 1 link only if they are equal: above
    100 * classes / (classes + 1).
    """
    if percent * (classes + 1) <= 100 * classes:
        raise ValueError("too many classes for this threshold")
    bands = Bands(percent, classes)
    texts = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    often = np.sort(np.array(common_tokens(texts.select("_text"), n, texts.count()), np.int64).view(np.uint64)).tobytes()
    sets = materialise(texts.mapInArrow(freed(_sets(n, percent, bands, often)), f"doc_id {kind}, size long, band int, h1 long, h2 long, prefix array<long>"))
    linkable = sets.where("size > 0 and doc_id is not null")
    same = ["h1", "h2", "size"]
    nodes = materialise(linkable.groupBy(*same).agg(F.min("doc_id").alias("node"), F.count("*").alias("_n")).where("_n > 1").select(*same, "node"))
    member = materialise(linkable.select("doc_id", *same).join(nodes, same).where("doc_id != node").select("doc_id", "node", *same))
    # sets of up to `classes` tokens link with equal ones alone
    own = linkable.where(F.col("size") > classes).join(member, ["doc_id", *same], "left_anti")
    member = member.select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    entry = own.select(F.col("doc_id").alias("node"), F.col("size").cast("int").alias("n"), "band", F.explode("prefix").alias("token"))
    entry = materialise(entry.join(entry.groupBy("token").agg(F.count("*").alias("held")).where("held > 1"), "token"))
    forget(docs.sparkSession)

    near = lambda x, y: (100 * F.least(x, y)) >= percent * F.greatest(x, y)
    pair = lambda rows: materialise(rows.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    center = F.explode(F.array("_lo", "_hi")).alias("_c")
    ends = entry.groupBy("token").agg(F.min(F.struct("node", "n")).alias("_lo"), F.max(F.struct("node", "n")).alias("_hi"))
    first = entry.join(ends, "token").select("node", "n", center).where(F.col("node") != F.col("_c.node")).where(near(F.col("n"), F.col("_c.n")))
    first = first.groupBy(F.col("node").alias("b"), F.col("_c.node").alias("a")).agg(F.count("*").alias("_shared")).where(F.col("_shared") > classes // 2)
    done = pair(first)
    forget(docs.sparkSession)
    links = verified(plausible(done, sets, percent), texts, n, percent)
    group = components(links)
    forget(docs.sparkSession)

    known = _with_component(entry.select("token", "held", "node", "n", "band"), group)
    split = lambda rows, by: rows.groupBy(*by).agg(F.count("*").alias("_held"), F.min("component").alias("_x"), F.max("component").alias("_y")).where("_x != _y").select(*by, "_held")
    rest = materialise(known.join(split(known, ["token"]).drop("_held"), "token"))
    none = F.lit(-1)
    index = rest.where(F.col("held") <= rare).select(F.col("token").alias("key"), none.alias("cell"), "node", "n", none.alias("band"), "component", F.lit(1).alias("one"))
    celled = rest.where(F.col("held") > rare).select("token", "node", "n", "band", "component", F.explode(F.array("band", F.col("band") + 1)).alias("cell"))
    celled = materialise(celled.join(split(celled, ["token", "cell"]), ["token", "cell"]))
    forget(docs.sparkSession)
    keyed = lambda rows, one, *by: rows.select(F.xxhash64(*by).alias("key"), "cell", "node", "n", "band", "component", F.lit(one).alias("one"))
    index = index.unionByName(keyed(celled.where(F.col("_held") <= rare), 1, "token"))
    number = F.element_at(F.array(*map(F.lit, bands.classes)), F.col("cell") + 1)
    many = celled.where(F.col("_held") > rare).withColumn("_class", F.pmod(F.col("token"), number))
    other = many.select("node", "cell", "_class", F.col("token").alias("_second"))
    paired = keyed(many.join(other, ["node", "cell", "_class"]).where("token < _second"), 0, "token", "_second")
    paired = materialise(paired.join(split(paired, ["key", "cell"]), ["key", "cell"]))
    forget(docs.sparkSession)
    index = index.unionByName(paired.where(F.col("_held") <= rare).drop("_held"))
    second = _enough(_apart(index, near), sets, celled, percent, rare)

    hot = materialise(paired.where(F.col("_held") > rare).select("node").distinct())
    if not hot.isEmpty():
        ranked = materialise(_met_often(hot, texts, n, percent))
        # the node with the fewest tokens of its own is compared with all that hold its token
        middle = ranked.groupBy("token").agg(F.min(F.struct("alone", "node", "n")).alias("_c"))
        held = _with_component(ranked.join(middle, "token"), group)
        round_ = pair(held.where(F.col("node") != F.col("_c.node")).where(near(F.col("n"), F.col("_c.n"))).select(F.col("_c.node").alias("a"), F.col("node").alias("b")))
        found = verified(plausible(round_.join(done, ["a", "b"], "left_anti"), sets, percent), texts, n, percent)
        links = links.unionByName(found)
        group = components(links)
        forget(docs.sparkSession)
        # the largest set that a set can link with, if this token is the first that they have in common: those
        # before it are then not in the other one.  A pair that links passes at its first token.
        reach = F.expr(f"({100 + percent}L * (n - at)) div {percent} - n")
        left = _with_component(ranked.withColumn("_most", reach), group)
        left = left.join(split(left, ["token"]).drop("_held"), "token")
        right = left.select("token", F.col("node").alias("b"), F.col("n").alias("m"), F.col("_most").alias("_other_most"), F.col("component").alias("_other"))
        met = (F.col("node") < F.col("b")) & (F.col("component") != F.col("_other")) & (F.col("m") <= F.col("_most")) & (F.col("n") <= F.col("_other_most")) & near(F.col("n"), F.col("m"))
        second = second.unionByName(left.join(right, "token").where(met).select(F.col("node").alias("a"), "b").distinct())
        done = done.unionByName(round_)
    second = pair(second).join(done, ["a", "b"], "left_anti")
    forget(docs.sparkSession)
    links = links.unionByName(verified(plausible(second, sets, percent), texts, n, percent)).unionByName(member)
    final = components(links)
    return sets.join(final, sets["doc_id"] == final["node"], "left").select("doc_id", F.col("size").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def without_copies(docs: DataFrame, n: int = 3, percent: int = 90, classes: int = CLASSES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, of one document of each group: the one with the smallest key.

    Rows with a null key, and those whose text has no words, stay.  Rows that repeat a key are one
    document and stay or go together.  Only the keys that go are joined with the texts.  Columns of any
    name pass through.  Empty table: no rows.
    """
    groups = jaccard_components(docs.select(key, text), n, percent, classes, key=key, text=text)
    gone = groups.where("doc_id != component_id").select(F.col("doc_id").alias(key)).distinct()
    return docs.join(gone, key, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
