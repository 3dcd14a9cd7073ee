"""Token ids in frequency-ranked, byte-aligned variable-length coding.

Ids are ranked by their count over all documents, so that frequent ids take one
byte.  A document's ranks are written as one to four bytes each, lowest first;
the lengths, less one, are two bits each in control bytes of their own.  Decoding
looks the control bytes up in a table and needs no loop over ids.

A set of files is a Parquet folder, written by Spark (any store, committed by
task, so lost executors do no harm), in ascending order of document: doc_id,
part, start (in its part), n_tokens, control, data; beside it ``parts``, the first
id of each part, and ``ranks``, the ids in order of rank.
"""

from __future__ import annotations

import json
import math
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from wedgeworks.llm.common import checkpoint_dir, mix64, release, shuffle_partitions

END = 2
#: Pieces of text kept in a worker's memory with their ids, and pieces looked up at a time.
MEMO, STEP = 1_500_000, 1 << 18
#: Bytes of text, and ids, that a worker turns at a time, but for longer documents.
TEXT_BYTES, IDS = 1 << 20, 1 << 18
#: Bytes of the longest piece that is packed into a key, and of the longest that is kept.
KEY, KEPT = 15, 64

#: By control byte: the four lengths, and their sum.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.int64) + 1
SUMS = LENGTHS.sum(1)


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The ranges starts[i], .., starts[i] + counts[i] - 1, one after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + counts, counts)


def encode_ranks(ranks: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Control bytes and data bytes of unsigned 32-bit ranks, ``counts`` of them in each document, and the number of each
    document's control bytes and data bytes."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    size = 1 + (ranks > 0xFF).view(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    quads = -(-counts // 4)
    codes = np.zeros(int(quads.sum()) * 4, np.uint8)
    codes[spread(4 * (np.cumsum(quads) - quads), counts)] = size - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    done = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    return control, ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]], quads, np.diff(done[np.concatenate([[0], np.cumsum(counts)])])


def decode_ranks(control: np.ndarray, data: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The ranks that ``encode_ranks`` took, from its control and data bytes."""
    quads = -(-counts // 4)
    if int(quads.sum()) != len(control):
        raise ValueError(f"{len(control)} control bytes do not match {int(counts.sum())} ids")
    size = LENGTHS[control].ravel()[spread(4 * (np.cumsum(quads) - quads), counts)]
    if int(size.sum()) != len(data):
        raise ValueError(f"{len(data)} data bytes do not match the control bytes of {len(size)} ids")
    out = np.zeros((len(size), 4), np.uint8)
    out[np.arange(4) < size[:, None]] = data
    return out.view("<u4").ravel()


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a column of texts or binaries without nulls."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]], at - at[0]


def binary(data: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A column of binaries from their bytes, one after another."""
    at = np.concatenate([[0], np.cumsum(counts)])
    kind, offsets = (pa.binary(), np.int32) if at[-1] < 1 << 31 else (pa.large_binary(), np.int64)
    return pa.Array.from_buffers(kind, len(counts), [None, pa.py_buffer(at.astype(offsets)), pa.py_buffer(np.ascontiguousarray(data))])


def slices(parts, weight, most: int):
    """Arrow batches cut where the weights of their rows, from ``weight`` (batch), come to ``most``."""
    for part in parts:
        done, i = np.concatenate([[0], np.cumsum(weight(part))]), 0
        while i < part.num_rows:
            j = max(i + 1, int(np.searchsorted(done, done[i] + most, "right")) - 1)
            yield part.slice(i, j - i)
            i = j


#: Classes of bytes: the space, other white space, letters, digits, ASCII marks, the apostrophe, and all that is not certain.
SPACE, BREAK, LETTER, DIGIT, MARK, QUOTE, OTHER = range(7)


def _classes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The class of each byte; whether it leads two bytes that are a letter (U+00C0 to U+017F, two signs apart, and
    U+0400 to U+047F); and by the classes of two bytes whether a piece begins between them: 0, 1, or 2 if the byte after tells."""
    kinds = np.full(256, OTHER, np.uint8)
    kinds[33:127] = MARK
    kinds[[*range(65, 91), *range(97, 123)]] = LETTER
    kinds[48:58], kinds[9:14], kinds[32], kinds[39] = DIGIT, BREAK, SPACE, QUOTE
    leads = np.zeros(256, bool)
    leads[[0xC3, 0xC4, 0xC5, 0xD0, 0xD1]] = True
    kinds[leads] = LETTER
    cuts = np.zeros((8, 8), np.uint8)
    solid = [LETTER, DIGIT, MARK, QUOTE]
    for x in solid:
        cuts[x, [*solid, SPACE, BREAK]] = 1
        cuts[x, x] = 0
        cuts[BREAK, x] = 1
    cuts[MARK, QUOTE] = cuts[QUOTE, MARK] = cuts[QUOTE, LETTER] = 0
    for x in (SPACE, BREAK):
        cuts[[SPACE, BREAK], x] = 2
    return kinds, leads, cuts.ravel()


KINDS, LEADS, CUTS = _classes()
SOLID = np.isin(np.arange(8), (LETTER, DIGIT, MARK, QUOTE))
#: The bytes of a word of eight that belong to a piece, by their number.
MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def cut(data: np.ndarray, at: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Where pieces begin in the texts ``data`` (offsets ``at``); ``whole`` tells the texts that are not cut.

    A byte-level tokenizer looks for runs of letters, of digits or of marks, each with a space before it, for an
    apostrophe with some letters, and for white space, of which the last before a word is apart.  A piece begins only
    where every such tokenizer's token does; next to a byte that is not certain none begins.
    """
    kinds = KINDS[data]
    lead = np.flatnonzero(LEADS[data[:-1]])
    kinds[lead + 1] = LETTER
    sign = lead[(data[lead] == 0xC3) & ((data[lead + 1] == 0x97) | (data[lead + 1] == 0xB7))]
    kinds[sign] = kinds[sign + 1] = OTHER
    begins = np.zeros(len(data) + 1, np.uint8)
    begins[1:-1] = CUTS[kinds[:-1] << 3 | kinds[1:]]
    begins[at] = 3  # a text's first byte, and the end of the text before
    run = np.flatnonzero(begins == 2)
    begins[run] = SOLID[kinds[np.minimum(run + 1, len(data) - 1)]] & (begins[run + 1] != 3)
    for i in np.flatnonzero(whole):
        begins[at[i] + 1 : at[i + 1]] = 0
    return np.flatnonzero(begins[:-1])


class Encoder:
    """Ids of texts by the tokenizers library.

    The ids of a text's pieces, in the library's words, make up those of the text.  So each different piece goes to the
    library once and is kept; pieces are looked up by their bytes, many at a time.  A text with the literal of an added
    token goes to the library whole, as does every text of another kind of tokenizer.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_file(path)
        tool = self.tool
        before = json.loads(tool.pre_tokenizer.__getstate__()) if tool.pre_tokenizer else {}
        plain = tool.normalizer is None and tool.truncation is None and tool.padding is None
        self.cuts = plain and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
        added = tool.get_added_tokens_decoder()
        literals = [re.escape(t.content.encode()) for t in added.values() if t.content]
        self.added = re.compile(b"|".join(literals)) if literals else None
        top = max([END, *tool.get_vocab(with_added_tokens=True).values()])
        #: Ids are stored so until they have their ranks.
        self.kind = "<u2" if top < 1 << 16 else "<u4"
        self.clear()

    def clear(self, room: int = 1 << 16) -> None:
        """Pieces by number: two words of their bytes, the place and number of their ids, whether they were looked up again.
        The first stands for a document's end."""
        self.n, self.used, self.far = 1, 1, {}
        self.keys = np.zeros((room, 2), np.uint64)
        self.keys[0] = ~np.uint64(0)
        self.at, self.many, self.again = np.zeros(room, np.int64), np.ones(room, np.int32), np.zeros(room, bool)
        self.ids = np.full(4 * room, END, "<u4")
        self._index(2 * room)

    def _index(self, room: int) -> None:
        self.bits = max(10, math.ceil(math.log2(room)))
        self.places = np.full(1 << self.bits, -1, np.int32)
        for i in range(0, self.n, STEP):
            self._place(np.arange(i, min(self.n, i + STEP)))

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return (mix64(keys[:, 0] ^ mix64(keys[:, 1])) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _place(self, some: np.ndarray) -> None:
        """Enters pieces that are all different and not yet there."""
        at = self._hash(self.keys[some])
        while len(some):
            free = self.places[at] < 0
            self.places[at[free]] = some[free]  # of several, the last stays
            left = self.places[at] != some
            some, at = some[left], at[left] + 1 & (1 << self.bits) - 1

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The numbers of pieces, or -1."""
        at = self._hash(keys)
        found = self.places[at]
        left = np.flatnonzero((found >= 0) & (self.keys[found] != keys).any(1))
        while len(left):
            at[left] = at[left] + 1 & (1 << self.bits) - 1
            found[left] = self.places[at[left]]
            new = found[left]
            left = left[(new >= 0) & (self.keys[new] != keys[left]).any(1)]
        return found

    def _forget(self) -> None:
        """Keeps the pieces that were met again, if they are not too many."""
        old, keep = (self.keys, self.at, self.many, self.ids), np.flatnonzero(self.again[: self.n])
        keep = keep[keep > 0]
        self.clear()
        if len(keep) <= MEMO // 2:
            keys, at, many, ids = old
            self._add(keys[keep], many[keep], ids[spread(at[keep], many[keep].astype(np.int64))])

    def _add(self, keys: np.ndarray, many: np.ndarray, ids: np.ndarray) -> np.ndarray:
        some = np.arange(self.n, self.n + len(keys))
        if some[-1:].size and some[-1] >= len(self.keys):
            more = max(len(self.keys), len(keys))
            self.keys = np.concatenate([self.keys, np.zeros((more, 2), np.uint64)])
            self.at, self.many, self.again = (np.concatenate([x, np.zeros(more, x.dtype)]) for x in (self.at, self.many, self.again))
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(ids)), "<u4")])
        ends = np.cumsum(many, dtype=np.int64)
        self.keys[some], self.many[some], self.at[some] = keys, many, self.used + ends - many
        self.ids[self.used : self.used + len(ids)] = ids
        self.n, self.used = self.n + len(keys), self.used + len(ids)
        if 2 * self.n > len(self.places):
            self._index(2 * len(self.keys))
        else:
            self._place(some)
        return some

    def _library(self, texts: list[bytes]) -> list[list[int]]:
        return [x.ids for x in self.tool.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def _encode(self, words: np.ndarray, data: bytes, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, and the number of each one's; size -1 is a document's end."""
        if self.n > MEMO:
            self._forget()
        near = sizes <= KEY
        keys = np.empty((len(starts), 2), np.uint64)
        keys[:, 0] = words[starts] & MASKS[np.clip(sizes, 0, 8)]
        keys[:, 1] = words[starts + 8] & MASKS[np.clip(sizes - 8, 0, 8)] | sizes.astype(np.uint64) << np.uint64(56)
        keys[sizes < 0] = ~np.uint64(0)
        keys[~near] = ~np.uint64(0)  # for now as an end
        found = self._find(keys)
        missing = np.flatnonzero(found < 0)
        self.again[found[found >= 0]] = True
        if len(missing):
            order = missing[np.lexsort(keys[missing].T)]
            new = np.concatenate([[True], (keys[order[1:]] != keys[order[:-1]]).any(1)])
            first = order[new]
            ids: list[list[int]] = []
            for i in range(0, len(first), 10_000):
                some = first[i : i + 10_000]
                ids += self._library([data[a : a + n] for a, n in zip(starts[some].tolist(), sizes[some].tolist(), strict=True)])
            added = self._add(keys[first], np.array([len(x) for x in ids], np.int32), np.array([y for x in ids for y in x], "<u4"))
            found[order] = added[np.cumsum(new) - 1]
        many = self.many[found].astype(np.int64)
        far = np.flatnonzero(~near)
        if not len(far):
            return self.ids[spread(self.at[found], many)], many
        texts = [data[a : a + n] for a, n in zip(starts[far].tolist(), sizes[far].tolist(), strict=True)]
        lacking = list({t for t in texts if t not in self.far})
        got = {}
        for i in range(0, len(lacking), 1000):
            some = lacking[i : i + 1000]
            got |= zip(some, (np.array(x, "<u4") for x in self._library(some)), strict=True)
        of = [got[t] if t in got else self.far[t] for t in texts]
        if len(self.far) > MEMO // 16:
            self.far.clear()
        self.far |= {t: x for t, x in got.items() if len(t) <= KEPT}
        many[far] = [len(x) for x in of]
        out, own = np.empty(int(many.sum()), "<u4"), np.cumsum(many) - many
        out[spread(own[near], many[near])] = self.ids[spread(self.at[found[near]], many[near])]
        out[spread(own[far], many[far])] = np.concatenate(of)
        return out, many

    def __call__(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts (bytes and offsets), each followed by END, and the number of each one's, END included."""
        raw = data.tobytes()
        whole = np.full(len(at) - 1, not self.cuts)
        if self.cuts and self.added and self.added.search(raw):
            whole[:] = [bool(self.added.search(raw[a:b])) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        starts = cut(data, at, whole) if len(data) else np.zeros(0, np.int64)
        sizes = np.diff(starts, append=len(data))
        # a document's end goes after its pieces
        ends = np.searchsorted(starts, at[1:]) + np.arange(len(at) - 1)
        every = np.zeros(len(starts) + len(ends), np.int64)
        length = np.full(len(every), -1, np.int64)
        piece = np.ones(len(every), bool)
        piece[ends] = False
        every[piece], length[piece] = starts, sizes
        words = np.ndarray((len(raw) + 9,), "<u8", raw + bytes(16), strides=(1,))
        found = [self._encode(words, raw, every[i : i + STEP], length[i : i + STEP]) for i in range(0, len(every), STEP)]
        ids, many = (np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found, strict=True) if found else ((), ())))
        done = np.concatenate([[0], np.cumsum(many)])[ends + 1] if len(ends) else np.zeros(0, np.int64)
        return ids.astype("<u4", copy=False), np.diff(done, prepend=0)


#: The encoder that this worker has in use, by tokenizer and set of files: workers go from task to task, and what one
#: keeps serves all tasks of a set, but no other set.
_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(tokenizer: str, path: str) -> Encoder:
    if (tokenizer, path) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[tokenizer, path] = Encoder(tokenizer)
    return _ENCODERS[tokenizer, path]


def let_go() -> None:
    """Frees the worker's encoder, which later steps don't need."""
    if _ENCODERS:
        _ENCODERS.clear()
        release()


def _tokenize(tokenizer: str, path: str, kind: pa.DataType):
    """Rows (doc_id, _tie, n_tokens, ids, counts); a task's last row has no document but how often it met each id."""

    def run(parts):
        encode, total = encoder(tokenizer, path), np.zeros(0, np.int64)
        names = ["doc_id", "_tie", "n_tokens", "ids", "counts"]
        for some in slices(parts, lambda part: np.diff(flat(part.column("_text"))[1]) + 1, TEXT_BYTES):
            ids, many = encode(*flat(some.column("_text")))
            found = np.bincount(ids, minlength=len(total))
            found[: len(total)] += total
            total = found
            plain = ids.astype(encode.kind)
            columns = [some.column("doc_id"), some.column("_tie"), pa.array(many, pa.int64()), binary(plain.view(np.uint8), many * plain.itemsize), pa.nulls(len(many), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), *(pa.nulls(1, x) for x in (pa.int64(), pa.int64(), pa.binary())), pa.array([total.tobytes()], pa.binary())], names)

    return run


def _plain(data: np.ndarray, n: int) -> np.ndarray:
    """Ids as ``_tokenize`` stored them: two or four bytes each."""
    return data.view("<u2" if len(data) == 2 * n else "<u4")


def _count(parts):
    total = np.zeros(0, np.int64)
    for part in parts:
        for row in part.column("counts").to_pylist():
            found = np.frombuffer(row, np.int64).copy()
            total, found = (total, found) if len(total) >= len(found) else (found, total)
            total[: len(found)] += found
    ids = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), pa.array(total[ids])], ["id", "n"])


def _lengths(part: pa.RecordBatch) -> np.ndarray:
    return part.column("n_tokens").to_numpy(zero_copy_only=False).astype(np.int64)


def write(docs: DataFrame, tokenizer: str, path: str, key: str = "doc_id", text: str = "text") -> None:
    """Encode all texts and write the set of files at ``path``.

    Each document gets the ids of its whole text, then END.  Null or empty text: END alone.  Null
    key: first in order.  Repeated keys: one entry per row, ties by a hash of the text.  Empty
    table: an empty set.  Other columns are ignored.  The rank table has one row per id in use,
    so it is bounded by the vocabulary; only it is sent to all executors.

    Ids are exchanged once, by range of key; a block's start counts from its part's first id.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_tie"))
    coded = rows.mapInArrow(_tokenize(tokenizer, path, to_arrow_type(docs.schema[key].dataType)), f"doc_id {kind}, _tie long, n_tokens long, ids binary, counts binary")
    # a number of the row tells apart rows alike in key and text, so that many of them spread over parts
    coded.withColumn("_row", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(f"{path}/plain")
    coded = spark.read.parquet(f"{path}/plain")
    counts = coded.where("counts is not null").select("counts").mapInArrow(_count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    coded = coded.where("counts is null").drop("counts")
    order = [r["id"] for r in sorted(counts.collect(), key=lambda r: (-r["n"], r["id"]))]  # one row per id of the vocabulary
    by_rank = np.array(order, np.int64)
    rank = np.zeros(int(by_rank.max(initial=0)) + 1, "<u4")
    rank[by_rank] = np.arange(len(by_rank))
    ranks = spark.sparkContext.broadcast(rank.tobytes())

    def recode(parts):
        let_go()
        table, at = np.frombuffer(ranks.value, "<u4"), 0
        for part in slices(parts, _lengths, IDS):
            n = _lengths(part)
            control, data, quads, size = encode_ranks(table[_plain(flat(part.column("ids"))[0], int(n.sum()))], n)
            start = np.cumsum([at, *n])
            at = int(start[-1])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("part"), pa.array(start[:-1]), part.column("n_tokens"), binary(control, quads), binary(data, size)], ["doc_id", "part", "start", "n_tokens", "control", "data"])

    placed = coded.repartitionByRange(shuffle_partitions(spark), "doc_id", "_tie", "n_tokens", "_row").sortWithinPartitions("doc_id", "_tie", "n_tokens", "_row")
    placed = placed.select("doc_id", F.spark_partition_id().alias("part"), "n_tokens", "ids")
    placed.mapInArrow(recode, f"doc_id {kind}, part int, start long, n_tokens long, control binary, data binary").write.mode("overwrite").option("compression", "none").parquet(f"{path}/blocks")
    parts = spark.read.parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")).coalesce(1).write.mode("overwrite").parquet(f"{path}/parts")  # a row per part
    spark.createDataFrame([(i, int(x)) for i, x in enumerate(order)], "rank long, id long").coalesce(1).write.mode("overwrite").parquet(f"{path}/ranks")
    drop(spark, f"{path}/plain")


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder of any store that Spark writes to."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian unsigned 32-bit), one row per document."""
    order = [r["id"] for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()]  # bounded by the vocabulary
    ids = spark.sparkContext.broadcast(np.array(order, "<u4").tobytes())
    blocks = spark.read.parquet(f"{path}/blocks")
    kind = blocks.schema["doc_id"].dataType.simpleString()
    firsts = {r["part"]: r["first"] for r in spark.read.parquet(f"{path}/parts").collect()}  # a row per part of the files

    def run(parts):
        table = np.frombuffer(ids.value, "<u4")
        for part in slices(parts, _lengths, IDS):
            n = _lengths(part)
            got = table[decode_ranks(flat(part.column("control"))[0], flat(part.column("data"))[0], n)]
            start = [firsts[p] + s for p, s in zip(part.column("part").to_pylist(), part.column("start").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(start, pa.int64()), part.column("n_tokens"), binary(got.view(np.uint8), 4 * n)], ["doc_id", "start", "n_tokens", "ids"])

    return blocks.mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids binary")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared checkpoint folder."""
    import uuid

    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def checksums(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def crc(ids: bytes) -> int:
    return zlib.crc32(ids)
