"""Line dedup that returns compressed keep bitmaps instead of text.

Long lines become rows of a 128-bit hash, document and position, range-partitioned
and sorted by all of these, so that a stream over a partition meets each hash's
documents in ascending order.  A hash inside one partition is decided there; of a
hash that reaches a partition's first or last row, the stream returns partial
counts, which meet in a table of at most two rows a partition.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wedgeworks.llm.common import materialise, shuffle_partitions

MIN_POINTS = 20
MIN_DOCUMENTS = 3
#: Rows of one hash that a task holds; those of a longer run are passed on undecided.
BATCH = 1 << 16


def line_key(line: bytes) -> bytes:
    """Stripped of space and \\t\\n\\v\\f\\r at both ends, A-Z lower-cased (bytes methods do just that)."""
    return line.strip().lower()


def points(raw: bytes) -> int:
    return len(raw) if raw.isascii() else len(raw) - sum(map(_TAIL.__contains__, raw))


_TAIL = frozenset(range(0x80, 0xC0))


def _extract(parts):
    for part in parts:
        h1, h2, row, at = [], [], [], []
        for i, text in enumerate(part.column(1).to_pylist()):
            for j, line in enumerate(text.split(b"\n")):
                key = line_key(line)
                if len(key) >= MIN_POINTS and points(key) >= MIN_POINTS:
                    d = xxhash.xxh3_128_intdigest(key)
                    h1.append((d >> 64) - (1 << 63))
                    h2.append((d & (1 << 64) - 1) - (1 << 63))
                    row.append(i)
                    at.append(j)
        doc = part.column(0).take(pa.array(row, pa.int64()))
        text_hash = part.column(2).take(pa.array(row, pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), doc, text_hash, pa.array(at, pa.int32())], ["h1", "h2", "doc_id", "text_hash", "at"])


def _comparable(doc: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a key column, and where it is null.  Integers stay integers: as floats, large ones would be equal."""
    nulls = doc.is_null().to_numpy(zero_copy_only=False)
    return (doc.fill_null(0) if pa.types.is_integer(doc.type) else doc).to_numpy(zero_copy_only=False), nulls


def _changes(doc: pa.Array) -> np.ndarray:
    """Where a document differs from the one before it; True at the first."""
    value, nulls = _comparable(doc)
    new = np.ones(len(doc), bool)
    new[1:] = ((value[1:] != value[:-1]) & ~(nulls[1:] & nulls[:-1])) | (nulls[1:] != nulls[:-1])
    return new


def _decide(min_documents: int, batch: int = BATCH):
    """Stream of one sorted partition: lines to drop for sure, and those of hashes that it can't decide.

    kind 0: drop the line (doc_id, text_hash, at).  1: undecided line.  2: what the partition knows of the hash of
    undecided lines: ``n`` documents here, greatest one ``doc_id``.  Undecided are the first and the last hash of the
    partition, whose rows may go on in others, and hashes of more than ``batch`` rows, which are not held in memory.
    """

    def run(parts):
        columns = ["h1", "h2", "doc_id", "text_hash", "at"]
        held: list[pa.RecordBatch] = []  # rows of the open hash
        passed, last = 0, None  # of its rows passed on: documents, and a slice with the last row

        def out(kind, h1, h2, doc, text_hash, at, n):
            return pa.RecordBatch.from_arrays([pa.array(kind, pa.int8()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), doc, text_hash, pa.array(at, pa.int32()), pa.array(n, pa.int64())], ["kind", *columns, "n"])

        def pass_on():
            nonlocal held, passed, last
            for t in held:
                new, size = _changes(t.column("doc_id")), t.num_rows
                if last is not None and last.column("doc_id")[0].as_py() == t.column("doc_id")[0].as_py():
                    new[0] = False
                passed, last = passed + int(new.sum()), t.slice(size - 1)
                yield out(np.ones(size, np.int8), t.column("h1"), t.column("h2"), t.column("doc_id"), t.column("text_hash"), t.column("at"), np.zeros(size, np.int64))
            held = []

        def close(edge):
            """The open hash has no more rows here."""
            nonlocal held, passed, last
            if edge or passed:
                yield from pass_on()
                yield out([2], last.column("h1"), last.column("h2"), last.column("doc_id"), last.column("text_hash"), [0], [passed])
            elif held:
                yield from _whole(pa.Table.from_batches(held).combine_chunks().to_batches()[0], min_documents, out)
            held, passed, last = [], 0, None

        first, open_ = True, None
        for part in parts:
            if not part.num_rows:
                continue
            h1, h2 = part.column("h1").to_numpy(), part.column("h2").to_numpy()
            cuts = np.flatnonzero((h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])) + 1
            if open_ not in (None, (h1[0], h2[0])):
                yield from close(first)
                first = False
            open_ = (h1[-1], h2[-1])
            if len(cuts):
                held.append(part.slice(0, cuts[0]))
                yield from close(first)
                first = False
                yield from _whole(part.slice(cuts[0], cuts[-1] - cuts[0]), min_documents, out)
                part = part.slice(cuts[-1])
            held.append(part)
            if sum(x.num_rows for x in held) > batch:
                yield from pass_on()
        if open_ is not None:
            yield from close(True)

    return run


def _whole(t: pa.RecordBatch, min_documents: int, out):
    """Decide many complete hashes at once."""
    if not t.num_rows:
        return
    h1, h2 = t.column("h1").to_numpy(), t.column("h2").to_numpy()
    doc = t.column("doc_id")
    start = np.ones(len(h1), bool)
    start[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    new = start | _changes(doc)
    group = np.cumsum(start) - 1
    number = np.bincount(group, weights=new).astype(np.int64)
    seen = np.cumsum(new) - np.concatenate([[0], np.cumsum(number)[:-1]])[group]
    gone = np.flatnonzero((number[group] >= min_documents) & (seen < number[group]))
    take = pa.array(gone)
    yield out(np.zeros(len(gone), np.int8), h1[gone], h2[gone], doc.take(take), t.column("text_hash").take(take), t.column("at").to_numpy()[gone], np.zeros(len(gone), np.int64))


def dropped_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_documents: int = MIN_DOCUMENTS, partitions: int | None = None, batch: int = BATCH) -> DataFrame:
    """Lines to drop: doc_id, text_hash (xxhash64 of the text), at (line number from 0).

    Lines whose key (see ``line_key``) has at least MIN_POINTS code points and is found in at least
    ``min_documents`` documents go, but for those in the largest doc_id that holds it.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("doc_id"), F.col(text).cast("binary").alias("_text"), F.xxhash64(text).alias("text_hash"))
    lines = rows.mapInArrow(_extract, f"h1 long, h2 long, doc_id {kind}, text_hash long, at int")
    n = partitions or shuffle_partitions(docs.sparkSession)
    order = ["h1", "h2", "doc_id", "text_hash", "at"]
    # a range ends between documents, so that each document of a hash is in one partition
    dealt = lines.repartitionByRange(n, "h1", "h2", "doc_id").sortWithinPartitions(*order)
    found = materialise(dealt.mapInArrow(_decide(min_documents, batch), f"kind byte, h1 long, h2 long, doc_id {kind}, text_hash long, at int, n long"))
    sure = found.where("kind = 0").select("doc_id", "text_hash", "at")
    # at most two hashes a partition reach its edges, and one more for each `batch` rows is longer
    edges = found.where("kind = 2").groupBy("h1", "h2").agg(F.sum("n").alias("_n"), F.max("doc_id").alias("_last")).where(F.col("_n") >= min_documents)
    rest = found.where("kind = 1").join(F.broadcast(edges), ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("_last")))
    return sure.unionByName(rest.select("doc_id", "text_hash", "at"))


def _pack(at: list[int]) -> bytes:
    """Compressed bitmap of the lines that go; lines after its last bit stay."""
    bits = np.zeros(max(at) + 1, np.uint8)
    bits[at] = 1
    return zlib.compress(np.packbits(bits).tobytes(), 6)


def drop_bitmaps(docs: DataFrame, **options) -> DataFrame:
    """doc_id, text_hash, bitmap, for the documents that lose lines.  See ``unpack`` and ``dropped_lines``.

    Null and empty texts: one empty line, which stays.  Null doc_id: a document of its own,
    smallest of all.  Rows that repeat a doc_id count as one document; those with equal text have
    one bitmap.  A text's lines are in memory at a time, however many.  Empty table: no rows.  Other
    columns are ignored, whatever their names.
    """
    gone = dropped_lines(docs, **options)
    kind = gone.schema["doc_id"].dataType.simpleString()
    lists = gone.groupBy("doc_id", "text_hash").agg(F.collect_set("at").alias("_at"))  # bounded by a document's lines

    def run(parts):
        for part in parts:
            maps = [_pack(x) for x in part.column("_at").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array(maps, pa.binary())], ["doc_id", "text_hash", "bitmap"])

    return lists.mapInArrow(run, f"doc_id {kind}, text_hash long, bitmap binary")


def unpack(bitmap: bytes | None, lines: int) -> np.ndarray:
    """Mask of the lines that stay."""
    keep = np.ones(lines, bool)
    if bitmap:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))[:lines]
        keep[: len(bits)] = bits == 0
    return keep


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per input row, from its bitmap: doc_id, n_lines, n_dropped, kept_sha256, bitmap."""
    kind = docs.schema[key].dataType.simpleString()
    maps = drop_bitmaps(docs, key=key, text=text, **options).select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"), "bitmap")
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"))
    joined = rows.join(maps, rows["doc_id"].eqNullSafe(maps["_d"]) & (rows["text_hash"] == maps["_h"]), "left").select("doc_id", F.col("_text").cast("binary").alias("_text"), "bitmap")

    def run(parts):
        for part in parts:
            total, gone, digest = [], [], []
            for raw, bitmap in zip(part.column("_text").to_pylist(), part.column("bitmap").to_pylist(), strict=True):
                lines = raw.split(b"\n")
                total.append(len(lines))
                if bitmap:
                    keep = unpack(bitmap, len(lines))
                    raw = b"\n".join(x for x, k in zip(lines, keep, strict=True) if k)
                    gone.append(int(len(lines) - keep.sum()))
                else:
                    gone.append(0)
                digest.append(hashlib.sha256(raw).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest), part.column("bitmap")], ["doc_id", "n_lines", "n_dropped", "kept_sha256", "bitmap"])

    return joined.mapInArrow(run, f"doc_id {kind}, n_lines long, n_dropped long, kept_sha256 string, bitmap binary")
