"""Suffix-array dedup: bytes covered by a long string that an earlier document also holds.

Every string of LENGTH bytes is assigned to the least of its k-byte pieces under a
hash order (its anchor), so equal strings have equal anchors, at the same offset.
Documents are packed in buckets.  A first exchange sends hashes of anchors and
finds those of more than one text.  A second one sends, for these alone, the bytes
around the anchor; there the strings of an anchor and offset are suffix-sorted,
and the smallest document of each string is found.  What comes back to a bucket is
one bit for each string, and its own note of where its contexts lie, so that the
last step hashes nothing again.

An exchange has at most one entry for each bucket and content, whatever number of
documents of the bucket share it, and exact copies of a text are one document.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wedgeworks.llm.common import mix64, release, total_bytes
from wedgeworks.llm.suffixes import Hashes, sort_within, words

LENGTH, PIECE = 50, 20
#: Bytes of text in a bucket; buckets that small inputs get nevertheless, and the bytes for which one more pays.
BUCKET_BYTES, BUCKETS, LEAST_BYTES = 8 << 20, 64, 1 << 20
#: Bytes of text that are hashed at a time: their arrays stay in a core's cache.
BUFFER_BYTES = 1 << 16
#: Bytes of an anchor's hash in the first exchange; hashes that collide there only send more to the second.
SHORT = 5
NULL = -(1 << 63)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    done = 1
    while 2 * done <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    return np.minimum(values[: len(values) - (width - done)], values[width - done :]) if width > done else values


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The ranges starts[i], .., starts[i] + counts[i] - 1, one after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + counts, counts)


class Texts:
    """Different texts of a bucket, one after another in ``raw``, in ascending order of their smallest document."""

    def __init__(self, rows: pa.Table):
        text: dict[bytes, bytes] = {}
        doc: dict[bytes, int] = {}
        for sha, d, t in zip(rows.column("sha").to_pylist(), rows.column("doc").to_pylist(), rows.column("text").to_pylist(), strict=True):
            if t is not None:
                text[sha] = t
            if d is not None:
                doc[sha] = min(d, doc.get(sha, d))
        self.sha = sorted(text, key=lambda s: (doc[s], s))
        self.doc = np.array([doc[s] for s in self.sha], np.int64)
        self.edges = np.cumsum([0, *(len(text[s]) for s in self.sha)])
        self.raw = np.frombuffer(b"".join([text[s] for s in self.sha]), np.uint8)


class Anchors:
    """Anchors of a bucket in order of place: hash; text; first and last string (as starts in ``raw``); place of the anchor."""

    def __init__(self, texts: Texts):
        found = [self._of(texts, at) for at in range(0, len(texts.raw) - LENGTH + 1, BUFFER_BYTES)]
        empty = np.zeros(0, np.int64)
        self.hash, self.text, self.low, self.high, self.at = map(np.concatenate, zip((empty.astype(np.uint64), *[empty] * 4), *found, strict=True))

    @staticmethod
    def _of(texts: Texts, begin: int):
        """Of the strings that start from ``begin`` on, up to a buffer's bytes."""
        part = texts.raw[begin : begin + BUFFER_BYTES + LENGTH - 1]
        hashes, n = Hashes(part), len(part) - PIECE + 1
        pieces = mix64((hashes.prefix[PIECE:] - hashes.prefix[:n]) * hashes.back[:n])
        packed = (pieces >> np.uint64(24) << np.uint64(24)) | np.arange(n, dtype=np.uint64)
        packed = _least(packed, LENGTH - PIECE + 1)
        # runs of strings of one anchor end where it changes, where a text begins and where too little of a text is left
        texts_here = texts.edges[np.searchsorted(texts.edges, begin) : np.searchsorted(texts.edges, begin + len(part), "right")] - begin
        cut = np.concatenate([[0], np.flatnonzero(packed[1:] != packed[:-1]) + 1, texts_here, texts_here - LENGTH + 1])
        low = np.unique(cut[(cut >= 0) & (cut < len(packed))])
        high = np.append(low[1:], len(packed)) - 1
        text = np.searchsorted(texts.edges, low + begin, "right") - 1
        inside = low + begin + LENGTH <= texts.edges[text + 1]
        low, high, text = low[inside], high[inside], text[inside]
        at = (packed[low] & np.uint64((1 << 24) - 1)).astype(np.int64)
        return pieces[at], text, low + begin, high + begin, at + begin


assert BUFFER_BYTES + LENGTH < 1 << 24


def _alike(raw: np.ndarray, at: np.ndarray, size: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by content, and which elements of it are equal to the one before, byte for byte.

    Contents are ``size`` bytes from ``at`` on, LENGTH at least, and the values of ``more``.
    """
    view, last = words(raw), at + size
    # eight bytes each, from the start and from the end, meet in the middle
    places = [at + o for o in range(0, LENGTH - 7, 8)] + [last - o for o in range(8, MOST - LENGTH // 8 * 8 + 8, 8)]
    parts = [x.astype(np.uint64) for x in (*(view[p] for p in places), size, *more)]
    mixed = np.zeros(len(at), np.uint64)
    for x in parts:
        mixed = mix64(mixed ^ x)
    order = np.argsort(mixed, kind="stable")
    same = np.ones(len(at), bool)
    same[:1] = False
    for x in parts:
        x = x[order]
        same[1:] &= x[1:] == x[:-1]
    return order, same


#: Bytes of the longest context: an anchor's strings start at most LENGTH - PIECE before it.
MOST = 2 * LENGTH - PIECE


def _to(hashes: np.ndarray, n: int) -> np.ndarray:
    """Places of anchors, by their hashes mixed anew: being minima, these are small."""
    return ((mix64(hashes) >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _short(hashes: np.ndarray) -> np.ndarray:
    return hashes & np.uint64((1 << 8 * SHORT) - 1)


def _pack(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SHORT]).tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // SHORT, 8), np.uint8)
    out[:, :SHORT] = np.frombuffer(raw, np.uint8).reshape(-1, SHORT)
    return out.view("<u8").ravel()


def _distinct(hashes: np.ndarray, owner: np.ndarray, n: int):
    """Distinct (place, short hash) in order, whether several texts hold each, and the number of each hash's."""
    key = _to(hashes, n).astype(np.uint64) << np.uint64(8 * SHORT) | _short(hashes)
    order = np.argsort(key)
    key, owner = key[order], owner[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    head = np.flatnonzero(new)
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    several = np.minimum.reduceat(owner, head) != np.maximum.reduceat(owner, head) if len(head) else np.zeros(0, bool)
    key = key[head]
    return (key >> np.uint64(8 * SHORT)).astype(np.int64), _short(key), several, number


def _cuts(place: np.ndarray):
    head = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else np.zeros(0, np.int64)
    return zip(place[head].tolist(), head.tolist(), np.append(head[1:], len(place)).tolist() if len(head) else [], strict=True)


def _rows(columns: dict[str, list], types: dict[str, pa.DataType]) -> pa.Table:
    return pa.table({k: pa.array(v, types[k]) for k, v in columns.items()})


PLACE = {"place": pa.int64(), "bucket": pa.int64(), "data": pa.binary()}


def _send_hashes(n: int):
    def run(key, rows):
        anchors = Anchors(Texts(rows))
        place, short, several, _ = _distinct(anchors.hash, anchors.text, n)
        out = {"place": [], "bucket": [], "data": []}
        for p, a, b in _cuts(place):
            out["place"].append(p)
            out["bucket"].append(key[0].as_py())
            out["data"].append(_pack(short[a:b]) + np.packbits(several[a:b]).tobytes())
        return _rows(out, PLACE)

    return run


def _entries(data: bytes) -> int:
    """Number of hashes in a message of SHORT bytes each and one bit each."""
    n = len(data) * 8 // (8 * SHORT + 1)
    while n * SHORT + (n + 7) // 8 < len(data):
        n += 1
    return n


def _find_shared(key, rows):
    buckets, parts, flags = rows.column("bucket").to_pylist(), [], []
    for data in rows.column("data").to_pylist():
        n = _entries(data)
        parts.append(_unpack(data[: n * SHORT]))
        flags.append(np.unpackbits(np.frombuffer(data[n * SHORT :], np.uint8))[:n].astype(bool))
    sizes = list(map(len, parts))
    values, several = np.concatenate(parts), np.concatenate(flags)
    order = np.argsort(values)
    twice = np.flatnonzero(values[order[1:]] == values[order[:-1]])
    shared = several.copy()
    shared[order[twice]] = shared[order[twice + 1]] = True
    out = {"place": [], "bucket": [], "data": []}
    for b, a, e in zip(buckets, np.cumsum([0, *sizes]), np.cumsum(sizes), strict=False):
        if shared[a:e].any():
            out["place"].append(key[0].as_py())
            out["bucket"].append(b)
            out["data"].append(np.packbits(shared[a:e]).tobytes())
    return _rows(out, PLACE)


class Contexts:
    """Distinct contexts of a bucket's shared anchors: bytes from the first string's start to the last one's end.

    Per context, in order of place: place, hash, bytes before the anchor, first byte, size, and the first text that has
    it, which is the one of the smallest document.  ``use``: the context of every shared anchor; ``at``: its first byte.
    """

    def __init__(self, texts: Texts, replies: pa.Table, n: int):
        a = Anchors(texts)
        place, _, _, number = _distinct(a.hash, a.text, n)
        flag = np.zeros(len(place), bool)
        by_place = dict(zip(replies.column("place").to_pylist(), replies.column("data").to_pylist(), strict=True))
        for p, begin, end in _cuts(place):
            if p in by_place:
                flag[begin:end] = np.unpackbits(np.frombuffer(by_place[p], np.uint8))[: end - begin].astype(bool)
        pick = np.flatnonzero(flag[number])
        hashes, low, before = a.hash[pick], a.low[pick], a.at[pick] - a.low[pick]
        size = a.high[pick] + LENGTH - low
        order, same = _alike(texts.raw, low, size, hashes, before)
        head = order[~same]  # the first of equal ones in the order of texts, as it is stable
        by = np.argsort(_to(hashes[head], n), kind="stable")
        rank = np.empty(len(head), np.int64)
        rank[by] = np.arange(len(head))
        self.use, self.at = np.empty(len(pick), np.int64), low
        self.use[order] = rank[np.cumsum(~same) - 1]
        head = head[by]
        self.place, self.hash, self.before, self.low, self.size, self.least = _to(hashes[head], n), hashes[head], before[head], low[head], size[head], a.text[pick][head]


HEADER = np.dtype([("hash", "<u8"), ("doc", "<i8"), ("before", "u1"), ("size", "u1")])
assert MOST < 256


def _planes(values: np.ndarray) -> bytes:
    """Unsigned 32-bit values, the lowest bytes of all first."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _note(c: Contexts) -> bytes:
    """What a bucket has to know of its contexts when the answers come."""
    parts = [_planes(np.diff(c.place, prepend=0)), c.size.astype(np.uint8).tobytes(), _planes(c.least), _planes(c.use), _planes(np.diff(c.at, prepend=0))]
    return np.array([len(c.place), len(c.use)], "<i8").tobytes() + zstandard.compress(b"".join(parts), 1)


def _read_note(data: bytes) -> tuple[np.ndarray, ...]:
    """Place, size and first text of each context; context and first byte of each use."""
    n, uses = np.frombuffer(data[:16], "<i8").tolist()
    raw = zstandard.decompress(data[16:])
    at = np.cumsum([0, 4 * n, n, 4 * n, 4 * uses, 4 * uses]).tolist()
    place, size, least, use, first = (raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True))
    return np.cumsum(_from_planes(place)), np.frombuffer(size, np.uint8).astype(np.int64), _from_planes(least), _from_planes(use), np.cumsum(_from_planes(first))


def _send_contexts(n: int):
    """Contexts to their places; and to a place of its own, beyond the n, a bucket's note to itself."""

    def run(key, rows, replies):
        texts = Texts(rows)
        c = Contexts(texts, replies, n)
        bucket = key[0].as_py()
        out = {"place": [], "bucket": [], "data": []}
        tool = zstandard.ZstdCompressor(level=3)
        head = np.zeros(len(c.place), HEADER)
        head["hash"], head["doc"], head["before"], head["size"] = c.hash, texts.doc[c.least], c.before, c.size
        for p, a, b in _cuts(c.place):
            out["place"].append(p)
            out["bucket"].append(bucket)
            out["data"].append((b - a).to_bytes(4, "little") + tool.compress(head[a:b].tobytes() + texts.raw[_spread(c.low[a:b], c.size[a:b])].tobytes()))
        if len(c.use):
            out["place"].append(n + bucket)
            out["bucket"].append(bucket)
            out["data"].append(_note(c))
        return _rows(out, PLACE)

    return run


def earlier_strings(head: np.ndarray, start: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """For each context, bits of its strings (from its start) that also are in a context of a smaller document."""
    size = head["size"].astype(np.int64)
    # contexts of the same content: only the one of the smallest document is compared with others
    by_doc = np.argsort(head["doc"], kind="stable")
    order, same = _alike(raw, start[by_doc], size[by_doc], head["hash"][by_doc], head["before"][by_doc])
    order = by_doc[order]
    lead = order[~same]
    leader = np.empty(len(order), np.int64)
    leader[order] = lead[np.cumsum(~same) - 1]
    # anchors with a single content need no sort
    _, back, many = np.unique(head["hash"][lead], return_inverse=True, return_counts=True)
    several = many[back] > 1
    work, anchor = lead[several], back[several]
    bits = np.zeros(len(head), np.uint64)
    if len(work):
        count = size[work] - LENGTH + 1
        own = np.repeat(np.arange(len(work)), count)
        offset = _spread(np.zeros(len(work), np.int64), count)
        group = anchor[own] * 64 + head["before"][work][own] - offset
        order, new = sort_within(raw, start[work][own] + offset, group, LENGTH)
        first = np.flatnonzero(new)
        doc = head["doc"][work][own[order]]
        least = np.repeat(np.minimum.reduceat(doc, first), np.diff(np.append(first, len(order))))
        found = order[least < doc]
        np.bitwise_or.at(bits, work[own[found]], np.uint64(1) << offset[found].astype(np.uint64))
    full = (np.uint64(1) << (size - LENGTH + 1).astype(np.uint64)) - np.uint64(1)
    return np.where(head["doc"][leader] < head["doc"], full, bits[leader])


#: Contexts that are sorted at a time, unless one anchor has more.
CONTEXTS = 1 << 14


def _decide(n: int):
    def run(key, rows):
        place, tool, back = key[0].as_py(), zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        if place >= n:  # a bucket's note to itself
            return rows
        heads, datas, buckets = [], [], rows.column("bucket").to_pylist()
        for data in rows.column("data").to_pylist():
            m = int.from_bytes(data[:4], "little")
            raw = tool.decompress(data[4:])
            heads.append(np.frombuffer(raw[: m * HEADER.itemsize], HEADER))
            datas.append(raw[m * HEADER.itemsize :])
        head, raw = np.concatenate(heads), np.frombuffer(b"".join(datas), np.uint8)
        size = head["size"].astype(np.int64)
        start = np.cumsum(size) - size
        # a few anchors at a time, each with all of its contexts
        order = np.argsort(head["hash"], kind="stable")
        ranked = head["hash"][order]
        cuts = np.append(np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])), len(order)).tolist()
        bits, begin = np.zeros(len(head), np.uint64), 0
        for here, after in zip(cuts[1:], [*cuts[2:], None]):
            if after is None or after - begin > CONTEXTS:
                some = order[begin:here]
                bits[some] = earlier_strings(head[some], start[some], raw)
                begin = here
        out = {"place": [], "bucket": [], "data": []}
        at = 0
        for b, h in zip(buckets, heads, strict=True):
            some = bits[at : at + len(h)]
            at += len(h)
            if some.any():
                out["place"].append(place)
                out["bucket"].append(b)
                out["data"].append(back.compress(some.astype("<u4").tobytes()))
        return _rows(out, PLACE)

    return run


assert LENGTH - PIECE + 1 <= 32


def _covered(texts: Texts, replies: pa.Table, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, start and end (in ``raw``) of the runs that earlier documents' strings cover, in order."""
    by_place = dict(zip(replies.column("place").to_pylist(), replies.column("data").to_pylist(), strict=True))
    note = next((data for p, data in by_place.items() if p >= n), None)
    if note is None:
        return (np.zeros(0, np.int64),) * 3
    place, size, least, use, at = _read_note(note)
    bits = np.zeros(len(place), np.uint64)
    tool = zstandard.ZstdDecompressor()
    for p, a, b in _cuts(place):
        if p in by_place:
            bits[a:b] = np.frombuffer(tool.decompress(by_place[p]), "<u4")
    text = np.searchsorted(texts.edges, at, "right") - 1
    whole = texts.doc[text] != texts.doc[least[use]]  # a smaller document of the bucket has all of the context
    starts, ends = [at[whole]], [(at + size[use])[whole]]
    own = np.flatnonzero(~whole & (bits[use] != 0))
    for o in range(LENGTH - PIECE + 1):
        some = at[own[bits[use[own]] >> np.uint64(o) & np.uint64(1) != 0]] + o
        starts.append(some)
        ends.append(some + LENGTH)
    starts, ends = np.concatenate(starts), np.concatenate(ends)
    order = np.argsort(starts)
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    text = np.searchsorted(texts.edges, starts, "right") - 1
    new = np.ones(len(starts), bool)
    new[1:] = (starts[1:] > ends[:-1]) | (text[1:] != text[:-1])
    head = np.flatnonzero(new)
    return text[head], starts[head], ends[np.append(head[1:], len(starts))[: len(head)] - 1]


def _finish(n: int):
    """Removed runs of each different text, judged as its smallest document."""

    def run(key, rows, replies):
        texts = Texts(rows)
        text, starts, ends = _covered(texts, replies, n)
        raw = memoryview(texts.raw)
        cuts, base = np.searchsorted(text, np.arange(len(texts.sha) + 1)).tolist(), texts.edges.tolist()
        starts, ends = starts.tolist(), ends.tolist()
        out = {"sha": [], "first": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "starts": [], "ends": []}
        for t, sha in enumerate(texts.sha):
            low, high, zero = starts[cuts[t] : cuts[t + 1]], ends[cuts[t] : cuts[t + 1]], base[t]
            digest, at = hashlib.sha256(), zero
            for a, b in zip(low, high, strict=True):
                digest.update(raw[at:a])
                at = b
            digest.update(raw[at : base[t + 1]])
            out["sha"].append(sha)
            out["first"].append(int(texts.doc[t]))
            out["n_removed"].append(sum(high) - sum(low))
            out["n_spans"].append(len(low))
            out["kept_sha256"].append(digest.hexdigest())
            out["starts"].append([a - zero for a in low])
            out["ends"].append([b - zero for b in high])
        longs = pa.list_(pa.int64())
        return _rows(out, {"sha": pa.binary(), "first": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "starts": longs, "ends": longs})

    return run


def _once(n: int):
    """Each different text of a partition once, then its smallest document here."""

    def run(parts):
        least: dict[bytes, int] = {}
        names = ["bucket", "sha", "doc", "text"]

        def out(shas, docs, texts):
            bucket = [int.from_bytes(s[:7], "little") % n for s in shas]
            return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(shas, pa.binary()), pa.array(docs, pa.int64()), pa.array(texts, pa.binary())], names)

        for part in parts:
            shas, texts = [], []
            for d, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                d = NULL if d is None else d
                sha = hashlib.sha256(t).digest()
                if sha not in least:
                    shas.append(sha)
                    texts.append(t)
                least[sha] = min(d, least.get(sha, d))
            yield out(shas, [None] * len(shas), texts)
        yield out(list(least), list(least.values()), [None] * len(least))

    return run


def _released(run):
    """``run`` for a group; what it needed goes back to the system."""

    def wrapped(key, *tables):
        out = run(key, *tables)
        release()
        return out

    # the number of parameters says whether the key is wanted
    return (lambda key, rows: wrapped(key, rows)) if run.__code__.co_argcount == 2 else wrapped


def removed_strings(docs: DataFrame, key: str = "doc_id", text: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, starts, ends (removed runs).

    A byte goes if a LENGTH-byte string that covers it also starts in a document with a smaller
    doc_id; strings lie inside one document and are judged on the input.

    Null text is empty; texts under LENGTH bytes lose nothing.  Null doc_id counts as smaller than
    all others.  Rows with one doc_id never remove each other's strings.  ``key`` must be integral.
    Very long texts are hashed in pieces that overlap by LENGTH - 1 bytes.  Empty table: no rows.  Other columns are ignored.
    """
    total = total_bytes(docs, text)
    n = max(1, -(-total // bucket_bytes), min(BUCKETS, total // LEAST_BYTES))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_text"))
    dealt = rows.mapInArrow(_once(n), "bucket long, sha binary, doc long, text binary")
    place = "place long, bucket long, data binary"
    bucket = lambda df: df.groupBy("bucket")
    hashes = bucket(dealt).applyInArrow(_released(_send_hashes(n)), place)
    replies = hashes.groupBy("place").applyInArrow(_released(_find_shared), place)
    send = _released(_send_contexts(n))
    contexts = bucket(dealt).cogroup(bucket(replies)).applyInArrow(lambda key, left, right: send(key, left, right), place)
    masks = contexts.groupBy("place").applyInArrow(_released(_decide(n)), place)
    finish = _released(_finish(n))
    out = "sha binary, first long, n_removed long, n_spans long, kept_sha256 string, starts array<long>, ends array<long>"
    judged = bucket(dealt).cogroup(bucket(masks)).applyInArrow(lambda key, left, right: finish(key, left, right), out)
    every = docs.select(F.col(key).alias("doc_id"), F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)).alias("sha"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    joined = every.join(judged, "sha")
    copy = (F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL)) != F.col("first")) & (F.col("n_bytes") >= LENGTH)
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return joined.select(
        "doc_id",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(copy, F.lit(1).cast("long")).otherwise(F.col("n_spans")).alias("n_spans"),
        F.when(copy, nothing).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
        F.when(copy, F.array(F.lit(0).cast("long"))).otherwise(F.col("starts")).alias("starts"),
        F.when(copy, F.array(F.col("n_bytes"))).otherwise(F.col("ends")).alias("ends"),
    )
