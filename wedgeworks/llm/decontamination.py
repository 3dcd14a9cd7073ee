"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming lookup, exact check.

Items fall into size classes (a geometric ladder of window sizes), by the shortest
stretch of the item that reaches the similarity.  An item is known by the fingerprints
of groups of its own windows of its class's size: at its head, at its end, and so
between them that each stretch which reaches the similarity holds a group.  A group has a
window for each offset below the stride, so that windows taken at every stride-th word of
a document meet one of them whatever the passage's position: an unbroken stretch of an
item is always found, a passage with changed words if a window is near enough.
Windows with no item's shingle about them are left out.  64-bit fingerprints are indexed by four
16-bit blocks, each entered under every value within RADIUS // 4 bits: any
fingerprint within RADIUS has such a block.  Candidates are verified by the exact
share of the item's weighted word shingles found in the item-sized span.
"""

from __future__ import annotations

from collections import Counter
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from wedgeworks.llm.common import pieces

SHINGLE, SIMILARITY = 5, 0.8
RADIUS, BLOCKS = 11, 4
#: Words between windows; window sizes are multiples of it, each about LADDER times the one before.
STRIDE, LADDER = 4, 1.5
#: Bytes of item text that one pass over the documents carries to the executors.
PASS_BYTES = 16 << 20
MAX_WEIGHT = 7
#: Leading bits of a shingle's hash that say whether it may be an item's.
MARK_BITS = 20
#: Words that are fingerprinted at a time.
STEP = 1 << 15
#: Words whose signs a worker keeps.
MEMO = 200_000

#: ASCII letters and digits stay, lower-cased; other ASCII separates words; bytes above 127 stay.
FOLD = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else b if b > 127 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def size_class(m: int) -> tuple[int, int]:
    """(window size, stride) for items of m words: the largest step of the ladder that leaves room for
    every offset below the stride; short items are compared whole, at every word."""
    if m < 3 * STRIDE - 1:
        return m, 1
    steps = 2
    while (larger := max(steps + 1, int(steps * LADDER))) * STRIDE + STRIDE - 1 <= m:
        steps = larger
    return steps * STRIDE, STRIDE


def stretches(weights: list[float], shingle: int) -> list[tuple[int, int]]:
    """(first word, end) of the shortest stretches of an item whose shingles weigh SIMILARITY of all."""
    least, found, end, held = sum(weights) * (SIMILARITY - 1e-9), [], 0, 0.0
    for begin in range(len(weights)):
        while held < least and end < len(weights):
            held += weights[end]
            end += 1
        if held < least:
            break
        found.append((begin, end + shingle - 1))
        held -= weights[begin]
    return found


def offsets(m: int, size: int, stride: int, found: list[tuple[int, int]]) -> list[int]:
    """Offsets of an item's windows: groups of ``stride`` at its head and end, and within each stretch."""
    reach = size + stride - 1
    firsts, last = {0, m - reach}, 0
    for begin, end in found:
        if last < begin:
            last = end - reach
            firsts.add(last)
    return sorted({f + o for f in firsts for o in range(stride)})


def rolling(hashes: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of the n-word shingles that begin at each word."""
    out = np.zeros(max(len(hashes) - n + 1, 0), np.uint64)
    for j in range(n):
        out = (out ^ hashes[j : j + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


class Signs:
    """Words -> rows of 64 signed weights."""

    def __init__(self, weights: dict[bytes, int]):
        self.weights = weights
        self.row: dict[bytes, int] = {}
        self.rows = np.zeros((0, 64), np.int8)
        self.hashes = np.zeros(0, np.uint64)

    def __call__(self, words: list[bytes]) -> np.ndarray:
        """The words' places in ``rows`` and ``hashes``, until the next call."""
        row = self.row
        new = [w for w in dict.fromkeys(words) if w not in row]
        if len(row) + len(new) > MEMO:
            row.clear()
            self.rows, self.hashes = self.rows[:0], self.hashes[:0]
            new = list(dict.fromkeys(words))
        if new:
            digests = np.array(list(map(xxhash.xxh3_64_intdigest, new)), np.uint64)
            bits = np.unpackbits(digests.astype(">u8").view(np.uint8)).reshape(-1, 64)
            weight = np.array([self.weights.get(w, MAX_WEIGHT) for w in new], np.int8)
            row.update(zip(new, range(len(row), len(row) + len(new)), strict=True))
            self.rows = np.concatenate([self.rows, (bits.view(np.int8) * 2 - 1) * weight[:, None]])
            self.hashes = np.concatenate([self.hashes, digests])
        return np.fromiter(map(row.__getitem__, words), np.int64, len(words))


def fingerprints(signs: np.ndarray, size: int, stride: int) -> np.ndarray:
    """SimHash of the windows of ``size`` words that begin at every ``stride``-th word."""
    steps = len(signs) // stride
    sums = np.zeros((steps + 1, 64), np.int32)
    part = signs[: steps * stride].reshape(steps, stride, 64)
    np.cumsum(part.sum(1, dtype=np.int32) if stride > 1 else part[:, 0], axis=0, out=sums[1:])
    return _packed(sums, size // stride)


def _packed(sums: np.ndarray, ahead: int) -> np.ndarray:
    """Fingerprints of windows ``ahead`` steps long, from prefix sums."""
    return np.packbits(sums[ahead:] > sums[:-ahead], axis=1).view(">u8").ravel().astype(np.uint64) if len(sums) > ahead else np.zeros(0, np.uint64)


class Index:
    def __init__(self, items: list[tuple[object, bytes]]):
        self.ids = [i for i, _ in items]
        self.words = [words_of(t) for _, t in items]
        frequency = Counter(w for ws in self.words for w in set(ws))
        n = len(items) + 1
        self.weights = {w: int(np.clip(round(np.log2(n / (c + 1))), 1, MAX_WEIGHT)) for w, c in frequency.items()}
        self.shingles = [Counter(shingle_list(ws)) for ws in self.words]
        held = Counter(s for x in self.shingles for s in x)
        # a shingle that many items share says less about each of them
        self.share = [{s: c / held[s] for s, c in x.items()} for x in self.shingles]
        self.total = [sum(x.values()) for x in self.share]
        table = Signs(self.weights)
        grouped: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        reach: dict[tuple[int, int], int] = {}
        known: dict[int, list[np.ndarray]] = {}
        for i, ws in enumerate(self.words):
            if ws:
                shingle = min(SHINGLE, len(ws))
                found = stretches([1 / held[s] for s in shingle_list(ws)], shingle)
                size, stride = size_class(min(end - begin for begin, end in found))
                at = table(ws)
                signs = table.rows[at]
                reach[size, stride] = max(reach.get((size, stride), 0), len(ws) + 2 * STRIDE)
                known.setdefault(shingle, []).append(rolling(table.hashes[at], shingle))
                for o in offsets(len(ws), size, stride, found):
                    grouped.setdefault((size, stride), []).append((int(fingerprints(signs[o : o + size], size, size)[0]), i, o))
        self.classes = {k: self._tables(v) for k, v in sorted(grouped.items())}
        self.reach = reach
        self.known = {n: np.unique(np.concatenate(x)) for n, x in known.items()}
        self.marks = {n: np.bincount((x >> np.uint64(64 - MARK_BITS)).astype(np.int64), minlength=1 << MARK_BITS) > 0 for n, x in self.known.items()}

    def _shingles_before(self, hashes: np.ndarray) -> np.ndarray:
        """For each word, the number of items' shingles that begin before it."""
        here = np.zeros(len(hashes), bool)
        for n, known in self.known.items():
            rolled = rolling(hashes, n)
            maybe = np.flatnonzero(self.marks[n][(rolled >> np.uint64(64 - MARK_BITS)).astype(np.int64)])
            here[maybe[known[np.minimum(np.searchsorted(known, rolled[maybe]), len(known) - 1)] == rolled[maybe]]] = True
        return np.concatenate([[0], np.cumsum(here)])

    @staticmethod
    def _tables(entries):
        prints = np.array([e[0] for e in entries], np.uint64)
        width = 64 // BLOCKS
        flips = [0, *(sum(1 << b for b in c) for k in range(1, RADIUS // BLOCKS + 1) for c in combinations(range(width), k))]
        tables = []
        for b in range(BLOCKS):
            block = (prints >> np.uint64(b * width)).astype(np.int64) & ((1 << width) - 1)
            value = (block[:, None] ^ np.array(flips)).ravel()
            owner = np.repeat(np.arange(len(prints)), len(flips))
            order = np.argsort(value, kind="stable")
            tables.append((np.searchsorted(value[order], np.arange((1 << width) + 1)).astype(np.int64), owner[order]))
        return prints, np.array([e[1] for e in entries]), np.array([e[2] for e in entries]), tables

    def near(self, size_stride, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, entry, distance) of all fingerprints within RADIUS of an entry of the class."""
        known, _, _, tables = self.classes[size_stride]
        width = 64 // BLOCKS
        found = []
        for b, (first, owner) in enumerate(tables):
            value = (prints >> np.uint64(b * width)).astype(np.int64) & ((1 << width) - 1)
            count = first[value + 1] - first[value]
            window = np.repeat(np.arange(len(prints)), count)
            if len(window):
                at = np.arange(len(window)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first[value], count)
                entry = owner[at]
                distance = np.bitwise_count(prints[window] ^ known[entry])
                keep = distance <= RADIUS
                found.append((window[keep], entry[keep], distance[keep]))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def matches(self, texts: list[bytes], table: Signs) -> list[dict[int, tuple[float, int, int]]]:
        """For each text, by item: best (similarity, first word, distance) of the passages that reach SIMILARITY."""
        split = [words_of(t) for t in texts]
        out: list[dict[int, tuple[float, int, int]]] = [{} for _ in texts]
        seen: set[tuple[int, int, int]] = set()
        overlap = max((size for size, _ in self.classes), default=0)
        overlap += -overlap % STRIDE
        words = list(chain.from_iterable(split))
        edges = np.cumsum([0, *map(len, split)])
        back = max(self.reach.values(), default=0)
        for begin in range(0, len(words), STEP):
            early = min(begin, back)
            places = table(words[begin - early : begin + STEP + overlap + back])
            before = self._shingles_before(table.hashes[places])
            if not before[-1]:
                continue
            signs = table.rows[places[early : early + STEP + overlap]]
            sums = {}
            for size, stride in self.classes:
                if stride not in sums:
                    steps = len(signs) // stride
                    part = signs[: steps * stride].reshape(steps, stride, 64)
                    sums[stride] = np.zeros((steps + 1, 64), np.int32)
                    np.cumsum(part.sum(1, dtype=np.int32) if stride > 1 else part[:, 0], axis=0, out=sums[stride][1:])
                prints = _packed(sums[stride], size // stride)
                # a passage of the class has a shingle of its item within reach of each of its windows
                at = early + np.arange(len(prints)) * stride
                reach = self.reach[size, stride]
                some = np.flatnonzero(before[np.minimum(at + reach + 1, len(before) - 1)] > before[np.maximum(at - reach, 0)])
                window, entry, distance = self.near((size, stride), prints[some])
                start = begin + some[window] * stride
                text = np.searchsorted(edges, start, side="right") - 1
                inside = start + size <= edges[text + 1]
                _, items, offsets, _ = self.classes[size, stride]
                order = np.argsort(distance[inside], kind="stable")
                rows = (x[inside][order].tolist() for x in (text, items[entry], start - offsets[entry] - edges[text], distance))
                for t, item, at, d in zip(*rows, strict=True):
                    if (t, item, at) in seen:
                        continue
                    seen.add((t, item, at))
                    s = self.similarity(item, split[t], at)
                    if s >= SIMILARITY and (s, -d, -at) > (lambda b: (b[0], -b[2], -b[1]))(out[t].get(item, (0.0, 0, 99))):
                        out[t][item] = (s, max(at, 0), d)
        return out

    def similarity(self, item: int, words: list[bytes], at: int) -> float:
        """Weighted share of the item's shingles found in the item-sized span at ``at``, give or take a stride."""
        span = Counter(shingle_list(words[max(at - STRIDE, 0) : max(at, 0) + len(self.words[item]) + STRIDE], min(SHINGLE, len(self.words[item]))))
        share, mine = self.share[item], self.shingles[item]
        return sum(share[s] * min(span[s], c) / c for s, c in mine.items() if s in span) / self.total[item]


def shingle_list(words: list[bytes], size: int | None = None) -> list[tuple[bytes, ...]]:
    m = min(SHINGLE, len(words)) if size is None else size
    return list(zip(*(words[j : len(words) - m + 1 + j] for j in range(m)), strict=True)) if len(words) >= m > 0 else []


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and benchmark item found in it: doc_id, item_id, similarity, first_word, distance.

    Words are compared with A-Z lower-cased and other ASCII than letters and digits as separators.
    An item is found where at least SIMILARITY of its weighted 5-word shingles (fewer words: the
    whole item) lie in a span of its size; the best span is returned, the nearest fingerprint, then the
    first, of equal ones.  An unbroken stretch of the item is always found.  A passage with words
    changed, left out or put in is found if one of its windows is within RADIUS bits of one of the item's; the
    README has the measured shares.

    Null or empty texts and items match nothing.  Null or repeated doc_ids pass through: each row
    has its own matches.  Repeated item_ids are items of their own, and one row each.  Empty tables:
    no rows.  Texts of any length are matched whole, STEP words at a time.  Item ids may have any type.  Other
    columns are ignored, whatever their names.  Items go to the executors PASS_BYTES at a time, with a
    pass over the documents for each.
    """
    kind, item_kind = docs.schema[key].dataType.simpleString(), benchmark.schema[item_key].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {item_kind}, similarity double, first_word int, distance int"
    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("doc_id"), F.col(text).cast("binary").alias("_text"))
    item_type = to_arrow_type(benchmark.schema[item_key].dataType)
    out = docs.sparkSession.createDataFrame([], schema)
    for k, carried in enumerate(_indexes(benchmark, item_key, item_text)):

        def run(parts, carried=carried):
            index = carried.value
            table = Signs(index.weights)
            for part in parts:
                at, found = [], []
                for i, matched in enumerate(_matched(index, table, part.column(1).to_pylist())):
                    for item, (s, first, distance) in sorted(matched.items()):
                        at.append(i)
                        found.append((index.ids[item], s, first, distance))
                item, s, first, distance = zip(*found, strict=True) if found else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int64())), pa.array(item, item_type), pa.array(s, pa.float64()), pa.array(first, pa.int32()), pa.array(distance, pa.int32())], ["doc_id", "item_id", "similarity", "first_word", "distance"])

        out = out.unionByName(rows.mapInArrow(run, schema)) if k else rows.mapInArrow(run, schema)
    return out


def without_items(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, in which no benchmark item is found (see ``contaminated``).

    Null or empty texts stay; so do all rows if there are no items.  Columns of any name pass through.  Rows are judged one by one: null or repeated keys don't matter.
    Nothing is shuffled.
    """
    at = docs.columns.index(text)
    for carried in _indexes(benchmark, item_key, item_text):

        def run(parts, carried=carried):
            index = carried.value
            table = Signs(index.weights)
            for part in pieces(parts):
                texts = [(t or "").encode() for t in part.column(at).to_pylist()]
                yield part.filter(pa.array([not m for m in _matched(index, table, texts)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def _indexes(benchmark: DataFrame, item_key: str, item_text: str):
    """Broadcast indexes of the items, about PASS_BYTES of item text in each."""
    items = benchmark.where(F.col(item_text).isNotNull()).select(F.col(item_key).alias("item_id"), F.col(item_text).cast("binary").alias("_text"))
    passes = -(-(items.agg(F.sum(F.octet_length("_text"))).first()[0] or 0) // PASS_BYTES)
    for k in range(passes):
        chosen = items.where(F.pmod(F.xxhash64("_text"), F.lit(passes)) == k).collect()
        index = Index(sorted(((r["item_id"], bytes(r["_text"])) for r in chosen), key=lambda x: (str(x[0]), x[1])))
        yield benchmark.sparkSession.sparkContext.broadcast(index)


def _matched(index: Index, table: Signs, texts: list[bytes]):
    for j in range(0, len(texts), 64):
        yield from index.matches(texts[j : j + 64], table)
