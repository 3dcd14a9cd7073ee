"""Repetition coverage: characters inside duplicated word n-grams and lines.

Rolling polynomial hashes of the word sequence are extended from one n-gram
length to the next in numpy; equal hashes are compared word by word before they
count.  The verdict follows the published repetition thresholds for 5- to
10-grams and for lines.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wedgeworks.llm.common import mix64

#: Largest share of a text's word characters inside n-grams equal to an earlier one, by n (fixed published values).
GRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Largest share of word characters in repeated lines.
LINE_LIMIT = 0.20
MIN_WORDS = 20
BASE_GRAM = 8
BASE_PERCENT = 30

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
SPACE, SYMBOL = np.zeros(256, bool), np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
SYMBOL[list(b"#*$%&|<>")] = True


class _Ids(dict):
    def __missing__(self, word):
        self[word] = found = len(self)
        return found


def _mixed(ids: np.ndarray) -> np.ndarray:
    return mix64((ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def _starts(hashes: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the n-grams that occur twice or more; those of them equal to an earlier one."""
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    same = np.flatnonzero(ranked[1:] == ranked[:-1])
    if not len(same):
        return same, same
    a, b = order[same], order[same + 1]
    if all(np.array_equal(ids[a + j], ids[b + j]) for j in range(n)):
        return np.unique(np.concatenate([a, b])), b
    seen: dict[bytes, list[int]] = {}  # two n-grams share a hash: compare them all
    for i in range(len(hashes)):
        seen.setdefault(ids[i : i + n].tobytes(), []).append(i)
    pick = lambda skip: np.array(sorted(i for v in seen.values() if len(v) > 1 for i in v[skip:]), np.int64)
    return pick(0), pick(1)


def _cover(starts: np.ndarray, n: int, words: int) -> np.ndarray:
    edge = np.zeros(words + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + n, -1)
    return np.cumsum(edge[:-1]) > 0


def repeated_words(ids: np.ndarray, lengths: list[int]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each n, masks of the words inside n-grams found twice or more, and inside those equal to an earlier one."""
    none = np.zeros(len(ids), bool)
    out, value = dict.fromkeys(lengths, (none, none)), _mixed(ids)
    rolling, wanted = value.copy(), set(lengths)
    for n in range(2, max(lengths) + 1):
        if len(ids) < n + 1:
            break
        rolling = rolling[:-1] * BASE + value[n - 1 :]
        if n not in wanted:
            continue
        starts, later = _starts(rolling, ids, n)
        if not len(starts):
            break  # a longer n-gram found twice holds this one twice
        out[n] = _cover(starts, n, len(ids)), _cover(later, n, len(ids))
    return out


def measure(text: bytes) -> dict:
    words = text.split()
    ids = np.fromiter(map(_Ids().__getitem__, words), np.int64, len(words))
    raw = np.frombuffer(text, np.uint8)
    points = (raw & 0xC0) != 0x80
    lead = np.concatenate([[0], np.cumsum(points & ~SPACE[raw])])
    chars = int(lead[-1])
    # characters of each word, from the prefix counts at its edges
    inside = ~SPACE[raw]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    size = lead[edges[1::2]] - lead[edges[::2]]
    covered = repeated_words(ids, sorted({*GRAM_LIMITS, BASE_GRAM}))
    lines = [x for x in text.split(b"\n") if x.strip()]
    seen, repeated, repeated_chars = set(), 0, 0
    for line in lines:
        if line in seen:
            repeated += 1
            repeated_chars += sum(len(w.decode("utf-8", "replace")) for w in line.split())
        seen.add(line)
    out = {
        "n_words": len(words),
        "word_chars": chars,
        "n_symbols": int(SYMBOL[raw].sum()),
        "n_dup_lines": repeated,
        "n_repeat_words": int(covered[BASE_GRAM][0].sum()),
        "dup_line_chars": repeated_chars,
    } | {f"dup_{n}gram_chars": int(size[covered[n][1]].sum()) for n in GRAM_LIMITS}
    out["base_failed"] = out["n_words"] < MIN_WORDS or 100 * out["n_repeat_words"] > BASE_PERCENT * out["n_words"]
    over = repeated_chars > LINE_LIMIT * chars or any(out[f"dup_{n}gram_chars"] > share * chars for n, share in GRAM_LIMITS.items())
    out["kept"] = not out["base_failed"] and not over
    return out


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *(f"dup_{n}gram_chars" for n in GRAM_LIMITS)]


def repetition(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, counts, characters in n-grams and lines equal to an
    earlier one of the text, base_failed, kept.

    Null or empty text: no words, so all counts are 0, base_failed is true and kept false.
    Null or repeated keys pass through.  Long texts are measured whole, in memory
    proportional to the text.  Empty table: no rows.  Other columns are ignored.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_text"))
    schema = f"doc_id {kind}, {', '.join(f'{c} long' for c in COUNTS)}, base_failed boolean, kept boolean"

    def run(parts):
        for part in parts:
            found = [measure(x) for x in part.column(1).to_pylist()]
            columns = [pa.array([x[c] for x in found], pa.int64()) for c in COUNTS] + [pa.array([x[c] for x in found], pa.bool_()) for c in ("base_failed", "kept")]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["doc_id", *COUNTS, "base_failed", "kept"])

    return rows.mapInArrow(run, schema)
