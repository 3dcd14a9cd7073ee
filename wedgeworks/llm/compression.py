"""Compression classifier: zstandard dictionaries of good and of bad text.

A text is compressed with a dictionary trained on each class.  The difference of the two sizes, over the
size without a dictionary, is taken for the whole text and for its blocks of several sizes.  Only these
differences, and how they spread over a text's blocks, enter the logistic calibration, which is fitted
on labelled texts that the dictionaries did not see.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wedgeworks.llm.fitting import held_out, logistic, sample

#: Bounds of the fitting sample: labelled documents a class, and bytes of text a class.
SAMPLE_ROWS, SAMPLE_BYTES = 4000, 12 << 20
DICTIONARY_BYTES = 112 << 10
LEVEL = 3
THRESHOLD = 0.3


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: list[float]

    def scorer(self):
        plain = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        tools = [zstandard.ZstdCompressor(**plain)]
        for content in (self.good, self.bad):
            data = zstandard.ZstdCompressionDict(content)  # a trained one with its entropy tables; else plain content
            data.precompute_compress(level=LEVEL)
            tools.append(zstandard.ZstdCompressor(dict_data=data, **plain))
        weights = np.array(self.weights)

        def score(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            x = np.array([features(t, tools) for t in texts]).reshape(-1, FEATURES)
            z = np.column_stack([expand(x), np.ones(len(x))]) @ weights
            return x, 1 / (1 + np.exp(-np.clip(z, -35, 35)))

        return score


#: Bytes of the blocks that are compressed beside the whole text.
BLOCKS = (1024, 256)
FEATURES = 1 + 6 * len(BLOCKS)
TERMS = 2 * FEATURES


def difference(text: bytes, tools: list) -> float:
    """Size with the bad dictionary less that with the good one, over the size without."""
    plain, good, bad = (len(t.compress(text)) for t in tools)
    return (bad - good) / plain


def features(text: bytes, tools: list) -> list[float]:
    """The difference of the whole text; of its blocks of each size the mean, least, greatest and median
    difference, their deviation and the share of those below 0.  A last piece shorter than half a block is left to the whole."""
    whole = difference(text, tools)
    out = [whole]
    for block in BLOCKS:
        parts = sorted(difference(text[i : i + block], tools) for i in range(0, len(text) - block // 2, block)) or [whole]
        mean = sum(parts) / len(parts)
        spread = sum((x - mean) ** 2 for x in parts) / len(parts)
        out += [mean, parts[0], parts[-1], parts[len(parts) // 2], spread**0.5, sum(x < 0 for x in parts) / len(parts)]
    return out


def expand(x: np.ndarray) -> np.ndarray:
    return np.column_stack([10 * x, np.clip(10 * x, -10, 10) ** 2])


def build(texts: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary of whole texts; the end of the texts as plain content where they are too few or too
    uniform for the trainer."""
    try:
        return zstandard.train_dictionary(size, texts).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(texts)[-size:]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS, budget: int = SAMPLE_BYTES) -> Model:
    """Fit on a bounded sample (``rows`` and ``budget`` a class) outside the held-out fold.

    Half of the sample makes the dictionaries, the other half the calibration.  With a class
    missing, the model gives the other class's share for every text.
    """
    texts = sample(docs, labels, label, rows, budget)
    if not texts[0] or not texts[1]:
        return Model(b"", b"", [0.0] * TERMS + [3.0 if texts[1] else -3.0 if texts[0] else 0.0])
    model = Model(build(texts[1][::2]), build(texts[0][::2]), [0.0] * (TERMS + 1))
    probe = model.scorer()
    x, y = [], []
    for value in (0, 1):
        rest = texts[value][1::2] or texts[value]
        x.append(probe(rest)[0])
        y.append(np.full(len(rest), value))
    x, y = np.concatenate(x), np.concatenate(y)
    weights = logistic(expand(x), y)
    counts = {r[0]: r[1] for r in labels.where(~held_out()).groupBy(label).count().collect()}  # two rows; the sample is balanced, the corpus isn't
    weights[-1] += np.log(max(counts.get(1, 1), 1) / max(counts.get(0, 1), 1)) - np.log(len(texts[1]) / len(texts[0]))
    return Model(model.good, model.bad, weights.tolist())


def classify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: key, held_out, score, predicted, and the differences of the whole text and (mean) of its smallest blocks.

    Null text scores as the empty text, which gets a defined score from the calibration.  Null
    or repeated keys pass through (a null key is not held out).  Texts of any length are compressed whole.
    Empty table: no rows.  Only the text enters a score; other columns are ignored, whatever their names.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("doc_id"), held_out(key).alias("held_out"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_text"))

    def run(parts):
        score = model.scorer()
        for part in parts:
            x, p = score(part.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(p), pa.array((p >= threshold).astype(np.int32)), pa.array(x[:, 0]), pa.array(x[:, -6])],
                ["doc_id", "held_out", "score", "predicted", "size_difference", "block_difference"],
            )

    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int, size_difference double, block_difference double")
