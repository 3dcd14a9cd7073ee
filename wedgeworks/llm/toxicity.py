"""Toxicity by maximum-scoring segments of token log-odds.

Tokens get the log-odds between toxic and other text under an informative
Dirichlet prior; those that stand out keep their log-odds as a score, and every
other token costs a little.  A linear-time scan lists all maximal scoring
segments of a text.  Their scores follow an extreme-value law on non-toxic text,
whose two constants are fitted there; a segment's expected number by chance says
whether it is significant, and the significant ones make up the document's score.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wedgeworks.llm.common import pieces
from wedgeworks.llm.fitting import held_out, logistic, sample

#: Bounds of the fitting sample: labelled documents a class, and bytes of text a class.
SAMPLE_ROWS, SAMPLE_BYTES = 6000, 16 << 20
#: Tokens kept at most, by |z|; the size of the model.
MAX_TOKENS = 50_000
#: Weight of the prior, as a share of all tokens counted: a token's own prior count is this share of its pooled count.
PRIOR = 0.05
MIN_Z = 2.5
#: Bytes of a token's stem; a token that isn't in the model takes its stem's score, if that is.
STEM = 4
COST = 0.25
#: A passage is significant if fewer than this many are expected by chance in a text of its length.
MAX_EXPECTED = 0.05
THRESHOLD = 0.5

#: ASCII letters and digits stay, lower-cased; other ASCII separates tokens; bytes above 127 stay.
FOLD = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else b if b > 127 else 32 for b in range(256))


def tokens(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def log_odds(toxic: Counter, other: Counter) -> dict[bytes, float]:
    """Token scores: log-odds with a Dirichlet prior in proportion to pooled counts, where |z| is large."""
    n1, n0 = sum(toxic.values()), sum(other.values())
    words = sorted(toxic.keys() | other.keys())
    y1 = np.array([toxic[w] for w in words], float)
    y0 = np.array([other[w] for w in words], float)
    a, all_a = PRIOR * (y1 + y0), PRIOR * (n1 + n0)
    delta = np.log((y1 + a) / (n1 + all_a - y1 - a + 1)) - np.log((y0 + a) / (n0 + all_a - y0 - a + 1))
    z = delta / np.sqrt(1 / (y1 + a) + 1 / (y0 + a))
    keep = np.flatnonzero(np.abs(z) >= MIN_Z)
    keep = keep[np.argsort(-np.abs(z[keep]), kind="stable")][:MAX_TOKENS]
    return {words[i]: float(delta[i]) - COST for i in keep}


def segments(at: list[int], scores: list[float]) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, first token, last token), in linear time.

    ``at`` has the positions of the scored tokens in ascending order; each token between two of
    them costs COST.  Candidates form a stack; each one links to the nearest earlier candidate
    that starts from a lower cumulative score, so that no link is followed twice.
    """
    stack: list[list] = []  # [sum before, sum after, first, last, link]
    total, previous = 0.0, None
    for i, score in zip(at, scores, strict=True):
        if previous is not None:
            total -= COST * (i - previous - 1)
        previous, before = i, total
        total += score
        if score <= 0:
            continue
        left, right, first = before, total, i
        link = len(stack) - 1
        while True:
            while link >= 0 and stack[link][0] >= left:
                link = stack[link][4]
            if link < 0 or stack[link][1] >= right:
                break
            left, first = stack[link][0], stack[link][2]
            del stack[link:]
            link = len(stack) - 1
        stack.append([left, right, first, i, link])
    return [(s[1] - s[0], s[2], s[3]) for s in stack]


def stem(word: bytes) -> bytes:
    return word[:STEM] + b"+"


def counted(texts: list[bytes]) -> Counter:
    """Number of different texts with each token and with each stem of longer ones (marked by a plus,
    which no token has): one text that repeats a word, or copies of a text, count once."""
    out: Counter = Counter()
    for t in dict.fromkeys(texts):
        words = set(tokens(t))
        out.update(words)
        out.update({stem(w) for w in words if len(w) > STEM})
    return out


class _Scores(dict):
    """Scores by token, with those taken from stems kept for reuse."""

    def __missing__(self, word):
        found = self.get(stem(word)) if len(word) > STEM else None
        if len(self) < 4 * MAX_TOKENS:
            self[word] = found
        return found


def scan(text: bytes, scores: _Scores) -> tuple[int, list[tuple[float, int, int]]]:
    words = tokens(text)
    got = list(map(scores.__getitem__, words))
    at = [i for i, x in enumerate(got) if x is not None]
    return len(words), segments(at, [got[i] for i in at])


@dataclass
class Model:
    scores: dict[bytes, float]
    decay: float
    rate: float
    weights: list[float]


def chance_decay(scores: np.ndarray) -> float:
    """The positive root of mean(exp(x * score)) = 1, for scores of negative mean."""
    low, high = 0.0, 1.0
    value = lambda x: np.exp(np.minimum(x * scores, 50)).mean() - 1
    if scores.max(initial=-1) <= 0:
        return 1.0
    while value(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        low, high = (low, (low + high) / 2) if value((low + high) / 2) > 0 else ((low + high) / 2, high)
    return max(high, 0.05)


FEATURES = 4


def features(found: tuple[int, list[tuple[float, int, int]]], model: Model) -> tuple[list[float], list[tuple[float, int, int]]]:
    n, parts = found
    space = np.log(model.rate * max(n, 1))
    bits = [(model.decay * s - space, a, b) for s, a, b in parts]  # minus the log of the number expected by chance
    real = [x for x in bits if x[0] > -np.log(MAX_EXPECTED)]
    best = max((x[0] for x in bits), default=-10.0)
    chance = -np.expm1(-np.exp(np.clip(-best, -40, 40)))  # of a segment as good as the best
    return [min(-np.log(chance + 1e-17), 40.0), np.log1p(sum(x[0] for x in real)), np.log1p(len(real)), max((s for s, _, _ in parts), default=0.0)], real


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = SAMPLE_ROWS, budget: int = SAMPLE_BYTES) -> Model:
    """Fit on a bounded sample (``rows`` and ``budget`` a class) outside the held-out fold.

    Two thirds of the sample give the token scores, the rest the chance law and the calibration.
    With a class missing, every text gets that class's complement.
    """
    texts = sample(docs, labels, label, rows, budget)
    if not texts[0] or not texts[1]:
        return Model({}, 1.0, 1.0, [0.0] * FEATURES + [3.0 if texts[1] else -3.0])
    learn = {c: [t for i, t in enumerate(texts[c]) if i % 3] or texts[c] for c in (0, 1)}
    rest = {c: texts[c][::3] for c in (0, 1)}
    scores = log_odds(counted(learn[1]), counted(learn[0]))
    lookup = _Scores(scores)
    background = np.array([-COST if (x := lookup[w]) is None else x for t in rest[0] for w in tokens(t)] or [-COST])
    decay = chance_decay(background)
    found = {c: [scan(t, lookup) for t in rest[c]] for c in (0, 1)}
    best = np.array([max((s for s, _, _ in parts), default=0.0) for _, parts in found[0]])
    length = np.array([max(n, 1) for n, _ in found[0]], float)
    rate = max((best > 0).sum(), 1) / (length * np.exp(-decay * best)).sum()
    model = Model(scores, decay, float(rate), [])
    x = np.array([features(f, model)[0] for c in (0, 1) for f in found[c]])
    y = np.repeat([0, 1], [len(found[0]), len(found[1])])
    weights = logistic(x, y, ridge=1.0)
    share = labels.where(~held_out()).groupBy(label).count().collect()  # two rows; the sample is balanced, the corpus isn't
    counts = {r[0]: r[1] for r in share}
    weights[-1] += np.log(max(counts.get(1, 1), 1) / max(counts.get(0, 1), 1)) - np.log(len(texts[1]) / len(texts[0]))
    model.weights = weights.tolist()
    return model


def score_texts(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: key, held_out, score, predicted, and the significant passages
    (first and last token, score in nats above chance).

    Null or empty text: no passages, the calibration's lowest score.  Null or repeated keys pass
    through (a null key is not held out).  Texts are scanned whole in linear time.  Empty table:
    no rows.  Only the text enters a score.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("doc_id"), held_out(key).alias("held_out"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_text"))
    span = pa.struct([("first", pa.int32()), ("last", pa.int32()), ("nats", pa.float64())])

    def run(parts):
        weights, lookup = np.array(model.weights), _Scores(model.scores)
        for part in parts:
            got = [features(scan(t, lookup), model) for t in part.column(2).to_pylist()]
            x = np.array([f for f, _ in got]).reshape(-1, FEATURES)
            p = 1 / (1 + np.exp(-np.clip(np.column_stack([x, np.ones(len(x))]) @ weights, -35, 35)))
            spans = pa.array([[{"first": a, "last": b, "nats": s} for s, a, b in real] for _, real in got], pa.list_(span))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(p), pa.array((p >= threshold).astype(np.int32)), spans], ["doc_id", "held_out", "score", "predicted", "passages"])

    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int, passages array<struct<first:int,last:int,nats:double>>")


def without_toxic(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores below ``threshold``.

    Null or empty text scores the calibration's lowest.  Rows are judged one by one: null or repeated
    keys don't matter.  Nothing is shuffled.
    """
    at = docs.columns.index(text)

    def run(parts):
        weights, lookup = np.array(model.weights), _Scores(model.scores)
        for part in pieces(parts):
            texts = ((t or "").encode() for t in part.column(at).to_pylist())
            x = np.array([features(scan(t, lookup), model)[0] for t in texts]).reshape(-1, FEATURES)
            p = 1 / (1 + np.exp(-np.clip(np.column_stack([x, np.ones(len(x))]) @ weights, -35, 35)))
            yield part.filter(pa.array(p < threshold))

    return docs.mapInArrow(run, docs.schema)
