"""Labelled rows and small numpy fits shared by the two classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def held_out(key: str = "doc_id"):
    """True for the fold that is never learnt from: crc32 of the key as text, mod 5, is 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % FOLDS == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, budget: int, key: str = "doc_id", text: str = "text") -> dict[int, list[bytes]]:
    """Whole texts of at most ``rows`` labelled documents of each class, of ``budget`` bytes in all a class.

    Documents of the held-out fold, with a null text or key, or without a label are left out.  The
    choice is by a hash of the key, so it does not depend on the order or partitions of the input.
    A text that doesn't fit what is left of the budget is passed over.
    """
    marked = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(key)).groupBy(key).agg(F.max(label).alias("_label"))
    own = docs.where(F.col(text).isNotNull()).select(F.col(key), F.col(text).alias("_text"))
    lengths = own.select(F.col(key), F.octet_length("_text").alias("_n"))  # texts stay out of the join
    out: dict[int, list[bytes]] = {}
    for value in (0, 1):
        chosen = marked.where(F.col("_label") == value).join(lengths, key)
        order = F.xxhash64(F.col(key).cast("string"), F.lit(label))
        sizes = chosen.select(F.col(key), "_n", order.alias("_h")).orderBy("_h", key, "_n").limit(rows).collect()
        kept, left = set(), budget
        for row in sizes:
            if row["_n"] <= left:
                left -= row["_n"]
                kept.add(row[0])
        ids = docs.sparkSession.createDataFrame([(x,) for x in kept], f"{key} {docs.schema[key].dataType.simpleString()}")
        found = own.join(F.broadcast(ids), key).select(F.col(key), F.col("_text").cast("binary").alias("_text")).dropDuplicates().collect()  # bounded by rows and budget
        out[value] = [bytes(x["_text"]) for x in sorted(found, key=lambda x: (str(x[0]), bytes(x["_text"])))]
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Ridge logistic regression by Newton's method, steps halved until the loss falls; the last coefficient is the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    loss = lambda w: np.logaddexp(0, x @ w).sum() - y @ (x @ w) + (penalty * w * w).sum() / 2
    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), x.T @ (y - p) - penalty * w)
        while (after := loss(w + step)) > now and np.abs(step).max() > 1e-9:
            step = step / 2
        w, now = w + step, min(now, after)
        if np.abs(step).max() < 1e-9:
            break
    return w
