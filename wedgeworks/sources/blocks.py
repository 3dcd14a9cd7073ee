"""Radius join of vectors: every two blocks of rows meet in one task, which compares them by matrix products."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block at most; rows for which a further block pays; rows by rows of one product.
ROWS, LEAST, TILE = 1 << 15, 1 << 9, (1 << 12, 1 << 11)


def near_pairs(ids: np.ndarray, other: np.ndarray, x: np.ndarray, y: np.ndarray, r: float, same: bool):
    """(src, dst) of rows at most r apart: a product in single precision rules out what is surely farther, and the rest
    is summed in double precision, coordinate by coordinate."""
    with np.errstate(all="ignore"):
        a, b = x.astype(np.float32), y.astype(np.float32)
        na, nb = (a * a).sum(1), (b * b).sum(1)
        slack = np.float32((x.shape[1] + 8) * 2.0**-22)  # above the rounding errors of a product and its sums
        limit = np.float32(r * r * (1 + 1e-6))
        for i in range(0, len(a), TILE[0]):
            for j in range(i // TILE[1] * TILE[1] if same else 0, len(b), TILE[1]):
                part, pb = slice(i, i + TILE[0]), slice(j, j + TILE[1])
                product = a[part] @ b[pb].T
                product *= 2
                # not (far): what isn't a number, as of overflows, is looked at in double precision
                p, q = np.nonzero(~(product < ((1 - slack) * na[part] - limit)[:, None] + (1 - slack) * nb[pb]))
                p, q = p + i, q + j
                if same:
                    keep = p < q
                    p, q = p[keep], q[keep]
                for k in range(0, len(p), 1 << 20):
                    u, v = p[k : k + (1 << 20)], q[k : k + (1 << 20)]
                    total = np.zeros(len(u))
                    for c in range(x.shape[1]):
                        step = np.subtract(x[u, c], y[v, c], dtype=np.float64)  # single precision would round the difference
                        total += step * step
                    keep = (np.sqrt(total) <= r) & (ids[u] != other[v])
                    u, v = ids[u[keep]], other[v[keep]]
                    yield np.minimum(u, v), np.maximum(u, v)


def _meet(r: float):
    def run(key, table):
        first, second = key[0].as_py(), key[1].as_py()
        block, size = (table.column(c).to_numpy() for c in ("block", "size"))
        ids = table.column("id").to_numpy()
        flat = table.column("e").combine_chunks()
        for n in np.unique(size):
            sides = []
            for of in (first, second):
                rows = np.flatnonzero((block == of) & (size == n))
                sides.append((ids[rows], flat.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), n)))
            (a, x), (b, y) = sides
            for src, dst in near_pairs(a, b, x, y, r, first == second):
                yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], ["src", "dst"])

    def whole(key, table):
        return pa.Table.from_batches(run(key, table), pa.schema([("src", pa.int64()), ("dst", pa.int64())]))

    return whole


def radius_pairs(rows: DataFrame, r: float, most: int = ROWS) -> DataFrame:
    """Pairs src < dst of rows (id, e) at most ``r`` apart (Euclidean).  Rows without a vector, or with a null in
    it, have no partners, nor have vectors of different lengths; vectors of no length are 0 apart.

    Each row is sent once for every block, rows / ``most`` times.
    """
    rows = rows.where("id is not null and e is not null").where(F.forall("e", lambda v: v.isNotNull()))
    n, parallel = rows.count(), rows.sparkSession.sparkContext.defaultParallelism
    blocks = max(-(-n // most), min(math.isqrt(4 * parallel) + 1, n // LEAST + 1))
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    sent = rows.select(F.col("id").cast("long").alias("id"), F.size("e").alias("size"), "e", block.alias("block"))
    sent = sent.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_k"))
    sent = sent.select("id", "size", "e", "block", F.least("block", "_k").alias("_i"), F.greatest("block", "_k").alias("_j"))
    return sent.groupBy("_i", "_j").applyInArrow(_meet(r), "src long, dst long")
