import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__
from wedgeworks.sources import blocks


def test_vectors_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    e = rng.normal(size=(300, 8))
    e[200:] = e[:100] + rng.normal(size=(100, 8)) * 0.01
    e[299] = e[298] = 1e30  # beyond what single precision can square
    far = [(1000, [1.0] * 7), (1001, None), (1002, []), (1003, [None] * 8), (None, [0.0] * 8), (298, [1e30] * 8)]
    rows = [(i, v.tolist()) for i, v in enumerate(e)] + far
    table = spark.createDataFrame(rows, "id long, e array<double>")
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True)) ** 0.5
    want = sorted((i, j) for i in range(300) for j in range(i + 1, 300) if apart(e[i], e[j]) <= 1.5)
    for most in (40, 1 << 15):
        got = blocks.radius_pairs(table, 1.5, most)
        assert sorted(set(map(tuple, got.collect()))) == want
        assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(blocks, "TILE", (16, 8))
    found = [p for s, d in blocks.near_pairs(np.arange(300), np.arange(300), e, e, 1.5, True) for p in zip(s.tolist(), d.tolist(), strict=True)]
    assert sorted(found) == want


@pytest.mark.parametrize("kind", ["single", "empty"])
def test_vectors_near_the_radius_like_sql(spark, tmp_path, kind):
    """Pairs whose distance is within a rounding error of the radius, in single precision; vectors of no length."""
    rng = np.random.default_rng(7)
    if kind == "single":
        base = rng.normal(size=(200, 64))
        step = rng.normal(size=(200, 64))
        near = base + step * (1.2 / np.linalg.norm(step, axis=1))[:, None]
        e = np.concatenate([base, near]).astype(np.float32)
    else:
        e = np.zeros((3, 0))
    table = pa.table({"vec_id": pa.array(range(len(e)), pa.int64()), "embedding": pa.array(e.tolist(), pa.list_(pa.float32()))})
    pq.write_table(table, tmp_path / "embeddings.parquet")
    got = __spark_entry__.queries()["embedding_radius_graph"](spark, str(tmp_path)).collect()
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    want = db.execute(__spark_entry__.oracle_sql()["embedding_radius_graph"]).fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and want
