"""Parts and shifted suppliers whose ids meet: arcs keep their direction, as in the query's SQL."""

import duckdb
import numpy as np
import pytest

import __spark_entry__

RNG = np.random.default_rng(3)
SHIFT = 10_000_000


def lineitem(kind):
    part, supplier = RNG.integers(0, 60, 1500), RNG.integers(0, 60, 1500)
    if kind == "meet":  # ids of parts and shifted suppliers are the same
        return part, supplier - SHIFT
    if kind == "fall":  # parts in part beyond the suppliers, in part among them
        return part * 3, supplier - SHIFT - 20
    if kind == "copies":  # as repeated with shifted keys
        return np.concatenate([part + k * SHIFT for k in range(3)]), np.concatenate([supplier + 7 * k for k in range(3)])
    return part + 2_147_000_000, supplier + 2_147_000_000  # no more room in 32 bits


@pytest.mark.parametrize("kind", ["meet", "fall", "copies"])
def test_arcs_like_sql(spark, tmp_path, kind):
    rows = [(i, int(p), int(s)) for i, (p, s) in enumerate(zip(*lineitem(kind), strict=True))] + [(0, None, 3), (0, 3, None), (0, None, None)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = __spark_entry__.queries()["triangle_count_bipartite"](spark, str(tmp_path)).collect()
    db = duckdb.connect()
    db.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = db.execute(__spark_entry__.oracle_sql()["triangle_count_bipartite"]).fetchone()[0]
    assert [r["triangles"] for r in got] == [want] and want > 0


def test_narrow_keys(spark, tmp_path):
    """Keys of 32 bits are shifted without an error."""
    rows = [(i, int(p), int(s)) for i, (p, s) in enumerate(zip(*lineitem("narrow"), strict=True))]
    spark.createDataFrame(rows, "l_orderkey int, l_partkey int, l_suppkey int").write.parquet(str(tmp_path / "lineitem.parquet"))
    arcs = {(p, s + SHIFT) for _, p, s in rows}
    got = __spark_entry__.queries()["triangle_count_bipartite"](spark, str(tmp_path)).collect()
    out = {}
    for x, y in arcs:
        out.setdefault(x, []).append(y)
    assert got[0]["triangles"] == sum(1 for ys in out.values() for y in ys for z in ys if y < z and (y, z) in arcs)
