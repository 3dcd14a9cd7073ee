"""Triangles of members that share groups are counted from the groups, alike members as one vertex."""

from datetime import datetime, timedelta
from itertools import combinations

import duckdb
import numpy as np
import pytest
from graphs import triangles

import __spark_entry__
from wedgeworks.plans import alike
from wedgeworks.sources import derived


def linked(rows):
    held = {}
    for g, m in rows:
        if g is not None and m is not None:
            held.setdefault(g, set()).add(m)
    return sorted({p for ms in held.values() for p in combinations(sorted(ms), 2)})


def memberships(kind):
    rng = np.random.default_rng(11)
    rows = [(int(g), int(m)) for g, m in zip(rng.integers(0, 9, 260), rng.choice([*range(-60, 60), 1 << 40], 260))]
    if kind == "copies":  # as repeated with shifted keys
        rows = [(g, m + k * 1000) for k in range(4) for g, m in rows]
    if kind == "none":
        return [(None, 1), (2, None)]
    return [*rows, (20, 1 << 41), (None, 3), (None, 4), (2, None), rows[0]]


@pytest.mark.parametrize("most, bits", [(1 << 11, 1 << 29), (40, 3000)])
@pytest.mark.parametrize("kind", ["different", "copies", "none"])
def test_against_brute_force(spark, monkeypatch, kind, most, bits):
    monkeypatch.setattr(alike, "WORDS", 1)
    monkeypatch.setattr(alike, "WORTH", 1 << 40)
    rows = memberships(kind)
    frame = spark.createDataFrame(rows, "g int, m long")
    got = alike.count_by_groups(frame, ["g"], "m", most, bits)
    assert sum(r["n"] for r in got.collect()) == triangles(linked(rows))


def test_tally_counts_each_vertex_so_often(monkeypatch):
    """Beyond what single precision holds, in several blocks, against a sum over triples."""
    rng = np.random.default_rng(2)
    monkeypatch.setattr(alike, "WORDS", 1)
    n, own = 150, [set(rng.choice(40, 2).tolist()) for _ in range(150)]
    vertex, group = (np.array(x) for x in zip(*((v, g) for v in range(n) for g in own[v]), strict=True))
    for times in (np.ones(n, np.int64), rng.integers(1, 1 << 18, n)):
        t = times.tolist()
        near = [[bool(own[a] & own[b]) for b in range(n)] for a in range(n)]
        want = sum(x * (x - 1) * (x - 2) // 6 for x in t)
        for a, b in combinations(range(n), 2):
            if near[a][b]:
                want += t[a] * t[b] * (t[a] + t[b] - 2) // 2 + t[a] * t[b] * sum(t[c] for c in range(b + 1, n) if near[a][c] and near[b][c])
        for bits in (1, 1 << 29):
            got = 0
            for first, *ends in ([0, 70, 71, 150], [70, 71, 150], [71, 150]):
                keep = vertex >= first
                linked_ = alike.Linked(vertex[keep] - first, group[keep], n - first, bits)
                got += alike._tally(linked_, times[first:], [e - first for e in ends])
            assert got == want


@pytest.mark.parametrize("copies", [1, 5])
def test_users_query_makes_no_neighbour_lists(spark, tmp_path, monkeypatch, copies):
    """Neither a table of large hours nor one repeated with shifted users has its edges written; the count is the SQL's."""
    rng = np.random.default_rng(4)
    base = [(int(u), f"kind {k}", datetime(2024, 1, 1) + timedelta(minutes=int(m))) for u, k, m in zip(rng.integers(0, 90, 700), rng.integers(0, 3, 700), rng.integers(0, 900, 700))]
    rows = [(u + 90 * c, k, t) for c in range(copies) for u, k, t in base] + [(None, "kind 1", base[0][2]), (3, None, base[0][2]), (3, "kind 1", None)]
    spark.createDataFrame(rows, "user_id long, event_type string, ts timestamp").write.parquet(str(tmp_path / "events.parquet"))

    def never(*_):
        raise AssertionError("lists of neighbours")

    monkeypatch.setattr(derived, "neighbour_lists", never)
    got = __spark_entry__.queries()["triangle_count_users"](spark, str(tmp_path)).collect()
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = db.execute(__spark_entry__.oracle_sql()["triangle_count_users"]).fetchone()[0]
    assert [r["triangles"] for r in got] == [want] and want > 0
