"""Wedges are looked up in cells: no plan makes them rows of a join, and every method is exact but bloom."""

from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from graphs import frame, triangles

from wedgeworks.operators.edges import symmetrize
from wedgeworks.plans import cells
from wedgeworks.plans import triangles as T
from wedgeworks.sources import derived

RNG = np.random.default_rng(5)
#: A dense part, a sparse one of far ids (negative and beyond 32 bits), a hub, and a clique.
GRAPH = sorted(
    {(a, b) for a, b in combinations(range(40), 2) if RNG.random() < 0.5}
    | {tuple(sorted(p)) for p in RNG.choice([-(1 << 40), 7, 100, 5000, 70000, 1 << 33, 1 << 40, 1 << 62], (40, 2)).tolist() if p[0] != p[1]}
    | {(3, b) for b in range(200, 600)}
    | {(200, 201), (200, 202), (201, 202)}
)
PLANS = {
    "triangle_count_join": T.count_by_joins,
    "triangle_count_hash": T.count_by_hash,
    "triangle_count_broadcast": lambda e: T.count_by_broadcast(e, limit=0),
    "triangle_count_preagg": T.count_by_multiplicity,
    "triangle_count_pruned": T.count_pruned,
    "triangle_count_raw": lambda e: T.count_raw(symmetrize(e)),
    "triangle_count_bloom": T.count_by_bloom,
    "triangle_count_bloom_verified": T.count_by_bloom_verified,
    "triangle_count_suppliers": lambda e: T.count_by_arrays(e, "id"),
    "triangle_count_users": lambda e: T.count_by_arrays(e.where("src between 0 and 39 and dst between 0 and 39"), "id"),
    "closing_edges_distinct": T.closing_edges,
}


@pytest.mark.parametrize("name", PLANS)
def test_wedges_are_no_rows(spark, name):
    got = PLANS[name](frame(spark, GRAPH))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    by_id = name in ("triangle_count_pruned", "triangle_count_raw", "triangle_count_suppliers", "triangle_count_users", "closing_edges_distinct")
    assert plan.count("Join ") <= (0 if by_id else 2), plan  # the degrees of an edge's two ends, where they orient it
    if name == "closing_edges_distinct":
        known = set(GRAPH)
        below = {v: [u for u, w in GRAPH if w == v] for _, v in GRAPH}
        assert sorted(map(tuple, got.collect())) == [(a, b) for a, b in GRAPH if any((h, a) in known for h in below[b] if h < a)]
    elif name != "triangle_count_bloom":
        assert got.first()[0] == triangles([e for e in GRAPH if name != "triangle_count_users" or 0 <= e[0] and e[1] < 40])
    else:
        assert got.first()[0] >= triangles(GRAPH)


@pytest.mark.parametrize("batch", [1, 7, 1 << 20])
@pytest.mark.parametrize("method", ["any", "hash", "bloom", "verified", "array"])
def test_cells_and_batches(monkeypatch, method, batch):
    """The dealing and the counting by themselves, over several cells and small batches."""
    monkeypatch.setattr(cells, "BATCH", batch)
    lists = {}
    for a, b in GRAPH:
        lists.setdefault(a, []).append(b)
    rows = pa.RecordBatch.from_pydict({"u": list(lists), "out": list(lists.values())})
    for cuts in ([], [3, 4], [0, 10, 30, 200, 201]):
        dealt = pa.Table.from_batches(cells._deal(cuts, (True, True))([rows])).combine_chunks()
        total = 0
        for cell in range(len(cuts) + 1):
            own = dealt.filter(pa.compute.equal(dealt["cell"], cell)).sort_by("kind").drop_columns("cell").combine_chunks()
            for part in cells._look_up(method, False, batch == 7, False, T.bloom_shape)(iter(own.to_batches())):
                total += sum(part.column("n").to_pylist())
        assert total == triangles(GRAPH)


def test_lists_are_packed_without_loss():
    lists = [[5], [-(1 << 63), (1 << 63) - 1], [1, 2, 300], [7, 8, 9], [0, 1 << 20]]
    off = np.cumsum([0, *map(len, lists)])
    first, width, steps = cells._packed(np.concatenate(lists), off)
    assert width.to_pylist() == [1, 8, 2, 1, 8]
    batch = pa.RecordBatch.from_arrays([first, width, steps], ["first", "width", "steps"])
    for part, want in ((batch, lists), (batch.slice(1, 3), lists[1:4])):
        ids, at = cells._unpacked(part)
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == want


@pytest.mark.parametrize("top", [39, 200, cells.TOP])
def test_lists_that_nothing_closes_are_not_dealt(top):
    """Of a bipartite graph no head goes anywhere; else a head's ids beyond the greatest src are no lesser ends."""
    rows = pa.RecordBatch.from_pydict({"u": [1, 2, 3], "out": [[1000, 1001], [3, 1000, 1002], [5, 39, 40, 200, 1001]]})
    dealt = pa.Table.from_batches(cells._deal([3, 100], (False, True), top)([rows]))
    ends = []
    for batch in dealt.to_batches():
        ids, off = cells._unpacked(batch)
        ends += [i for n, a in zip(batch.column("key").to_pylist(), off) for i in ids[a : a + n].tolist()]
    assert sorted(ends) == {39: [3, 5, 39], 200: [3, 5, 39, 40, 200], cells.TOP: [3, 5, 39, 40, 200, 1000, 1000]}[top]


def test_users_of_an_hour_meet_in_rows_of_bits(spark, monkeypatch):
    """The dense graph's pairs are no rows, whatever the size of cells; a sparse one's are, as there are fewer."""
    rng = np.random.default_rng(8)
    rows = [(int(g), int(m)) for g, m in zip(rng.integers(0, 6, 900), rng.choice([*range(-50, 150), 1 << 40], 900))]
    rows += [(7, 1 << 41), (None, 3), (None, 4), (2, None)]
    frame_ = spark.createDataFrame(rows, "g int, m long")
    held = {}
    for g, m in rows:
        if g is not None and m is not None:
            held.setdefault(g, set()).add(m)
    want = sorted({p for ms in held.values() for p in combinations(sorted(ms), 2)})
    for bits in (1 << 29, 3000, 1):
        lists = derived.neighbour_lists(frame_, ["g"], "m", bits)
        dense = "Join" not in lists._jdf.queryExecution().optimizedPlan().toString()
        assert dense == (bits > 1)
        assert sorted((r["u"], v) for r in lists.collect() for v in r["out"]) == want
        assert all(r["out"] == sorted(r["out"]) for r in lists.collect())
        assert T.count_by_lists(lists).first()[0] == triangles(want)
    rows_of = pa.RecordBatch.from_pydict({"u": [0] * len(held), "out": [sorted(x) for x in held.values()]})
    dealt = pa.Table.from_batches(cells._deal([], (False, True))([rows_of]))
    found = [(u, v) for part in cells._united(2000)(iter(dealt.to_batches())) for u, out in zip(part["u"].to_pylist(), part["out"].to_pylist()) for v in out]
    assert sorted(found) == want  # in slices of rows
    assert T.count_by_lists(derived.neighbour_lists(frame_.where("false"), ["g"], "m")).first()[0] == 0
