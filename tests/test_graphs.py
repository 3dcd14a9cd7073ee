import pytest
from graphs import complete, cycle, frame, karate, triangles, wheel
from pyspark.sql import functions as F

from wedgeworks.functions.columns import FIRST, MODULUS, MULTIPLIER, lehmer, round_up
from wedgeworks.operators import edges as E
from wedgeworks.operators import ownership as O
from wedgeworks.operators import stats as S
from wedgeworks.operators import wedges as W
from wedgeworks.plans import triangles as T
from wedgeworks.sources import csr, geometric

STAR = [(0, i) for i in range(1, 60)]
CASES = {"empty": ([], 0), "edge": ([(3, 9)], 0), "star": (STAR, 0), "cycle": (cycle(7), 0), "k7": (complete(7), 35), "wheel": (wheel(6), 6), "karate": (karate(), 45)}


@pytest.mark.parametrize("name", CASES)
def test_strategies_agree(spark, name):
    rows, expected = CASES[name]
    edges = frame(spark, rows).persist()
    assert triangles(rows) == expected
    for strategy in T.STRATEGIES:
        got = T.triangle_count(edges, strategy).first()[0]
        assert got == expected if strategy != "bloom" else got >= expected, strategy
    assert T.count_by_arrays(edges, "id").first()[0] == expected
    assert T.count_raw(E.symmetrize(edges)).first()[0] == expected
    assert T.triangles(edges).distinct().count() == expected


def test_canonicalize(spark):
    k5 = complete(5)
    dirty = frame(spark, k5 + [(b, a) for a, b in k5] + [(i, i) for i in range(5)]).unionByName(spark.sql("select 1L src, cast(null as long) dst"))
    got = E.canonicalize(dirty)
    assert sorted(map(tuple, got.collect())) == k5


def test_wedges_and_owners(spark):
    rows, nv, parts = karate(), 35, 4
    edges = frame(spark, rows).persist()
    sym = E.symmetrize(edges).persist()
    nbrs = {v: sorted(b if a == v else a for a, b in rows if v in (a, b)) for v in range(nv)}
    bounds = [nv * p // parts for p in range(parts + 1)]
    own = [max(p for p in range(parts) if bounds[p] <= v) for v in range(nv)]
    every = [(h, u, v) for h, ns in nbrs.items() for i, u in enumerate(ns) for v in ns[i + 1 :]]
    assert W.wedge_count(sym).first()[0] == len(every)
    assert sorted(map(tuple, W.wedges(sym).collect())) == sorted(every)
    for segment in (1, 3, 1 << 16):
        got = {(r[0], r[1]): r[2] for r in W.later_neighbours(sym, segment).collect()}
        assert got == {(h, u): sum(x > u for x in ns) for h, ns in nbrs.items() for u in ns}
    known = set(rows)
    for rows_ in W.wedge_status_by_owner(sym, T.triangles(edges), nv, parts).collect():
        mine = [(u, v) in known for h, u, v in every if (own[h], own[u]) == (rows_[0], rows_[1])]
        assert (rows_[2], rows_[3]) == (sum(mine), len(mine) - sum(mine))
    pruned = [w for w in every if nbrs[w[1]][0] <= w[2] <= nbrs[w[1]][-1] and w[1] >= nbrs[w[2]][0]]
    assert W.pruned_wedge_count(sym).first()[0] == len(pruned)
    cut = {(r[0], r[1]): r[2] for r in O.owner_cut_matrix(sym, nv, parts).collect()}
    assert sum(cut.values()) == 2 * len(rows) and cut[0, 1] == sum(own[a] != own[b] and {own[a], own[b]} == {0, 1} for a, b in rows)


@pytest.mark.parametrize("block", [1, 7, 1 << 20])
def test_offsets_and_cuts(spark, block):
    nv = 40
    sym = E.symmetrize(frame(spark, karate()))
    offsets = S.csr_offsets(sym, nv, block).persist()
    got = {r["id"]: (r["degree"], r["offset"]) for r in offsets.collect()}
    at, running = [], 0
    for v in range(nv):
        d = sum(v in e for e in karate())
        assert got[v] == (d, running)
        at.append(running)
        running += d
    for parts in (1, 3, 6):
        cuts, capacity = [0], running // parts
        for _ in range(1, parts):
            cuts.append(next((v for v in range(cuts[-1] + (len(cuts) > 1), nv) if at[v] - at[cuts[-1]] >= capacity), nv) if cuts[-1] < nv else nv)
        assert O.balanced_cuts(offsets, running, nv, parts) == cuts


def test_stream_and_geometric(spark):
    x, want = FIRST, []
    for _ in range(300):
        want.append(x)
        x = x * MULTIPLIER % MODULUS
    assert [r[0] for r in spark.range(300).select(lehmer(F.col("id"))).collect()] == want
    for n, m, t in ((16, 20, 12), (64, 148, 126), (1024, 3315, 4373)):
        edges = geometric.geometric_edges(spark, n).persist()
        assert (edges.count(), T.triangle_count(edges.select("src", "dst")).first()[0]) == (m, t)
    more = geometric.random_edges(spark, edges, 1024, 5.0)
    assert more.select("src", "dst").distinct().count() == more.count() > 3315
    with pytest.raises(ValueError):
        geometric.points(spark, 10, strips=3)
    assert round_up(10, 8) == 16


@pytest.mark.parametrize("width", [32, 64])
def test_csr_files(spark, tmp_path, width):
    sym = E.symmetrize(frame(spark, karate()))
    path = str(tmp_path / "g.bin")
    csr.write_csr(sym, 37, path, width)
    want = sorted(map(tuple, sym.collect()))
    for parts in (1, 3, 50):
        for balance in ("vertices", "edges"):
            got = csr.read_csr(spark, path, width, parts, balance)
            assert sorted((r[0], r[1]) for r in got.collect()) == want
    csr.write_csr(E.symmetrize(frame(spark, [])), 0, path, width)
    assert csr.read_csr(spark, path, width).count() == 0
    with open(path, "ab") as f:
        f.write(b"x")
    with pytest.raises(Exception, match="bytes"):
        csr.read_csr(spark, path, width).count()


def test_orientation_is_settled_by_degrees(spark):
    star = frame(spark, [(0, v) for v in range(1, 200)])
    assert E.settled(star) == "degree" and E.settled(frame(spark, complete(7))) == "id" and E.settled(frame(spark, [])) == "id"
    wheel = frame(spark, [(0, v) for v in range(1, 200)] + [(v, v + 1) for v in range(1, 199)])
    assert E.settled(wheel) == "degree"
    assert {T.triangle_count(wheel, s).first()[0] for s in ("array", "join", "multiplicity", "bloom_verified")} == {198}


def test_bloom_shape_and_tolerance(spark):
    assert T.bloom_shape(1000, 1e-9) == (44168, 30)
    assert T.bloom_shape(1, 0.5)[1] == 1 and T.bloom_shape(0)[0] > 0
    with pytest.raises(ValueError):
        T.bloom_shape(10, 1.0)
    edges = frame(spark, karate())
    exact = T.triangle_count(edges).first()[0]
    assert T.count_by_bloom(edges).first()[0] == exact <= T.count_by_bloom(edges, tolerance=0.5).first()[0]
    assert T.count_by_bloom_verified(edges, tolerance=0.5).first()[0] == exact


def test_owners_by_cuts_and_local_ids(spark):
    cuts = [0, 3, 3, 9, 30]
    got = spark.range(30).select(O.owner_by_cuts(F.col("id"), cuts)).collect()
    assert [r[0] for r in got] == [max(p for p, c in enumerate(cuts) if c <= v) for v in range(30)]
    rows = O.local_ids(spark.range(30), 30, 4).withColumn("back", O.global_id(F.col("local"), F.col("owner"), 30, 4)).collect()
    assert all(r["back"] == r["id"] and 0 <= r["local"] < 9 for r in rows)
    assert {(r["owner"], r["local"]) for r in rows if r["local"] == 0} == {(p, 0) for p in range(4)}


def test_command_line(spark, capsys):
    from wedgeworks.cli import main

    report = main(["-n", "64", "-l", "-P", "4", "--print"])
    assert (report["entries"], report["triangles"]) == (296, 126) and report["teps"] > 0
    assert '"triangles": 126' in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main([])
