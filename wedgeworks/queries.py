"""Registry of the engine's queries and of their SQL oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wedgeworks.functions.columns import lehmer
from wedgeworks.operators import edges as E
from wedgeworks.operators import ownership as O
from wedgeworks.operators import stats as S
from wedgeworks.operators import wedges as W
from wedgeworks.oracles import ORACLES
from wedgeworks.plans import triangles as T
from wedgeworks.plans.alike import count_by_groups
from wedgeworks.sources import csr, derived, geometric

#: Parts of the ownership queries; points of the geometric ones; radius of the embedding graph.
PARTS, POINTS, EMBEDDING_RADIUS, EXTRA_PERCENT = 4, 256, 1.2, 10.0
#: Parts of the query on neighbouring parts; strips of the query on strips.
MANY_PARTS, STRIPS = 512, 4
__all__ = ["ORACLES", "QUERIES"]


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.part_coorder(spark, sf_dir)


def _sym(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.symmetrize(_edges(spark, sf_dir))


def _nv(spark: SparkSession, sf_dir: str) -> int:
    """A bound above every part id, from the table's column alone."""
    return (derived.table(spark, sf_dir, "lineitem").agg(F.max("l_partkey")).first()[0] or -1) + 1


def _work_path(spark: SparkSession, name: str) -> str:
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir() or f"{spark.conf.get('spark.sql.warehouse.dir')}/_graphs"
    return f"{base.removeprefix('file:')}/{name}-{uuid.uuid4().hex}"


def _counting(strategy: str):
    return lambda spark, sf_dir: T.triangle_count(_edges(spark, sf_dir), strategy)


def _on_graph(graph, count):
    return lambda spark, sf_dir: count(graph(spark, sf_dir))


def _owned(operator):
    return lambda spark, sf_dir: operator(_sym(spark, sf_dir), _nv(spark, sf_dir), PARTS)


def _owned_closed(operator):
    def run(spark, sf_dir):
        found = T.triangles(_edges(spark, sf_dir), "id")
        return operator(_sym(spark, sf_dir), found, _nv(spark, sf_dir), PARTS)

    return run


def canonicalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw pairs of an order's lines, with loops, repeats and reversals, made canonical."""
    rows = derived.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    a = rows.select("l_orderkey", F.col("l_partkey").alias("src"), F.col("l_linenumber").alias("_i"))
    b = rows.select("l_orderkey", F.col("l_partkey").alias("dst"), F.col("l_linenumber").alias("_j"))
    return E.canonicalize(a.join(b, "l_orderkey").where("_i <= _j").select("src", "dst"))


def _cuts(spark: SparkSession, sym: DataFrame, nv: int) -> list[int]:
    offsets = S.csr_offsets(sym, nv).persist()
    cuts = O.balanced_cuts(offsets, sym.count(), nv, PARTS)
    offsets.unpersist()
    return cuts


def partition_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    sym = _sym(spark, sf_dir).persist()
    cuts = _cuts(spark, sym, _nv(spark, sf_dir))
    sym.unpersist()
    return spark.createDataFrame(list(enumerate(cuts)), "part long, first_id long")


def balanced_cut_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries by their ends' owners, the parts being cut anew to near-equal entries."""
    sym = _sym(spark, sf_dir)
    return O.cut_matrix(sym, _cuts(spark, sym, _nv(spark, sf_dir)))


def local_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    nv = _nv(spark, sf_dir)
    return O.local_ids(spark.range(nv), nv, PARTS)


def wedge_adjacent_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.adjacent_wedge_count(_sym(spark, sf_dir), _nv(spark, sf_dir), MANY_PARTS)


def boundary_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.boundary_edges(_sym(spark, sf_dir), _nv(spark, sf_dir), PARTS).agg(F.count("*").alias("entries"))


def lcg_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(5000).select(F.col("id").alias("k"), lehmer(F.col("id")).alias("x"))


def rgg_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometric.geometric_edges(spark, POINTS, unit_weight=False)


def rgg_random_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometric.random_edges(spark, geometric.geometric_edges(spark, POINTS), POINTS, EXTRA_PERCENT, unit_weight=False)


def rgg_strip_random_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In strips; random edges that stay near weigh their length."""
    edges = geometric.geometric_edges(spark, POINTS, unit_weight=False, strips=STRIPS)
    return geometric.random_edges(spark, edges, POINTS, EXTRA_PERCENT, False, geometric.points(spark, POINTS, strips=STRIPS), STRIPS)


def embedding_radius_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometric.embedding_edges(derived.table(spark, sf_dir, "embeddings"), EMBEDDING_RADIUS)


def triangle_count_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An hour's users are many: from the hours, or where these are small from lists of neighbours."""
    rows, group = derived.user_hour(spark, sf_dir)
    counts = count_by_groups(rows, group, "user_id")
    return T.count_by_lists(derived.neighbour_lists(rows, group, "user_id")) if counts is None else T.summed(counts)


def csr_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as a file, read back in slices of near-equal entries."""
    path = _work_path(spark, "graph") + ".bin"
    csr.write_csr(_sym(spark, sf_dir), _nv(spark, sf_dir), path)
    return csr.read_csr(spark, path, balance="edges")


QUERIES: dict = {
    "triangle_count": _counting("array"),
    "triangle_count_ordered": lambda spark, sf_dir: T.count_by_arrays(_edges(spark, sf_dir), "id"),
    "triangle_count_join": _counting("join"),
    "triangle_count_hash": _counting("hash"),
    "triangle_count_broadcast": _counting("broadcast"),
    "triangle_count_preagg": _counting("multiplicity"),
    "triangle_count_pruned": _counting("pruned"),
    "triangle_count_raw": lambda spark, sf_dir: T.count_raw(_sym(spark, sf_dir)),
    "triangle_count_bloom": _counting("bloom"),
    "triangle_count_bloom_verified": _counting("bloom_verified"),
    "triangle_count_suppliers": _on_graph(derived.supp_coorder, T.count_by_arrays),
    "triangle_count_bipartite": _on_graph(derived.part_supp, T.count_by_arcs),
    "triangle_count_users": triangle_count_users,
    "closing_edges_distinct": _on_graph(_edges, T.closing_edges),
    "wedge_count": _on_graph(_sym, W.wedge_count),
    "wedge_pruned_count": _on_graph(_sym, W.pruned_wedge_count),
    "wedge_adjacent_count": wedge_adjacent_count,
    "wedge_locality": _owned_closed(W.wedge_locality),
    "wedge_status_by_owner": _owned_closed(W.wedge_status_by_owner),
    "wedges_per_vertex": _owned(W.wedges_per_vertex),
    "ghost_counts": _owned(W.ghost_counts),
    "owner_cut_matrix": _owned(O.owner_cut_matrix),
    "process_degree": _owned(O.process_degree),
    "boundary_edges": boundary_edges,
    "partition_balanced": partition_balanced,
    "balanced_cut_matrix": balanced_cut_matrix,
    "local_ids": local_ids,
    "degree": _on_graph(_sym, S.degree),
    "edge_range": _on_graph(_sym, S.edge_range),
    "csr_offsets": lambda spark, sf_dir: S.csr_offsets(_sym(spark, sf_dir), _nv(spark, sf_dir)),
    "dist_stats": _owned(S.dist_stats),
    "canonicalize": canonicalize,
    "symmetrize": _sym,
    "lcg_stream": lcg_stream,
    "rgg_edges": rgg_edges,
    "rgg_random_edges": rgg_random_edges,
    "rgg_strip_random_edges": rgg_strip_random_edges,
    "embedding_radius_graph": embedding_radius_graph,
    "csr_roundtrip": csr_roundtrip,
}
