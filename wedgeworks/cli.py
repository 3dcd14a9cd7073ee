"""Command line: count the triangles of a file or of a generated graph."""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import SparkSession

from wedgeworks.operators.edges import canonicalize, listing, symmetrize
from wedgeworks.operators.stats import dist_stats, vertex_bound
from wedgeworks.plans.triangles import STRATEGIES, triangle_count
from wedgeworks.sources.csr import read_csr
from wedgeworks.sources.geometric import geometric_edges, random_edges


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="wedgeworks")
    p.add_argument("-f", "--file", help="binary CSR file")
    p.add_argument("-b", "--balanced", action="store_true", help="slices of near-equal entries")
    p.add_argument("-w", "--width", type=int, choices=(32, 64), default=64, help="bits of the file's integers")
    p.add_argument("-n", "--points", type=int, help="generate a geometric graph of this many points")
    p.add_argument("-l", "--stream", action="store_true", help="points from the fixed stream")
    p.add_argument("-p", "--percent", type=float, default=0.0, help="random edges to add, in percent")
    p.add_argument("-P", "--parts", type=int, default=8, help="parts to read and report by")
    p.add_argument("-s", "--strategy", choices=sorted(STRATEGIES), default="array")
    p.add_argument("--print", action="store_true", dest="show", help="list the entries (at most 100000)")
    return p


def main(argv: list[str] | None = None) -> dict:
    args = parser().parse_args(argv)
    if (args.file is None) == (args.points is None):
        parser().error("give a file or a number of points")
    spark = SparkSession.builder.appName("wedgeworks").getOrCreate()
    began = time.perf_counter()
    if args.file:
        rows = read_csr(spark, args.file, args.width, args.parts, "edges" if args.balanced else "vertices")
        edges = canonicalize(rows, "head", "tail")
    else:
        edges = geometric_edges(spark, args.points, None if args.stream else 1)
        if args.percent:
            edges = random_edges(spark, edges, args.points, args.percent)
        edges = edges.select("src", "dst")
    edges = edges.persist()
    directed = 2 * edges.count()
    loaded = time.perf_counter()
    count = triangle_count(edges, args.strategy).first()[0]
    counted = time.perf_counter() - loaded
    symmetric = symmetrize(edges)
    nv = args.points or vertex_bound(symmetric)
    report = {"vertices": nv, "entries": directed, "triangles": count, "load_s": loaded - began, "count_s": counted, "teps": directed / counted}
    if nv:
        report["distribution"] = dist_stats(symmetric, nv, args.parts).first().asDict()
    if args.show:
        listing(symmetric).show(100_000, truncate=False)
    edges.unpersist()
    print(json.dumps(report))
    return report


if __name__ == "__main__":
    main()
