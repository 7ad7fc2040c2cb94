"""Runs the enabled algorithms of a graph in files, checks them, and appends a line to the report.

python -m vertexloom.plans.runner BASE [--report DIR]
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession

from vertexloom.operators import analytics, check, traverse
from vertexloom.operators.graph import Graph, named
from vertexloom.sources.files import ALGORITHMS, GraphConfig, append_report, read_config, read_golden, read_graph

_CHECKS = {"bfs": check.check_bfs, "sssp": check.check_sssp, "wcc": check.check_wcc, "pr": check.check_pagerank, "cdlp": check.check_cdlp}


def solve(graph: Graph, algorithm: str, config: GraphConfig) -> DataFrame:
    """An algorithm's result by name."""
    if algorithm == "bfs":
        return named(graph, traverse.bfs(graph, graph.vid_of(config.bfs_source)).select("vid", "depth"))
    if algorithm == "sssp":
        return named(graph, traverse.sssp(graph, graph.vid_of(config.sssp_source)).select("vid", "dist"))
    if algorithm == "wcc":
        return named(graph, analytics.wcc(graph), "component")
    if algorithm == "pr":
        return named(graph, analytics.pagerank(graph, config.pagerank_iterations, config.damping))
    return named(graph, analytics.cdlp(graph, config.cdlp_iterations), "label")


def run(spark: SparkSession, base: str, report: str | None = None) -> list[tuple[str, str]]:
    """(algorithm, seconds | wrong | failed! | N/A) in the usual order; the time excludes loading and includes the names."""
    config = read_config(spark, base)
    graph = read_graph(spark, base, config).settle()
    rows = []
    for algorithm in ALGORITHMS:
        if algorithm not in config.algorithms:
            rows.append((algorithm, "N/A"))
            continue
        try:
            began = time.time()
            result = solve(graph, algorithm, config).cache()
            result.count()
            took = time.time() - began
            rows.append((algorithm, f"{took:.3f}" if _CHECKS[algorithm](result, read_golden(spark, base, algorithm)) == 0 else "wrong"))
            result.unpersist()
        except Exception as error:  # the report shows it, the others still run
            print(f"{algorithm}: {error}")
            rows.append((algorithm, "failed!"))
    if report:
        append_report(spark, rows, report)
    return rows


if __name__ == "__main__":
    parser = argparse.ArgumentParser()
    parser.add_argument("base")
    parser.add_argument("--report")
    options = parser.parse_args()
    for name, value in run(SparkSession.builder.getOrCreate(), options.base, options.report):
        print(name, value)
