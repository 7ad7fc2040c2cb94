"""Breadth-first search, shortest paths, and paths from predecessors.

Every round expands the frontier alone: frontier rows meet the out-edges by src, candidates are
combined by dst before the shuffle, and what improves is the next frontier. Every few rounds what is known
becomes one table in the shared folder.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.operators.graph import UNREACHED_DEPTH, UNREACHED_DISTANCE, Graph
from vertexloom.operators.rounds import EVERY, Rounds, settle


def _source(graph: Graph, source: int) -> DataFrame:
    start = graph.vertices.where(F.col("vid") == source).select("vid")
    if start.isEmpty():
        raise ValueError(f"unknown source {source!r}")
    return start


def bfs(graph: Graph, source: int, min_depth: int = 0, max_depth: int = UNREACHED_DEPTH) -> DataFrame:
    """(vid, depth, pred): hops along out-edges, at most max_depth; pred is the smallest parent, null without one.

    min_depth is accepted and has no effect.
    """
    graph = graph.settle()
    found = frontier = settle(_source(graph, source).select("vid", F.lit(0).alias("depth"), F.lit(None).cast("long").alias("pred")))
    depth = 0
    while depth < max_depth:
        depth += 1
        near = frontier.select(F.col("vid").alias("src")).join(graph.edges.select("src", "dst"), "src").groupBy(F.col("dst").alias("vid")).agg(F.min("src").alias("pred"))
        frontier = settle(near.join(found.select("vid"), "vid", "left_anti").select("vid", F.lit(depth).alias("depth"), "pred"))
        if frontier.isEmpty():
            break
        found = found.union(frontier)
        if depth % EVERY == 0:  # one table of what was found, so that plans do not grow with the depth
            found = settle(found)
    out = graph.vertices.select("vid").join(found, "vid", "left")
    return out.select("vid", F.coalesce("depth", F.lit(UNREACHED_DEPTH)).cast("int").alias("depth"), "pred")


def sssp(graph: Graph, source: int, max_distance: float = UNREACHED_DISTANCE) -> DataFrame:
    """(vid, dist, pred): least weight along out-edges; vertices beyond max_distance are unreached.

    Weights must not be negative. A predecessor changes only with a strictly shorter path, so zero
    weights close no cycle of predecessors; among equally short new paths the smallest src counts.
    """
    graph = graph.settle()
    if not graph.edges.where("weight < 0 or weight is null or isnan(weight)").isEmpty():
        raise ValueError("weights must be numbers that are not negative")
    edges, step = graph.edges.select("src", "dst", "weight"), 0
    frontier = settle(_source(graph, source).select("vid", F.lit(0.0).alias("dist"), F.lit(None).cast("long").alias("pred"), F.lit(0).alias("step")))
    deltas = [frontier]

    def state() -> DataFrame:
        """Of what the rounds since the last table found, each vertex's last."""
        return functools.reduce(DataFrame.union, deltas).groupBy("vid").agg(F.max(F.struct("step", "dist", "pred")).alias("s")).select("vid", "s.dist", "s.pred", "s.step")

    while True:
        step += 1
        steps = frontier.select(F.col("vid").alias("src"), "dist").join(edges, "src").select(F.col("dst").alias("vid"), (F.col("dist") + F.col("weight")).alias("dist"), F.col("src").alias("pred"))
        best = steps.where(F.col("dist") < max_distance).groupBy("vid").agg(F.min(F.struct("dist", "pred")).alias("b")).select("vid", "b.*")
        old = state().select("vid", F.col("dist").alias("old"))
        frontier = settle(best.join(old, "vid", "left").where("old is null or dist < old").select("vid", "dist", "pred", F.lit(step).alias("step")))
        if frontier.isEmpty():
            break
        deltas.append(frontier)
        if len(deltas) > EVERY:
            deltas[:] = [settle(state())]
    out = graph.vertices.select("vid").join(state(), "vid", "left")
    return out.select("vid", F.coalesce("dist", F.lit(UNREACHED_DISTANCE)).alias("dist"), "pred")


def path_query(graph: Graph, preds: DataFrame, source: int, target: int) -> DataFrame:
    """preds(vid, pred) -> (hop, from_vid, to_vid) from source to target, hops from 1; no rows without a path or for source itself.

    Predecessors lead to the source by pointer doubling: after k rounds each vertex knows the vertex 2**k
    hops before it, and the target has marked 2**k vertices of its path.
    """
    rounds = Rounds()
    edges = settle(preds.where("pred is not null").select("vid", "pred"))
    jumps, way = edges, rounds.keep(graph.vertices.where(F.col("vid") == target).select("vid", F.lit(0).cast("long").alias("back")))
    span, seen = 1, way.count()
    while seen:
        ahead = way.join(jumps, "vid").select(F.col("pred").alias("vid"), (F.col("back") + span).alias("back"))
        way = rounds.turn(way.union(ahead).distinct())
        after = way.count()
        if after == seen:
            break
        further = jumps.select(F.col("vid").alias("pred"), F.col("pred").alias("far"))
        jumps, span, seen = rounds.keep(jumps.join(further, "pred").select("vid", F.col("far").alias("pred"))), 2 * span, after
    # Where the walk stops at another vertex than source, there is no path from source.
    length = way.where((F.col("vid") == source) & (F.col("back") > 0)).agg(F.coalesce(F.min("back"), F.lit(0))).first()[0]  # one number
    hops = way.join(edges, "vid").where(F.col("back") < length)
    return rounds.end(hops.select((F.lit(length) - F.col("back")).cast("int").alias("hop"), F.col("pred").alias("from_vid"), F.col("vid").alias("to_vid")))
