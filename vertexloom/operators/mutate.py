"""Graph updates; each returns a new graph."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.operators.graph import Graph, mirrored, numbered, to_ids, upsert


def add_vertices(graph: Graph, names: DataFrame) -> Graph:
    """Adds names(name[, ord]); known names change nothing, new ones get the next ids in order."""
    order = "ord" if "ord" in names.columns else "name"
    new = names.groupBy("name").agg(F.min(order).alias("at")).join(graph.vertices, "name", "left_anti")
    first = graph.vertices.agg(F.coalesce(F.max("vid") + 1, F.lit(0))).first()[0]
    return replace(graph, vertices=graph.vertices.unionByName(numbered(new, ["at"], first)), settled=False)


def remove_incident_edges(graph: Graph, vids: DataFrame) -> Graph:
    """Drops all edges of vids(vid)."""
    gone = vids.select("vid").distinct()
    edges = graph.edges.join(gone.withColumnRenamed("vid", "src"), "src", "left_anti").join(gone.withColumnRenamed("vid", "dst"), "dst", "left_anti")
    return graph.with_edges(edges.select("src", "dst", "weight"))


def remove_vertices(graph: Graph, names: DataFrame) -> Graph:
    """Removes names(name) with their edges; unknown names change nothing."""
    gone = graph.vertices.join(names.select("name"), "name", "left_semi")
    return replace(remove_incident_edges(graph, gone), vertices=graph.vertices.join(names.select("name"), "name", "left_anti").select("vid", "name"))


def add_edges(graph: Graph, edges: DataFrame) -> Graph:
    """Upserts edges(src, dst[, weight][, ord]) by id; later ord wins, and wins over what was there."""
    weight = F.col("weight").cast("double") if "weight" in edges.columns else F.lit(1.0)
    ordinal = F.col("ord").cast("long") if "ord" in edges.columns else F.lit(0).cast("long")
    rows = edges.select("src", "dst", weight.alias("weight"), ordinal.alias("ord"))
    old = graph.edges.select("src", "dst", "weight", F.lit(-(2**62)).alias("ord"))
    return graph.with_edges(upsert(old.union(rows if graph.directed else mirrored(rows))))


def add_named_edges(graph: Graph, edges: DataFrame) -> Graph:
    """Upserts edges(src, dst, weight, ord) by name; unknown ends become vertices, in order of first use."""
    sides = [edges.select(F.col(c).alias("name"), (F.col("ord") * 2 + k).alias("ord")) for k, c in enumerate(("src", "dst"))]
    grown = add_vertices(graph, sides[0].union(sides[1]))
    return add_edges(grown, to_ids(edges, grown.vertices))


def remove_edges(graph: Graph, pairs: DataFrame) -> Graph:
    """Drops pairs(src, dst) by id; absent ones change nothing."""
    pairs = pairs.select("src", "dst")
    if not graph.directed:
        pairs = pairs.union(pairs.select("dst", "src"))
    return graph.with_edges(graph.edges.join(pairs, ["src", "dst"], "left_anti").select("src", "dst", "weight"))


def remove_named_edges(graph: Graph, pairs: DataFrame) -> Graph:
    return remove_edges(graph, to_ids(pairs.select("src", "dst"), graph.vertices))


def batch_update(graph: Graph, batch: DataFrame) -> Graph:
    """Applies batch(op, src, dst, weight, ord) by id at once: of each edge the last row counts, op "delete" or "add"."""
    rows = batch.select("src", "dst", "weight", "ord", (F.col("op") == "delete").alias("gone"))
    if not graph.directed:
        rows = rows.select("src", "dst", "weight", (F.col("ord") * 2).alias("ord"), "gone").union(rows.select("dst", "src", "weight", F.col("ord") * 2 + 1, "gone"))
    last = rows.groupBy("src", "dst").agg(F.max_by(F.struct("weight", "gone"), "ord").alias("u")).select("src", "dst", "u.*")
    kept = graph.edges.join(last, ["src", "dst"], "left_anti").select("src", "dst", "weight")
    return graph.with_edges(kept.union(last.where("not gone").select("src", "dst", "weight")))
