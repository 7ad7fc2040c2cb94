"""The graph: a vertex table and an edge table.

vertices(vid long, name string): dense ids in load order; removed vertices are gone.
edges(src long, dst long, weight double): one row for a (src, dst); an undirected graph holds both
directions of each edge.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vertexloom.operators.rounds import settle

#: Sentinels of unreached vertices and absent weights.
UNREACHED_DEPTH = 2147483647
UNREACHED_DISTANCE = 1.7976931348623157e308


def numbered(names: DataFrame, order: list[str], first: int | Column = 0) -> DataFrame:
    """names(name, ...) -> (vid, name): dense ids in the given order, without a single-task window.

    Ranges of the order get their offsets from a count by range; only those counts, one a partition,
    meet in one task.
    """
    rows = names.select("name", *order).repartitionByRange(*order).sortWithinPartitions(*order)
    local = rows.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33))
    local = settle(local, "numbered")  # read twice below: the ranges must not be drawn again
    sizes = local.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = sizes.select("part", before.alias("base"))
    base = F.lit(first) if isinstance(first, int) else first
    return local.join(F.broadcast(bases), "part").select((base + F.col("base") + F.col("at")).cast("long").alias("vid"), "name")


@dataclass(frozen=True)
class Graph:
    vertices: DataFrame
    edges: DataFrame
    directed: bool = True
    settled: bool = False

    def settle(self) -> Graph:
        """The same graph as tables in the shared folder, written once: iterations read it many times."""
        return self if self.settled else replace(self, vertices=settle(self.vertices, "vertices"), edges=settle(self.edges, "edges"), settled=True)

    @classmethod
    def from_edges(cls, edges: DataFrame, vertices: DataFrame | None = None, directed: bool = True) -> Graph:
        """From edges(src, dst[, weight][, ord]) with numeric ids; the id is the name. The last of repeated edges counts."""
        weight = F.col("weight").cast("double") if "weight" in edges.columns else F.lit(1.0)
        ordinal = F.col("ord") if "ord" in edges.columns else F.lit(0)
        rows = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), weight.alias("weight"), ordinal.alias("ord"))
        rows = upsert(rows if directed else mirrored(rows))
        ids = rows.select(F.col("src").alias("vid")).union(rows.select(F.col("dst").alias("vid")))
        if vertices is not None:
            ids = ids.union(vertices.select(F.col("vid").cast("long")))
        return cls(ids.distinct().select("vid", F.col("vid").cast("string").alias("name")), rows, directed)

    @classmethod
    def from_names(cls, edges: DataFrame, vertices: DataFrame | None = None, directed: bool = True) -> Graph:
        """From edges(src, dst, weight, ord) and vertices(name, ord) by name: ids in order of the vertex list, then of first use."""
        listed = edges.select(F.col("src").alias("name"), F.lit(1).alias("kind"), "ord", F.lit(0).alias("side")).union(
            edges.select(F.col("dst").alias("name"), F.lit(1).alias("kind"), "ord", F.lit(1).alias("side"))
        )
        if vertices is not None:
            listed = listed.union(vertices.select("name", F.lit(0).alias("kind"), "ord", F.lit(0).alias("side")))
        firsts = listed.groupBy("name").agg(F.min(F.struct("kind", "ord", "side")).alias("f")).select("name", "f.*")
        ids = numbered(firsts, ["kind", "ord", "side"])
        rows = to_ids(edges, ids)
        return cls(ids, upsert(rows if directed else mirrored(rows)), directed)

    def out_edges(self) -> DataFrame:
        return self.edges

    def in_edges(self) -> DataFrame:
        return self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")

    def all_edges(self) -> DataFrame:
        """In- and out-neighbours as a multiset; of an undirected graph the out-edges alone."""
        return self.edges.unionByName(self.in_edges()) if self.directed else self.edges

    def with_edges(self, edges: DataFrame) -> Graph:
        return replace(self, edges=edges, settled=False)

    def clear(self) -> Graph:
        """No edges; vertices stay."""
        return self.with_edges(self.edges.where(F.lit(False)))

    def vid_of(self, name: str) -> int:
        row = self.vertices.where(F.col("name") == name).select("vid").first()
        if row is None:
            raise ValueError(f"unknown vertex {name!r}")
        return row[0]


def to_ids(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges by name -> edges by id; edges with an unknown end are dropped."""
    a, b = vertices.select(F.col("vid").alias("src_id"), F.col("name").alias("src")), vertices.select(F.col("vid").alias("dst_id"), F.col("name").alias("dst"))
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.join(a, "src").join(b, "dst").select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), *rest)


def mirrored(edges: DataFrame) -> DataFrame:
    """Both directions of edges(src, dst, weight, ord); of one line the reverse edge is written last."""
    forth = edges.select("src", "dst", "weight", (F.col("ord") * 2).alias("ord"))
    return forth.union(edges.select("dst", "src", "weight", F.col("ord") * 2 + 1))


def upsert(edges: DataFrame) -> DataFrame:
    """The last row of each (src, dst) by ord; of equal ord the largest weight."""
    return edges.groupBy("src", "dst").agg(F.max(F.struct("ord", "weight")).alias("last")).select("src", "dst", F.col("last.weight").alias("weight"))


def degrees(graph: Graph, direction: str = "out") -> DataFrame:
    """(vid, degree) of every vertex; "all" adds in and out."""
    edges = {"out": graph.out_edges, "in": graph.in_edges, "all": lambda: graph.edges.unionByName(graph.in_edges())}[direction]()
    counts = edges.groupBy(F.col("src").alias("vid")).agg(F.count("*").alias("degree"))
    return graph.vertices.select("vid").join(counts, "vid", "left").select("vid", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def sinks(graph: Graph) -> DataFrame:
    return graph.vertices.select("vid").join(graph.edges.select(F.col("src").alias("vid")), "vid", "left_anti")


def edge_number(graph: Graph) -> int:
    return graph.edges.count()


def size(graph: Graph) -> int:
    return graph.vertices.count()


def contain_edges(graph: Graph, pairs: DataFrame) -> DataFrame:
    """pairs(src, dst) -> (src, dst, found, weight); an absent edge has the largest double."""
    known = graph.edges.select("src", "dst", F.col("weight").alias("known"))
    return pairs.join(known, ["src", "dst"], "left").select("src", "dst", F.col("known").isNotNull().alias("found"), F.coalesce("known", F.lit(UNREACHED_DISTANCE)).alias("weight"))


def neighbour_positions(graph: Graph) -> DataFrame:
    """(src, dst, position): the place of dst in src's list by id, from 0."""
    return graph.edges.select("src", "dst", (F.row_number().over(Window.partitionBy("src").orderBy("dst")) - 1).alias("position"))


def adjacency(graph: Graph) -> DataFrame:
    """(src, neighbours) with neighbours an array of (dst, weight) by dst."""
    return graph.edges.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("dst", "weight"))).alias("neighbours"))


def csr_offsets(graph: Graph, direction: str = "out") -> DataFrame:
    """(vid, start, end): rows of the edge table sorted by (src, dst) that belong to a vertex.

    Offsets are prefix sums by range of ids, whose totals alone meet in one task.
    """
    rows = settle(degrees(graph, direction).repartitionByRange("vid").withColumn("part", F.spark_partition_id()), "offsets")
    inner = F.sum("degree").over(Window.partitionBy("part").orderBy("vid").rowsBetween(Window.unboundedPreceding, 0))
    totals = rows.groupBy("part").agg(F.sum("degree").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = totals.select("part", before.alias("base"))
    ends = rows.withColumn("inner", inner).join(F.broadcast(bases), "part").withColumn("end", F.col("base") + F.col("inner"))
    return ends.select("vid", (F.col("end") - F.col("degree")).alias("start"), "end")


def csr_columns(graph: Graph, direction: str = "out") -> DataFrame:
    """(position, vid, neighbour, weight): the rows that csr_offsets counts, sorted by vertex and neighbour; "all" holds in- and out-neighbours."""
    edges = {"out": graph.out_edges, "in": graph.in_edges, "all": lambda: graph.edges.unionByName(graph.in_edges())}[direction]()
    nth = F.row_number().over(Window.partitionBy("vid").orderBy("neighbour", "weight")) - 1
    rows = edges.select(F.col("src").alias("vid"), F.col("dst").alias("neighbour"), "weight").withColumn("nth", nth)
    return rows.join(csr_offsets(graph, direction), "vid").select((F.col("start") + F.col("nth")).alias("position"), "vid", "neighbour", "weight")


def packed_keys(edges: DataFrame) -> DataFrame:
    """(key, weight): src in the upper and dst in the lower 32 bits."""
    return edges.select(F.shiftleft("src", 32).bitwiseOR(F.col("dst")).alias("key"), "weight")


def named(graph: Graph, result: DataFrame, *labels: str) -> DataFrame:
    """result(vid, ...) by name; columns among labels hold ids and become names, null where there is none."""
    out = result.join(graph.vertices, "vid")
    for label in labels:
        names = graph.vertices.select(F.col("vid").alias(label), F.col("name").alias(label + "_name"))
        out = out.join(names, label, "left").drop(label).withColumnRenamed(label + "_name", label)
    return out.select("name", *[c for c in result.columns if c != "vid"])
