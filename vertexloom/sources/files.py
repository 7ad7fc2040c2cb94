"""Graph files: <base>.v, .e, .properties, update files, golden results, tables of adjacency, result reports."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.functions.text import number, parse_string
from vertexloom.operators.graph import UNREACHED_DEPTH, UNREACHED_DISTANCE, Graph

#: Names of the algorithms and of their golden files.
ALGORITHMS = {"bfs": "BFS", "sssp": "SSSP", "wcc": "WCC", "pr": "PR", "cdlp": "CDLP"}


@dataclass
class GraphConfig:
    """Run parameters; the defaults hold where a file or a key is missing."""

    vertex_file: str | None = None
    edge_file: str | None = None
    vertices: str | None = None
    edges: str | None = None
    directed: bool = True
    weighted: bool = False
    sssp_weighted: bool = True  # recorded; the weights of the edge file apply either way
    algorithms: tuple[str, ...] = ()
    bfs_source: str | None = None
    sssp_source: str | None = None
    pagerank_iterations: int = 10
    damping: float = 0.85
    cdlp_iterations: int = 10
    invalid_lines: list[str] = field(default_factory=list)


_KEYS = {
    "vertex-file": ("vertex_file", str), "edge-file": ("edge_file", str), "vertices": ("vertices", str), "edges": ("edges", str), "directed": ("directed", lambda v: v != "false"),
    "names": ("weighted", lambda v: v == "weight"), "weight-property": ("sssp_weighted", lambda v: v == "weight"), "sssp-weight-property": ("sssp_weighted", lambda v: v == "weight"),
    "algorithms": ("algorithms", lambda v: tuple(a for a in v.split(", ") if a in ALGORITHMS)),
    "cdlp-max-iterations": ("cdlp_iterations", int), "max-iterations": ("cdlp_iterations", int), "pr-damping-factor": ("damping", float), "damping-factor": ("damping", float),
    "pr-num-iterations": ("pagerank_iterations", int), "num-iterations": ("pagerank_iterations", int),
}


def property_lines(lines: DataFrame) -> DataFrame:
    """lines(value) -> (value, key, setting) of all but blank and comment lines; key is null where a line is not `key = value`."""
    parts = parse_string(F.col("value"), " = ")
    rows = lines.where("value <> '' and not startswith(value, '#')").select("value", parts.alias("p"))
    good = F.size("p") == 2
    return rows.select("value", F.when(good, F.get("p", F.lit(0))).alias("key"), F.when(good, F.get("p", F.lit(1))).alias("setting"))


def read_config(spark: SparkSession, base: str) -> GraphConfig:
    """<base>.properties; a missing file gives the defaults, with every algorithm off."""
    config = GraphConfig()
    try:
        rows = property_lines(spark.read.text(f"{base}.properties")).collect()  # a few dozen lines
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return config
    for line, key, value in rows:
        if key is None:
            config.invalid_lines.append(line)
            continue
        path = key.split(".")
        if path[-1] in _KEYS:
            name, kind = _KEYS[path[-1]]
            setattr(config, name, kind(value))
        elif path[-1] == "source-vertex":
            setattr(config, "bfs_source" if len(path) > 1 and path[-2] == "bfs" else "sssp_source", value)
    return config


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, ord): a text file's lines with ascending ordinals (file part, then line)."""
    return spark.read.text(path).withColumn("ord", F.monotonically_increasing_id())


def edge_lines(lines: DataFrame) -> DataFrame:
    """lines(value, ord) -> (src, dst, weight, ord) of `src dst [weight]`; lines of one token are dropped, no weight is 1."""
    t = parse_string(F.col("value"), " ")
    rows = lines.select("ord", t.alias("t")).where(F.size("t") >= 2)
    weight = F.when(F.size("t") > 2, number(F.get("t", F.lit(2)))).otherwise(F.lit(1.0))
    return rows.select(F.get("t", F.lit(0)).alias("src"), F.get("t", F.lit(1)).alias("dst"), F.coalesce(weight, F.lit(1.0)).alias("weight"), "ord")


def read_graph(spark: SparkSession, base: str, config: GraphConfig | None = None) -> Graph:
    """<base>.v and <base>.e; a vertex name is a whole line, sources must be listed vertices."""
    config = config or read_config(spark, base)
    vertices = read_lines(spark, f"{base}.v").withColumnRenamed("value", "name")
    for name, wanted in ((config.bfs_source, "bfs"), (config.sssp_source, "sssp")):
        if wanted in config.algorithms and vertices.where(F.col("name") == name).isEmpty():
            raise ValueError(f"the {wanted} source {name!r} is no vertex")
    return Graph.from_names(edge_lines(read_lines(spark, f"{base}.e")), vertices, config.directed)


def update_lines(lines: DataFrame) -> DataFrame:
    """lines(value, ord) -> (src, dst, ord) of `op src dst`, whatever the op."""
    t = F.split(F.trim("value"), r"\s+")
    return lines.select(t.alias("t"), "ord").where(F.size("t") >= 3).select(F.get("t", F.lit(1)).alias("src"), F.get("t", F.lit(2)).alias("dst"), "ord")


def read_updates(spark: SparkSession, graph_path: str) -> tuple[DataFrame, DataFrame]:
    """The edges to add and to delete of <graph>-add-edge.txt and <graph>-delete-edge.txt."""
    return tuple(update_lines(read_lines(spark, f"{graph_path}-{kind}-edge.txt")) for kind in ("add", "delete"))


def read_golden(spark: SparkSession, base: str, algorithm: str) -> DataFrame:
    """(name, value) of <base>-<ALGO>, values as text; a line that is not two tokens has a null value."""
    t = parse_string(F.col("value"), " ")
    return spark.read.text(f"{base}-{ALGORITHMS[algorithm]}").select(F.get(t, F.lit(0)).alias("name"), F.when(F.size(t) == 2, F.get(t, F.lit(1))).alias("value"))


def golden_depth(value):
    return F.when(value == "9223372036854775807", F.lit(UNREACHED_DEPTH)).otherwise(value.try_cast("int"))


def golden_distance(value):
    return F.when(F.lower(value).isin("inf", "infinity"), F.lit(UNREACHED_DISTANCE)).otherwise(value.try_cast("double"))


def save_adjacency(graph: Graph, path: str) -> None:
    """The edge table, sorted by src in each file."""
    graph.edges.sortWithinPartitions("src", "dst").write.mode("overwrite").parquet(path)


def load_adjacency(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("src long, dst long, weight double").parquet(path)


def append_report(spark: SparkSession, rows: list[tuple[str, str]], path: str) -> None:
    """Appends a line of the second members, comma-separated, to the report in path."""
    spark.createDataFrame([tuple(v for _, v in rows)], ", ".join(f"c{k} string" for k in range(len(rows)))).coalesce(1).write.mode("append").csv(path)
