"""The graph queries, each with an equivalent DuckDB query over the same tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.functions.text import parse_string
from vertexloom.operators import analytics, check, graph as g, mutate, traverse
from vertexloom.operators.rounds import shared_folder
from vertexloom.sources import derived, files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
GRAPHS = ("trade", "geo", "flow")
_MAX = "1.7976931348623157e308"


def _add(name: str, sql: str):
    def register(f):
        QUERIES[name] = f
        ORACLES[name] = sql
        return f

    return register


def _start(name: str, more: str = "") -> str:
    return f"""with recursive e as materialized ({derived.edges_sql(name)}), v as materialized (select src vid from e union select dst from e){more}
"""


def _of(name: str, op: Callable[[g.Graph], DataFrame], directed: bool = True):
    return lambda spark, sf_dir: op(derived.load(spark, sf_dir, name, directed).settle())


def _plain(name: str, graph: str, op: Callable[[g.Graph], DataFrame], select: str, directed: bool = True, more: str = "") -> None:
    QUERIES[name] = _of(graph, op, directed)
    ORACLES[name] = _start(graph, more) + select


def _first(graph: g.Graph) -> int:
    return graph.vertices.agg(F.min("vid")).first()[0]


def _rows(graph: g.Graph, where: str, *columns: str) -> DataFrame:
    return graph.edges.where(where).select(*columns)


# Tables and point lookups.
_plain("vertices", "trade", lambda x: x.vertices, "select vid, cast(vid as varchar) name from v")
_plain("edges_dedup", "flow", lambda x: x.edges, "select src, dst, weight from e")
_plain("out_degree", "flow", lambda x: g.degrees(x, "out"), "select vid, count(src) degree from v left join e on vid = src group by vid")
_plain("in_degree", "trade", lambda x: g.degrees(x, "in"), "select vid, count(dst) degree from v left join e on vid = dst group by vid")
_plain("degree_all", "geo", lambda x: g.degrees(x, "all"), "select vid, (select count(*) from e where src = vid) + (select count(*) from e where dst = vid) degree from v")
_plain("edge_count", "trade", lambda x: x.edges.agg(F.count("*").alias("n_edges")), "select count(*) n_edges from e")
_plain("vertex_count", "flow", lambda x: x.vertices.agg(F.count("*").alias("n_vertices")), "select count(*) n_vertices from v")
_plain("sinks", "trade", g.sinks, "select vid from v where vid not in (select src from e)")
_plain("neighbor_position", "flow", g.neighbour_positions, "select src, dst, cast(row_number() over (partition by src order by dst) - 1 as integer) \"position\" from e")
_plain(
    "adjacency_dump", "geo", lambda x: g.adjacency(x).select("src", F.array_join(F.transform("neighbours", lambda n: F.concat(n.dst.cast("string"), F.lit(":"), n.weight.cast("int").cast("string"))), ",").alias("neighbours")),
    "select src, string_agg(dst || ':' || cast(weight as int), ',' order by dst) neighbours from e group by src",
)
_plain("csr_offsets", "flow", g.csr_offsets, "select vid, cast(sum(n) over (order by vid) - n as bigint) \"start\", cast(sum(n) over (order by vid) as bigint) \"end\" from (select vid, count(src) n from v left join e on vid = src group by vid)")
_plain("edge_key_pack", "flow", lambda x: g.packed_keys(x.edges), "select src * 4294967296 + dst \"key\", weight from e")
_plain("symmetrize", "geo", lambda x: x.all_edges(), "select src, dst, weight from e union all select dst, src, weight from e")
_plain("undirected_edges", "flow", lambda x: x.edges.select("src", "dst"), "select src, dst from e union select dst, src from e", directed=False)
_plain("clear_edges", "geo", lambda x: g.degrees(x.clear()), "select vid, cast(0 as bigint) degree from v")
_pairs = lambda x: x.edges.where("src % 3 = 0").select("src", "dst").union(x.edges.where("src % 3 = 1").select("dst", "src"))
_asked = "select src, dst from e where src % 3 = 0 union all select dst, src from e where src % 3 = 1"
_plain("contain_edge", "flow", lambda x: g.contain_edges(x, _pairs(x)).select("src", "dst", "found"), f"select q.src, q.dst, e.src is not null found from ({_asked}) q left join e on q.src = e.src and q.dst = e.dst")
_plain("edge_weight_lookup", "flow", lambda x: g.contain_edges(x, _pairs(x)).select("src", "dst", "weight"), f"select q.src, q.dst, coalesce(weight, {_MAX}) weight from ({_asked}) q left join e on q.src = e.src and q.dst = e.dst")

# Updates.
_new = lambda x: x.vertices.where("vid % 2 = 0").select((F.col("vid") * 7).cast("string").alias("name"), (F.col("vid") * 7).alias("ord"))
_plain(
    "add_vertices", "flow", lambda x: mutate.add_vertices(x, _new(x)).vertices,
    "select vid, cast(vid as varchar) name from v union all select (select max(vid) from v) + row_number() over (order by vid * 7), cast(vid * 7 as varchar) from v where vid % 2 = 0 and vid * 7 not in (select vid from v)",
)
_added = lambda x: x.edges.where("src % 5 = 0").select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("weight") + 1).alias("weight"))
_a = "select dst src, src dst, weight + 1 weight from e where src % 5 = 0"
_plain("add_edges", "flow", lambda x: mutate.add_edges(x, _added(x)).edges, f"select src, dst, weight from e anti join ({_a}) a using (src, dst) union all {_a}")
_plain("remove_edges", "flow", lambda x: mutate.remove_edges(x, _rows(x, "dst % 4 = 0", "src", "dst")).edges, "select src, dst, weight from e where dst % 4 <> 0")
_plain("remove_edges_undirected", "geo", lambda x: mutate.remove_edges(x, _rows(x, "dst % 4 = 0", "src", "dst")).edges.select("src", "dst"), "select src, dst from (select src, dst from e union select dst, src from e) where dst % 4 <> 0 and src % 4 <> 0", directed=False)
_gone = lambda x: mutate.remove_vertices(x, x.vertices.where("vid % 10 = 3").select("name"))
_plain("remove_vertex", "flow", lambda x: _gone(x).edges.select(F.concat_ws("-", "src", "dst").alias("item")).union(_gone(x).vertices.select("name")), "select src || '-' || dst item from e where src % 10 <> 3 and dst % 10 <> 3 union all select cast(vid as varchar) from v where vid % 10 <> 3")
_plain("remove_incident_edges", "trade", lambda x: mutate.remove_incident_edges(x, x.vertices.where("vid % 10 = 3")).edges, "select src, dst, weight from e where src % 10 <> 3 and dst % 10 <> 3")
_batch = lambda x: _added(x).withColumn("op", F.lit("add")).withColumn("ord", F.lit(1)).unionByName(
    _rows(x, "dst % 4 = 0", "src", "dst").withColumn("weight", F.lit(0.0)).withColumn("op", F.lit("delete")).withColumn("ord", F.lit(2))
)
_updated = f", u as materialized (select src, dst, weight from e anti join ({_a}) a using (src, dst) where dst % 4 <> 0 union all select a.src, a.dst, a.weight from ({_a}) a anti join (select src, dst from e where dst % 4 = 0) d using (src, dst))"
_plain("batch_update", "flow", lambda x: mutate.batch_update(x, _batch(x)).edges, "select src, dst, weight from u", more=_updated)


# Lines of files.
@_add("parse_string", "select event_id, len(p) n, p[1] first_part, p[len(p)] last_part from (select event_id, string_split(props, ':') p from events)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", parse_string(F.col("props"), ":").alias("p"))
    return rows.select("event_id", F.size("p").alias("n"), F.element_at("p", 1).alias("first_part"), F.element_at("p", -1).alias("last_part"))


@_add("parse_properties", "select 'graph.' || n_name || '.nation' \"key\", cast(n_nationkey as varchar) setting from nation where n_nationkey % 3 = 0")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = F.col("n_name"), F.col("n_nationkey").cast("string")
    line = F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("graph."), n, F.lit(".nation = "), k)).when(F.col("n_nationkey") % 3 == 1, F.concat(F.lit("# "), n)).otherwise(F.concat(n, F.lit("="), k))
    return files.property_lines(spark.read.parquet(f"{sf_dir}/nation.parquet").select(line.alias("value"))).where("key is not null").select("key", "setting")


@_add("edge_line_parse", "select cast(c_custkey as varchar) src, cast(c_nationkey as varchar) dst, cast(case when c_custkey % 2 = 0 then c_custkey / 2 else 1 end as double) weight from customer where c_custkey % 5 <> 0")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    line = F.when(c % 5 == 0, c.cast("string")).when(c % 2 == 0, F.concat_ws(" ", c, "c_nationkey", (c / 2).cast("string"))).otherwise(F.concat_ws(" ", c, "c_nationkey"))
    return files.edge_lines(spark.read.parquet(f"{sf_dir}/customer.parquet").select(line.alias("value"), c.alias("ord"))).select("src", "dst", "weight")


# Analytics.
def _bfs_sql(name: str, most: int = 12) -> str:
    return _start(name, f""", b(vid, depth) as (select min(vid), 0 from v union select e.dst, depth + 1 from b join e on e.src = b.vid where depth < {most}),
h as materialized (select vid, min(depth) depth from b group by vid)""")  # fmt: skip


def _sssp_sql(name: str, most: str = _MAX, rounds: int = 20) -> str:
    steps = ", d0 as materialized (select min(vid) vid, cast(0 as double) dist from v)"
    for k in range(rounds):
        steps += f", d{k + 1} as materialized (select vid, min(dist) dist from (select * from d{k} union all select e.dst, d.dist + e.weight from d{k} d join e on e.src = d.vid where d.dist + e.weight < {most}) group by vid)"
    return _start(name, steps + f", h as materialized (select * from d{rounds})")


def _wcc_sql(name: str, rounds: int = 12) -> str:
    steps = ", s as materialized (select src, dst from e union select dst, src from e), w0 as materialized (select vid, vid component from v)"
    for k in range(rounds):
        steps += f", w{k + 1} as materialized (select w.vid, least(min(w.component), coalesce(min(o.component), min(w.component))) component from w{k} w left join s on s.src = w.vid left join w{k} o on o.vid = s.dst group by w.vid)"
    return _start(name, steps + f", h as materialized (select * from w{rounds})")


def _rank_sql(edges: str = "e", rounds: int = 10, damping: float = 0.85) -> str:
    steps = f", o as materialized (select src, count(*) n from {edges} group by src), r0 as materialized (select vid, 1.0::double / (select count(*) from v) rank from v)"
    for k in range(rounds):
        steps += f""", r{k + 1} as materialized (select vid, (1 - {damping}::double + {damping}::double * (select coalesce(sum(rank), 0) from r{k} where vid not in (select src from o))) / (select count(*) from v) + {damping}::double * coalesce(got, 0) rank
from v left join (select dst, sum(rank / n) got from {edges} x join o using (src) join r{k} r on r.vid = x.src group by dst) on dst = vid)"""
    return steps + f", h as materialized (select * from r{rounds})"


def _cdlp_sql(rounds: int = 10, around: str = "select src, dst from e union all select dst, src from e") -> str:
    steps = f", s as materialized ({around}), l0 as materialized (select vid, vid label from v)"
    for k in range(rounds):
        steps += f""", l{k + 1} as materialized (select l.vid, coalesce(m.label, l.label) label from l{k} l left join (select src, label from (select src, label, row_number() over (partition by src order by count(*) desc, label) k from s join l{k} n on n.vid = s.dst group by src, label) where k = 1) m on m.src = l.vid)"""
    return steps + f", h as materialized (select * from l{rounds})"


_rounded = lambda df: df.select("vid", F.round("rank", 9).alias("rank"))
for _name in GRAPHS:
    QUERIES["bfs_" + _name] = _of(_name, lambda x: traverse.bfs(x, _first(x)).select("vid", "depth"))
    ORACLES["bfs_" + _name] = _bfs_sql(_name) + "select vid, cast(coalesce(depth, 2147483647) as integer) depth from v left join h using (vid)"
    QUERIES["sssp_" + _name] = _of(_name, lambda x: traverse.sssp(x, _first(x)).select("vid", "dist"))
    ORACLES["sssp_" + _name] = _sssp_sql(_name) + f"select vid, coalesce(dist, {_MAX}) dist from v left join h using (vid)"
    QUERIES["wcc_" + _name] = _of(_name, analytics.wcc)
    ORACLES["wcc_" + _name] = _wcc_sql(_name) + "select vid, component from h"
    QUERIES["pagerank_" + _name] = _of(_name, lambda x: _rounded(analytics.pagerank(x)))
    ORACLES["pagerank_" + _name] = _start(_name, _rank_sql()) + "select vid, round(rank, 9) rank from h"
    QUERIES["cdlp_" + _name] = _of(_name, analytics.cdlp)
    ORACLES["cdlp_" + _name] = _start(_name, _cdlp_sql()) + "select vid, label from h"

QUERIES["bfs_max_depth"] = _of("flow", lambda x: traverse.bfs(x, _first(x), 0, 1).select("vid", "depth"))
ORACLES["bfs_max_depth"] = _bfs_sql("flow", 1) + "select vid, cast(coalesce(depth, 2147483647) as integer) depth from v left join h using (vid)"
QUERIES["bfs_undirected"] = _of("geo", lambda x: traverse.bfs(x, _first(x)).select("vid", "depth"), False)
ORACLES["bfs_undirected"] = _start("geo", ", s as materialized (select src, dst from e union select dst, src from e), b(vid, depth) as (select min(vid), 0 from v union select s.dst, depth + 1 from b join s on s.src = b.vid where depth < 10)") + (
    "select vid, cast(coalesce(depth, 2147483647) as integer) depth from v left join (select vid, min(depth) depth from b group by vid) using (vid)"
)
_pred = ", p as materialized (select e.dst vid, min(e.src) pred from e join h a on a.vid = e.src join h b on b.vid = e.dst where b.depth = a.depth + 1 group by e.dst)"
QUERIES["bfs_pre"] = _of("flow", lambda x: traverse.bfs(x, _first(x)))
ORACLES["bfs_pre"] = _bfs_sql("flow").rstrip() + _pred + " select vid, cast(coalesce(depth, 2147483647) as integer) depth, pred from v left join h using (vid) left join p using (vid)"
QUERIES["sssp_max_dis"] = _of("flow", lambda x: traverse.sssp(x, _first(x), 30.0).select("vid", "dist"))
ORACLES["sssp_max_dis"] = _sssp_sql("flow", "30.0") + f"select vid, coalesce(dist, {_MAX}) dist from v left join h using (vid)"


def _sssp_pre(x: g.Graph) -> DataFrame:
    """Predecessors are held against the distances: each is one edge before its vertex on a shortest path."""
    found = traverse.sssp(x, _first(x))
    before = found.select(F.col("vid").alias("pred"), F.col("dist").alias("before"))
    edge = x.edges.select(F.col("src").alias("pred"), F.col("dst").alias("vid"), "weight")
    joined = found.join(before, "pred", "left").join(edge, ["pred", "vid"], "left")
    return joined.select("vid", "dist", F.col("pred").isNotNull().alias("has_pred"), F.coalesce(F.col("before") + F.col("weight") == F.col("dist"), F.col("pred").isNull()).alias("tight"))


QUERIES["sssp_pre"] = _of("flow", _sssp_pre)
ORACLES["sssp_pre"] = _sssp_sql("flow") + f"select vid, coalesce(dist, {_MAX}) dist, h.vid is not null and vid <> (select min(vid) from v) has_pred, true tight from v left join h using (vid)"


def _path(x: g.Graph) -> DataFrame:
    source = _first(x)
    return traverse.path_query(x, traverse.bfs(x, source).select("vid", "pred"), source, x.vertices.agg(F.max("vid")).first()[0])


QUERIES["path_query"] = _of("flow", _path)
ORACLES["path_query"] = _bfs_sql("flow").rstrip() + _pred + """, q(k, a, b) as (select 1, pred, vid from p where vid = (select max(vid) from v) union all select k + 1, p.pred, p.vid from q join p on p.vid = q.a)
select cast((select max(k) from q) - k + 1 as integer) hop, a from_vid, b to_vid from q"""
QUERIES["wcc_sizes"] = _of("geo", lambda x: analytics.wcc(x).groupBy("component").agg(F.count("*").alias("members")))
ORACLES["wcc_sizes"] = _wcc_sql("geo") + "select component, count(*) members from h group by component"
QUERIES["pagerank_params"] = _of("geo", lambda x: _rounded(analytics.pagerank(x, 5, 0.5)))
ORACLES["pagerank_params"] = _start("geo", _rank_sql("e", 5, 0.5)) + "select vid, round(rank, 9) rank from h"
QUERIES["pagerank_after_update"] = _of("flow", lambda x: _rounded(analytics.pagerank(mutate.batch_update(x, _batch(x)))))
ORACLES["pagerank_after_update"] = _start("flow", _updated + _rank_sql("u")) + "select vid, round(rank, 9) rank from h"
QUERIES["cdlp_undirected"] = _of("geo", analytics.cdlp, False)
ORACLES["cdlp_undirected"] = _start("geo", _cdlp_sql(around="select src, dst from e union select dst, src from e")) + "select vid, label from h"


# Checkers: results of the geo graph against goldens that plain SQL over its tables gives, some of them wrong on purpose.
_GEO = """with w as (select 2000000 + n_nationkey nation, 3000000 + n_regionkey region from nation),
p as (select c_custkey vid, 2000000 + c_nationkey nation from customer union all select 1000000 + s_suppkey, 2000000 + s_nationkey from supplier
  union all select nation, nation from w),
a as (select vid, p.nation, region from p join w on p.nation = w.nation union all select region, null, region from (select distinct region from w) r),
f as (select vid, nation, region from a where vid = (select min(vid) from a)),
g as (select cast(vid as varchar(20)) name, vid, region, vid % 50 = 0 bad,
  case vid when (select min(vid) from f) then 0 when (select min(nation) from f) then 1 when (select min(region) from f) then 2 end depth from a)
"""
_FAR = "9223372036854775807"


def _against(select: str, checker, run):
    def op(spark: SparkSession, sf_dir: str) -> DataFrame:
        graph = derived.load(spark, sf_dir, "geo").settle()
        return checker(g.named(graph, run(graph)), spark.sql(_GEO + select))

    return op


for _name, _run, _checker, _select, _wrong in (
    ("check_bfs", lambda x: traverse.bfs(x, _first(x)).select("vid", "depth"), check.bfs_mismatches,
     f"select name, case when bad then '77' else coalesce(cast(depth as varchar(20)), '{_FAR}') end value from g", "select name, cast(coalesce(depth, 2147483647) as varchar) found, '77' wanted from g where bad"),
    ("check_sssp", lambda x: traverse.sssp(x, _first(x)).select("vid", "dist"), check.sssp_mismatches,
     "select name, case when bad then '-1' else coalesce(cast(depth as varchar(20)), 'inf') end value from g",
     "select name, case when depth is null then '1.7976931348623157E308' else depth || '.0' end found, '-1.0' wanted from g where bad"),
    ("check_wcc", analytics.wcc, check.wcc_mismatches,
     "select name, case when bad then 'x' else cast(region as varchar(20)) end value from g",
     "select distinct cast(null as varchar) name, cast(first_id as varchar) found, case when bad then 'x' else cast(region as varchar) end wanted from g join (select region, min(vid) first_id from g group by region) using (region)"),
):
    QUERIES[_name], ORACLES[_name] = _against(_select, _checker, _run), _GEO + _wrong

#: A small graph's edges, and its ranks and communities after 10 rounds, three of them wrong.
_TOY = "Andy Bob,Bob Tom,Bob Sam,Andy Sam,Bob Bob,Andy Leo,Leo Sam,Sam Leo"
_TOY_RANKS = {"Andy": "0.038866419", "Bob": "0.069738565", "Tom": "0.5", "Sam": "0.400336626", "Kevin": "0.1", "Leo": "0.393489071"}
_TOY_LABELS = {"Andy": "Bob", "Bob": "Bob", "Tom": "Tom", "Sam": "Bob", "Kevin": "Kevin", "Leo": "Bob"}


def _toy(checker, run, golden: dict[str, str]):
    def op(spark: SparkSession, sf_dir: str) -> DataFrame:
        edges = spark.createDataFrame([(*e.split(), 1.0, k) for k, e in enumerate(_TOY.split(","))], "src string, dst string, weight double, ord long")
        graph = g.Graph.from_names(edges, spark.createDataFrame([(n, k) for k, n in enumerate(_TOY_RANKS)], "name string, ord long")).settle()
        return checker(run(graph), spark.createDataFrame(list(golden.items()), "name string, value string")).select("name", F.substring("found", 1, 6).alias("found"), "wanted")

    return op


QUERIES["check_pr"] = _toy(check.pagerank_mismatches, lambda x: g.named(x, analytics.pagerank(x)), _TOY_RANKS)
ORACLES["check_pr"] = "select * from (values ('Tom', '0.0587', '0.5'), ('Kevin', '0.0388', '0.1')) t(name, found, wanted)"
QUERIES["check_cdlp"] = _toy(check.cdlp_mismatches, lambda x: g.named(x, analytics.cdlp(x), "label"), _TOY_LABELS)
ORACLES["check_cdlp"] = "select * from (values ('Tom', 'Bob', 'Tom')) t(name, found, wanted)"


def _steps(sql: str) -> str:
    """What follows the vertices in a query's SQL."""
    return sql.split("union select dst from e)", 1)[1]


# Names, files, the three directions of offsets and columns.
_plain("result_to_names", "geo", lambda x: g.named(x, analytics.wcc(x), "component"), "select cast(vid as varchar) name, cast(component as varchar) component from h", more=_steps(_wcc_sql("geo")))
_csr = {"out": "select src vid, dst neighbour, weight from e", "in": "select dst vid, src neighbour, weight from e", "all": "select src vid, dst neighbour, weight from e union all select dst, src, weight from e"}
for _name, _rows_sql in _csr.items():
    _plain(f"csr_columns_{_name}", "flow", lambda x, d=_name: g.csr_columns(x, d), f"select row_number() over (order by vid, neighbour, weight) - 1 \"position\", vid, neighbour, weight from ({_rows_sql})")
    _plain(
        f"csr_offsets_{_name}", "geo", lambda x, d=_name: g.csr_offsets(x, d),
        f"select vid, cast(sum(n) over (order by vid) - n as bigint) \"start\", cast(sum(n) over (order by vid) as bigint) \"end\" from (select v.vid, count(r.vid) n from v left join ({_rows_sql}) r on r.vid = v.vid group by v.vid)",
    )


def _edges_by_name(x: g.Graph) -> DataFrame:
    ends = [x.vertices.select(F.col("vid").alias(c), F.col("name").alias(n)) for c, n in (("src", "from_name"), ("dst", "to_name"))]
    return x.edges.join(ends[0], "src").join(ends[1], "dst").select("from_name", "to_name", "weight")


def _new_names(x: g.Graph) -> DataFrame:
    return x.edges.where("src % 5 = 0").select(F.concat(F.lit("n"), "dst").alias("src"), F.col("src").cast("string").alias("dst"), "weight", (F.col("src") * 100000 + F.col("dst")).alias("ord"))


_plain(
    "add_edges_by_name", "flow", lambda x: _edges_by_name(mutate.add_named_edges(x, _new_names(x)).settle()),
    "select cast(src as varchar) from_name, cast(dst as varchar) to_name, weight from e union all select 'n' || dst, cast(src as varchar), weight from e where src % 5 = 0",
)
_plain(
    "remove_edges_by_name", "flow",
    lambda x: mutate.remove_named_edges(x, x.edges.where("src % 5 = 0").select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst")).union(x.edges.select(F.lit("nobody"), F.col("dst").cast("string")))).edges,
    "select src, dst, weight from e where src % 5 <> 0",
)


@_add(
    "names_to_ids",
    """select row_number() over (order by place) - 1 vid, name from (select name, min(place) place from (
  select n_name name, [0, n_nationkey, 0] place from nation where n_nationkey % 2 = 0
  union all select n_name, [1, c_custkey, 0] from customer join nation on n_nationkey = c_nationkey union all select 'c' || c_custkey, [1, c_custkey, 1] from customer) group by name)""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, customer = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "customer"))
    edges = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("src"), F.concat(F.lit("c"), "c_custkey").alias("dst"), F.lit(1.0).alias("weight"), F.col("c_custkey").alias("ord"))
    return g.Graph.from_names(edges, nation.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("ord"))).vertices


def _as_file(spark: SparkSession, lines: DataFrame, end: str) -> str:
    path = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    lines.write.text(path + end)
    return path


@_add("golden_scan", "select split_part(n_name, ' ', 1) name, case when strpos(n_name, ' ') = 0 then cast(n_nationkey as varchar) end \"value\" from nation")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat_ws(" ", "n_name", "n_nationkey"))
    return files.read_golden(spark, _as_file(spark, lines, "-WCC"), "wcc")


@_add("update_file_scan", "select cast(c_custkey as varchar) src, cast(c_nationkey as varchar) dst from customer where c_custkey % 3 <> 0")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    lines = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.when(c % 3 == 0, c.cast("string")).otherwise(F.concat(F.lit(" a  "), c, F.lit(" "), "c_nationkey")))
    return files.update_lines(files.read_lines(spark, _as_file(spark, lines, "-add-edge.txt") + "-add-edge.txt")).select("src", "dst")


# Algorithms on a graph that was changed, and in the other direction.
for _name, _run, _select in (
    ("bfs", lambda x: traverse.bfs(x, _first(x)).select("vid", "depth"), _steps(_bfs_sql("flow")).replace(" join e on", " join u e on") + "select vid, cast(coalesce(depth, 2147483647) as integer) depth from v left join h using (vid)"),
    ("sssp", lambda x: traverse.sssp(x, _first(x)).select("vid", "dist"), _steps(_sssp_sql("flow")).replace(" join e on", " join u e on") + f"select vid, coalesce(dist, {_MAX}) dist from v left join h using (vid)"),
    ("wcc", analytics.wcc, _steps(_wcc_sql("flow")).replace("from e", "from u") + "select vid, component from h"),
    ("cdlp", analytics.cdlp, _cdlp_sql(around="select src, dst from u union all select dst, src from u") + "select vid, label from h"),
):
    _plain(f"{_name}_after_update", "flow", lambda x, run=_run: run(mutate.batch_update(x, _batch(x))), _select, more=_updated)
_plain(
    "bfs_reversed", "geo", lambda x: traverse.bfs(x.with_edges(x.in_edges()), x.vertices.agg(F.max("vid")).first()[0]).select("vid", "depth"),
    "select vid, cast(coalesce(depth, 2147483647) as integer) depth from v left join (select vid, min(depth) depth from b group by vid) using (vid)",
    more=", b(vid, depth) as (select max(vid), 0 from v union select e.src, depth + 1 from b join e on e.dst = b.vid where depth < 6)",
)
_both_ways = ", s as materialized (select src, dst, min(weight) weight from (select src, dst, weight from e union all select dst, src, weight from e) group by src, dst)"
_plain(
    "sssp_undirected", "trade", lambda x: traverse.sssp(x, _first(x)).select("vid", F.round("dist", 6).alias("dist")), f"select vid, round(coalesce(dist, {_MAX}), 6) dist from v left join h using (vid)",
    directed=False, more=_both_ways + _steps(_sssp_sql("trade", rounds=14)).replace(" join e on", " join s e on"),
)
