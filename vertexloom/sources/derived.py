"""Graphs over the relational tables, as one SQL text each that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import SparkSession

from vertexloom.operators.graph import Graph

TABLES = {"trade": ["orders", "lineitem"], "geo": ["supplier", "customer", "nation"], "flow": ["events"]}
EDGES = {
    "trade": """select o_custkey src, 1000000 + l_suppkey dst, min(l_extendedprice) weight
      from orders join lineitem on o_orderkey = l_orderkey group by o_custkey, 1000000 + l_suppkey""",
    "geo": """select 1000000 + s_suppkey src, 2000000 + s_nationkey dst, cast(1.0 as double) weight from supplier
      union all select c_custkey, 2000000 + c_nationkey, cast(1.0 as double) from customer
      union all select 2000000 + n_nationkey, 3000000 + n_regionkey, cast(1.0 as double) from nation""",
    "flow": """select src, dst, min(value) weight
      from (select user_id src, lead(user_id) over (order by ts, event_id) dst, value from events) t
      where dst is not null group by src, dst""",
}
_FLOW = """
with p as (select user_id, ts, event_id, value, cast(ts as date) day from events),
n as (select *, lead(user_id) over (partition by day order by ts, event_id) nxt, row_number() over (partition by day order by ts desc, event_id desc) back from p),
f as (select day, min_by(user_id, struct(ts, event_id)) head from p group by day),
d as (select day, lead(head) over (order by day) after from f)
select src, dst, min(value) weight
from (select user_id src, case when back = 1 then after else nxt end dst, value from n join d using (day)) where dst is not null group by src, dst"""


def edges_sql(name: str) -> str:
    return EDGES[name]


def load(spark: SparkSession, sf_dir: str, name: str, directed: bool = True) -> Graph:
    """The graph's tables as views, its edges by SQL. The successor of an event is found day by day: only the days' heads meet in one task."""
    for table in TABLES[name]:
        spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
    return Graph.from_edges(spark.sql(_FLOW if name == "flow" else EDGES[name]), directed=directed)
