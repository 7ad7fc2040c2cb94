"""Connected components of link tables, with DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.llm.common import hot_keys, materialize, spread_join


def connected_components(links: DataFrame) -> DataFrame:
    """links(a, b) -> (id, label): the smallest id reachable from each id that stands in a link.

    Each round takes the least label among neighbours and then the label of that label (pointer
    jumping), so chains shrink geometrically; every round is a table in the shared folder. The links of an
    id that has very many of them, and the members of a very large component, stay where they are and meet a
    broadcast of their few labels. Null ends are ignored, repeated links and self-links do no harm, no links give no rows.
    """
    links = links.where("a is not null and b is not null")
    both = materialize(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    hubs = hot_keys(both, "b")
    state = materialize(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("label")), "labels")
    while True:
        near = spread_join(both, state.withColumnRenamed("id", "b"), "b", hubs).groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        step = state.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = state.select(F.col("id").alias("label"), F.col("label").alias("root"))
        after = materialize(spread_join(step, jump, "label", hot_keys(state, "label"), "left").select("id", "old", F.least("label", F.coalesce("root", "label")).alias("label")), "labels")
        state = after.select("id", "label")
        if after.where("old <> label").isEmpty():
            return state
