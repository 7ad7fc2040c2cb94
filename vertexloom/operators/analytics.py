"""Weakly connected components, PageRank and communities by label propagation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.operators.graph import Graph
from vertexloom.operators.rounds import Rounds, settle

BROADCAST = 400_000  # vertices up to which a round's state is broadcast to the edges, so that these stay where they are


def _dealt(rounds: Rounds, edges: DataFrame, key: str, vertices: int) -> DataFrame:
    """edges, dealt once by the key that every round's state meets them by, where that is too large for a broadcast."""
    if vertices <= BROADCAST:
        return edges
    return rounds.keep(edges.repartition(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), key))


def wcc(graph: Graph) -> DataFrame:
    """(vid, component): the smallest id of each component.

    Rounds on a shrinking graph: each component so far is its smallest id, takes the least neighbour's
    label, and labels are followed to their end (pointer jumping); edges inside a component are gone.
    """
    graph = graph.settle()
    links = graph.edges.select("src", "dst").union(graph.edges.select("dst", "src")).where("src <> dst").distinct()
    links = settle(links, "links")
    state, rounds = graph.vertices.select("vid", F.col("vid").alias("label")), Rounds()
    while not links.isEmpty():
        hook = links.groupBy(F.col("src").alias("label")).agg(F.min("dst").alias("near"))
        state = rounds.keep(state.join(hook, "label", "left").select("vid", F.least("label", F.coalesce("near", "label")).alias("label")))
        while True:
            roots = state.select(F.col("vid").alias("label"), F.col("label").alias("root"))
            jumped = rounds.turn(state.join(roots, "label").select("vid", F.col("label").alias("old"), F.col("root").alias("label")))
            state = jumped.select("vid", "label")
            if not jumped.where("old <> label").count():
                break
        ends = state.select(F.col("vid").alias("src"), F.col("label").alias("a")), state.select(F.col("vid").alias("dst"), F.col("label").alias("b"))
        links = settle(links.join(ends[0], "src").join(ends[1], "dst").where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct(), "links")
        state = rounds.end(state)
    return state.select("vid", F.col("label").alias("component"))


def pagerank(graph: Graph, iterations: int = 10, damping: float = 0.85) -> DataFrame:
    """(vid, rank) after exactly so many synchronous rounds; weights are ignored, what sinks hold is spread evenly.

    A round sums by dst, with map-side combining, what the ranks that ride along with out-degrees give
    to their edges; the mass of sinks is one number a round.
    """
    graph = graph.settle()
    n = graph.vertices.count()
    if not n:
        return graph.vertices.select("vid", F.lit(0.0).alias("rank"))
    out, rounds = graph.edges.groupBy("src").agg(F.count("*").cast("double").alias("out")), Rounds()
    state = rounds.keep(graph.vertices.select("vid").join(out, graph.vertices.vid == out.src, "left").select("vid", "out", F.lit(1.0 / n).alias("rank")))
    dealt = Rounds()
    edges = _dealt(dealt, graph.edges.select("src", "dst"), "src", n)
    for _ in range(iterations):
        lost = state.agg(F.coalesce(F.sum(F.when(F.col("out").isNull(), F.col("rank"))), F.lit(0.0))).first()[0]
        base = (1 - damping) / n + damping * lost / n
        given = state.where("out is not null").select(F.col("vid").alias("src"), (F.col("rank") / F.col("out")).alias("part"))
        got = edges.join(given, "src").groupBy(F.col("dst").alias("vid")).agg(F.sum("part").alias("got"))
        rank = F.lit(base) + F.lit(damping) * F.coalesce("got", F.lit(0.0))
        state = rounds.turn(state.join(got, "vid", "left").select("vid", "out", rank.alias("rank")))
    out = rounds.end(state.select("vid", "rank"))
    dealt.free()
    return out


def cdlp(graph: Graph, iterations: int = 10) -> DataFrame:
    """(vid, label) after exactly so many synchronous rounds: the most frequent label among in- and out-neighbours, the smallest of equals.

    Reciprocal neighbours and self-loops count twice; a vertex without neighbours keeps its label. Votes
    are counted by vertex and label before they meet, so a hub's neighbours do not.
    """
    graph, rounds = graph.settle(), Rounds()
    around = graph.all_edges().groupBy("src", "dst").agg(F.count("*").alias("times"))
    around = settle(around, "around")
    state = graph.vertices.select("vid", F.col("vid").alias("label"))
    for _ in range(iterations):
        votes = around.join(state.select(F.col("vid").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("vid"), "label").agg(F.sum("times").alias("n"))
        best = votes.groupBy("vid").agg(F.max(F.struct("n", (-F.col("label")).alias("low"))).alias("m")).select("vid", (-F.col("m.low")).alias("next"))
        state = rounds.turn(state.join(best, "vid", "left").select("vid", F.coalesce("next", "label").alias("label")))
        if rounds.held:
            state.count()  # computed now, so that the next round is planned on its real size
    return rounds.end(state)
