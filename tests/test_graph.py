"""The graph engine on small graphs with known results, and on random ones against plain Python."""

import heapq
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from vertexloom.operators import analytics, check, graph as g, mutate, traverse
from vertexloom.plans import runner
from vertexloom.sources import files
from vertexloom.streaming.updates import LiveGraph

A_NAMES = ["Andy", "Bob", "Tom", "Sam", "Kevin", "Leo"]
A_EDGES = ["Andy Bob", "Bob Tom", "Bob Sam", "Andy Sam", "Bob Bob", "Andy Leo", "Leo Sam", "Sam Leo"]
INF, FAR = g.UNREACHED_DEPTH, g.UNREACHED_DISTANCE
A_GOLDEN = {
    "Andy": (0, 0.0, "Andy", 0.038866419, "Bob"), "Bob": (1, 1.0, "Andy", 0.069738565, "Bob"), "Tom": (2, 2.0, "Andy", 0.0587029, "Bob"),
    "Sam": (1, 1.0, "Andy", 0.400336626, "Bob"), "Kevin": (INF, FAR, "Kevin", 0.038866419, "Kevin"), "Leo": (1, 1.0, "Andy", 0.393489071, "Bob"),
}


def by_name(spark, edges, names, directed=True):
    rows = spark.createDataFrame([(*e.split(" ")[:2], float((e.split(" ") + ["1"])[2]), k) for k, e in enumerate(edges)], "src string, dst string, weight double, ord long")
    listed = spark.createDataFrame(list(zip(names, range(len(names)), strict=True)), "name string, ord long")
    return g.Graph.from_names(rows, listed, directed)


def results(graph, source):
    start = graph.vid_of(source)
    tables = [
        g.named(graph, traverse.bfs(graph, start).select("vid", "depth")), g.named(graph, traverse.sssp(graph, start).select("vid", "dist")), g.named(graph, analytics.wcc(graph), "component"),
        g.named(graph, analytics.pagerank(graph).select("vid", F.round("rank", 9))), g.named(graph, analytics.cdlp(graph), "label"),
    ]
    out = {}
    for t in tables:
        for name, value in t.collect():
            out.setdefault(name, []).append(value)
    return {k: tuple(v) for k, v in out.items()}


def test_first_graph(spark):
    graph = by_name(spark, A_EDGES, A_NAMES)
    assert dict(graph.vertices.select("name", "vid").collect()) == {n: k for k, n in enumerate(A_NAMES)}
    assert results(graph, "Andy") == A_GOLDEN
    assert g.edge_number(graph) == 8 and g.size(graph) == 6
    with pytest.raises(ValueError):
        graph.vid_of("one")


def test_updates(spark):
    graph = by_name(spark, ["one two 0.8", "two three", "one three", "one four", "four three", "four five", "two four"], ["one", "two", "three", "four", "five", "R"])
    names = lambda *n: spark.createDataFrame([(x, k) for k, x in enumerate(n)], "name string, ord long")
    edges = lambda *e: spark.createDataFrame([(*x.split(), 1.0, k) for k, x in enumerate(e)], "src string, dst string, weight double, ord long")
    graph = mutate.remove_vertices(mutate.add_named_edges(graph, edges("R one", "five R")), names("R", "nobody"))
    graph = mutate.add_named_edges(mutate.add_vertices(graph, names("six", "one")), edges("one six"))
    graph = mutate.remove_named_edges(graph, edges("two four", "nobody one"))
    got = results(graph, "one")
    golden = {"one": (0, 0.0, 0.112217697), "two": (1, 0.8, 0.136063986), "three": (1, 1.0, 0.309545483), "four": (1, 1.0, 0.136063986), "five": (2, 2.0, 0.170044863), "six": (1, 1.0, 0.136063986)}
    assert {k: (v[0], v[1], v[3]) for k, v in got.items()} == golden and {v[2] for v in got.values()} == {"one"} and {v[4] for v in got.values()} == {"one"}
    graph = mutate.remove_named_edges(graph, edges("four five", "one two", "one three", "one four", "one six"))
    got = results(graph, "one")
    assert [got[k][4] for k in ("one", "two", "three", "four", "five", "six")] == ["one", "two", "three", "two", "five", "six"]
    assert got["three"][2] == "two" and got["three"][3] == 0.350648737 and got["two"][:2] == (INF, FAR)
    assert g.edge_number(graph.clear()) == 0 and g.size(graph.clear()) == 6


def test_upsert_of_undirected_edges(spark):
    graph = by_name(spark, ["a b 1", "b a 3", "a a 2", "a b"], ["a", "b"], directed=False)
    assert {tuple(r) for r in graph.edges.collect()} == {(0, 1, 1.0), (1, 0, 1.0), (0, 0, 2.0)}
    pairs = spark.createDataFrame([(0, 1), (1, 1)], "src long, dst long")
    assert sorted(map(tuple, g.contain_edges(graph, pairs).collect())) == [(0, 1, True, 1.0), (1, 1, False, FAR)]
    assert g.edge_number(mutate.remove_edges(graph, pairs)) == 1


def test_against_plain_python(spark):
    import random

    rng = random.Random(5)
    edges = {(rng.randrange(60), rng.randrange(60)): rng.choice([0.0, 0.5, 1.0, 2.5]) for _ in range(110)}
    graph = g.Graph.from_edges(spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "src long, dst long, weight double"))
    ids = sorted({x for e in edges for x in e})
    dist, heap = {}, [(0.0, ids[0])]
    while heap:
        d, u = heapq.heappop(heap)
        if u not in dist:
            dist[u] = d
            for (a, b), w in edges.items():
                if a == u:
                    heapq.heappush(heap, (d + w, b))
    found = {r.vid: r for r in traverse.sssp(graph, ids[0]).collect()}
    assert {v: r.dist for v, r in found.items()} == {v: dist.get(v, FAR) for v in ids}
    for v, r in found.items():  # predecessors lead to the source without a cycle
        seen = set()
        while r.pred is not None:
            assert r.vid not in seen and found[r.pred].dist + edges[r.pred, r.vid] == r.dist
            seen.add(r.vid)
            r = found[r.pred]
        assert v not in dist or r.vid == ids[0]
    depths = {r.vid: r for r in traverse.bfs(graph, ids[0]).collect()}
    assert all(r.pred is None or ((r.pred, v) in edges and depths[r.pred].depth == r.depth - 1) for v, r in depths.items())
    target = max((v for v in ids if depths[v].depth < INF), key=lambda v: depths[v].depth)
    hops = traverse.path_query(graph, traverse.bfs(graph, ids[0]).select("vid", "pred"), ids[0], target).orderBy("hop").collect()
    assert len(hops) == depths[target].depth and hops[0].from_vid == ids[0] and hops[-1].to_vid == target
    assert traverse.path_query(graph, traverse.bfs(graph, ids[0]).select("vid", "pred"), ids[0], ids[0]).count() == 0
    component = dict(analytics.wcc(graph).collect())
    assert all(component[a] == component[b] for a, b in edges) and all(component[c] == c for c in component.values())
    assert abs(analytics.pagerank(graph).agg(F.sum("rank")).first()[0] - 1) < 1e-9
    offsets = {r.vid: (r.start, r.end) for r in g.csr_offsets(graph).collect()}
    at = 0
    for v in ids:
        n = sum(a == v for a, _ in edges)
        assert offsets[v] == (at, at + n)
        at += n
    with pytest.raises(ValueError):
        traverse.sssp(graph.with_edges(graph.edges.withColumn("weight", F.lit(-1.0))), ids[0])


def test_long_chain(spark):
    graph = g.Graph.from_edges(spark.range(1, 300).select(F.col("id").alias("src"), (F.col("id") - 1).alias("dst")))
    assert {r[1] for r in analytics.wcc(graph).collect()} == {0}


def test_files(spark, tmp_path):
    base = f"{tmp_path}/toy"
    write = lambda end, text: open(base + end, "w").write(text)
    write(".v", "\n".join(A_NAMES) + "\n")
    write(".e", "\n".join([*A_EDGES, "lonely"]) + "\n")
    write(".properties", "# toy\n\nbroken line\ngraph.toy.directed = true\ngraph.toy.algorithms = bfs, cdlp, pr, sssp, wcc, other\ngraph.toy.bfs.source-vertex = Andy\ngraph.toy.sssp.source-vertex = Andy\ngraph.toy.pr.num-iterations = 10\n")
    for k, end in enumerate(("-BFS", "-SSSP", "-WCC", "-PR", "-CDLP")):
        spell = {INF: "9223372036854775807", FAR: "inf"}
        write(end, "".join(f"{n} {spell.get(v[k], v[k])}\n" for n, v in A_GOLDEN.items()))
    config = files.read_config(spark, base)
    assert config.algorithms == ("bfs", "cdlp", "pr", "sssp", "wcc") and config.invalid_lines == ["broken line"] and config.damping == 0.85
    assert files.read_config(spark, base + "-none").algorithms == ()
    report = f"{tmp_path}/report"
    rows = runner.run(spark, base, report)
    assert all(float(v) >= 0 for _, v in rows) and len(rows) == 5
    write("-PR", "Andy 1\n")
    assert dict(runner.run(spark, base, report))["pr"] == "wrong" and spark.read.csv(report).count() == 2
    graph = files.read_graph(spark, base, config)
    files.save_adjacency(graph, f"{tmp_path}/adjacency")
    assert sorted(map(tuple, files.load_adjacency(spark, f"{tmp_path}/adjacency").collect())) == sorted(map(tuple, graph.edges.collect()))
    write("-add-edge.txt", "a Tom  Andy\n")
    write("-delete-edge.txt", "d Andy Bob\n")
    added, gone = files.read_updates(spark, base)
    changed = mutate.remove_named_edges(mutate.add_named_edges(graph, added.withColumn("weight", F.lit(1.0))), gone)
    assert {(2, 0, 1.0)} == {tuple(r) for r in changed.edges.collect()} - {tuple(r) for r in graph.edges.collect()} and g.edge_number(changed) == 8
    config.bfs_source = "nobody"
    with pytest.raises(ValueError):
        files.read_graph(spark, base, config)
    golden = files.read_golden(spark, base, "wcc")
    result = g.named(graph, analytics.wcc(graph), "component")
    assert check.check_wcc(result, golden) == 0 and check.check_wcc(result, golden.withColumn("value", F.lit("x"))) > 0


def test_stream(spark, tmp_path):
    live = LiveGraph(g.Graph.from_edges(spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long")))
    schema = "op string, src long, dst long, weight double, ord long"
    os.makedirs(f"{tmp_path}/in")
    spark.createDataFrame([("add", 3, 1, 2.0, 1), ("delete", 1, 2, 0.0, 2), ("add", 2, 3, 9.0, 3), ("delete", 3, 1, 0.0, 4), ("add", 3, 1, 5.0, 5)], schema).write.mode("append").parquet(f"{tmp_path}/in")
    query = live.writer(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")).option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(tuple, live.graph.edges.collect())) == [(2, 3, 9.0), (3, 1, 5.0)]


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.queries()["wcc_geo"](spark, "/root/testdata/sf0.001").select("component").distinct().count() == 5


def test_pagerank_deals_edges_once(spark, monkeypatch):
    def written():
        sc = spark.sparkContext
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))

    pairs = spark.range(6000).selectExpr("id % 300 src", "(id * 7 + id div 300) % 300 dst").distinct()
    graph = g.Graph.from_edges(pairs).settle()
    want = {r.vid: round(r["rank"], 12) for r in analytics.pagerank(graph, 8).collect()}
    monkeypatch.setattr(analytics, "BROADCAST", 0, raising=False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = written()
        got = {r.vid: round(r["rank"], 12) for r in analytics.pagerank(graph, 8).collect()}
        assert got == want and written() - before < 5 * graph.edges.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
