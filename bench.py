"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

A graph's edges are built and written before its clock starts; the time holds the algorithm and the
names of its result, as the usual benchmark of such engines counts it.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from vertexloom.operators import analytics, traverse  # noqa: E402
from vertexloom.operators.graph import named  # noqa: E402
from vertexloom.sources import derived  # noqa: E402

RUNS = {
    "bfs": lambda g, s: traverse.bfs(g, s).select("vid", "depth"),
    "sssp": lambda g, s: traverse.sssp(g, s).select("vid", "dist"),
    "wcc": lambda g, s: analytics.wcc(g),
    "pagerank": lambda g, s: analytics.pagerank(g),
    "cdlp": lambda g, s: analytics.cdlp(g),
}


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in os.environ.get("BENCH_GRAPHS", "trade,geo,flow").split(","):
        graph = derived.load(spark, sf_dir, name).settle()
        source = graph.vertices.agg(F.min("vid")).first()[0]
        for algorithm, run in RUNS.items():
            began = time.time()
            named(graph, run(graph, source)).write.format("noop").mode("overwrite").save()
            took[f"{algorithm}_{name}"] = round(time.time() - began, 3)
    print(json.dumps({"metric": "graph_analytics_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
