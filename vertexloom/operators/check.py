"""Checkers: results against golden values by name. Each returns the number of mismatches, 0 if right."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vertexloom.functions.text import within
from vertexloom.sources.files import golden_depth, golden_distance


def mismatches(result: DataFrame, golden: DataFrame, same: Column) -> DataFrame:
    """Rows by name where result(name, found) and golden(name, wanted) differ; a name on one side only, or twice, counts."""
    n = F.count("*")
    twice = golden.groupBy("name").agg(n.alias("n")).where("n > 1").select("name", F.lit(None).cast("string").alias("found"), F.lit("repeated").alias("wanted"))
    both = result.join(golden, "name", "full_outer").where(~F.coalesce(same, F.lit(False)))
    return both.select("name", F.col("found").cast("string"), F.col("wanted").cast("string")).union(twice)


def bfs_mismatches(result: DataFrame, golden: DataFrame) -> DataFrame:
    """(name, found, wanted) where result(name, depth) and golden(name, value) differ."""
    return mismatches(result.select("name", F.col("depth").alias("found")), golden.select("name", golden_depth(F.col("value")).alias("wanted")), F.col("found") == F.col("wanted"))


def sssp_mismatches(result: DataFrame, golden: DataFrame) -> DataFrame:
    return mismatches(result.select("name", F.col("dist").alias("found")), golden.select("name", golden_distance(F.col("value")).alias("wanted")), within(F.col("found"), F.col("wanted")))


def pagerank_mismatches(result: DataFrame, golden: DataFrame) -> DataFrame:
    return mismatches(result.select("name", F.col("rank").alias("found")), golden.select("name", F.col("value").try_cast("double").alias("wanted")), within(F.col("found"), F.col("wanted")))


def cdlp_mismatches(result: DataFrame, golden: DataFrame) -> DataFrame:
    return mismatches(result.select("name", F.col("label").alias("found")), golden.select("name", F.col("value").alias("wanted")), F.col("found") == F.col("wanted"))


def wcc_mismatches(result: DataFrame, golden: DataFrame) -> DataFrame:
    """Names on one side only, and pairs of labels (name null) of which one stands with several others: both must split the names alike."""
    both = result.select("name", F.col("component").cast("string").alias("found")).join(golden.select("name", F.col("value").alias("wanted")), "name", "full_outer")
    pairs = both.where("found is not null and wanted is not null").select("found", "wanted").distinct()
    one = pairs.groupBy("found").count().where("count > 1").select("found")
    two = pairs.groupBy("wanted").count().where("count > 1").select("wanted")
    split = pairs.join(one, "found", "left_semi").union(pairs.join(two, "wanted", "left_semi").select("found", "wanted")).distinct()
    return both.where("found is null or wanted is null").select("name", "found", "wanted").union(split.select(F.lit(None).cast("string"), "found", "wanted"))


def check_bfs(result: DataFrame, golden: DataFrame) -> int:
    return bfs_mismatches(result, golden).count()


def check_sssp(result: DataFrame, golden: DataFrame) -> int:
    return sssp_mismatches(result, golden).count()


def check_pagerank(result: DataFrame, golden: DataFrame) -> int:
    return pagerank_mismatches(result, golden).count()


def check_cdlp(result: DataFrame, golden: DataFrame) -> int:
    return cdlp_mismatches(result, golden).count()


def check_wcc(result: DataFrame, golden: DataFrame) -> int:
    return wcc_mismatches(result, golden).count()
