"""The registered queries of the corpus operators and their DuckDB twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.llm import fmindex, htmltree, kneser, langid, licenses, minhash, packing, passages, quality, topk


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_kneser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser.score_corpus(_table(spark, sf_dir, "documents"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fmindex.contamination_report(fmindex.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


_WORDS = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP5_SQL = f"""
with d as materialized (select row_number() over () r, doc_id, {_WORDS.format("coalesce(text, '')")} w from documents),
i as (select item_id, {_WORDS.format("text")} w from benchmark where text is not null and item_id is not null),
win as materialized (
  select distinct item_id, least(len(w), 10) n, array_to_string(w[k : k + least(len(w), 10) - 1], ' ') g
  from (select *, unnest(range(1, len(w) - least(len(w), 10) + 2)) k from i where len(w) > 0)),
g as (
  select r, n, k, array_to_string(w[k : k + n - 1], ' ') g
  from (select r, w, n, unnest(range(1, len(w) - n + 2)) k from d, (select distinct n from win) where len(w) >= n)),
m as materialized (select g.r, g.n, g.k, win.item_id from g join win on g.n = win.n and g.g = win.g),
hit as (select r, count(distinct p) n_hit from (select r, unnest(range(k, k + n)) p from m) group by r),
items as (
  select r, count(*) n_items, string_agg(cast(item_id as varchar), ',' order by cast(item_id as varchar)) ids
  from (select distinct r, item_id from m) group by r)
select doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit, cast(coalesce(n_items, 0) as bigint) n_items,
  sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join hit using (r) left join items using (r)
"""


_SPACED = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"

OP4_SQL = f"""
with recursive d as materialized (select doc_id, {_SPACED.format("coalesce(text, '')")} w from documents),
s as materialized (
  select distinct doc_id, array_to_string(w[k : k + least(len(w), 5) - 1], ' ') g
  from (select *, unnest(range(1, len(w) - least(len(w), 5) + 2)) k from d where len(w) > 0)),
n as materialized (select doc_id, count(*) n from s group by doc_id),
c as (select x.doc_id a, y.doc_id b, count(*) both_have from s x join s y on x.g = y.g and x.doc_id < y.doc_id group by x.doc_id, y.doc_id),
l as materialized (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * both_have >= 75 * (x.n + y.n - both_have)),
e as materialized (select a, b from l union select b, a from l),
r(a, b) as (select a, b from e union select r.a, e.b from r join e on e.a = r.b),
m as (select a doc_id, least(a, min(b)) low from r group by a)
select doc_id, coalesce(n, 0) n_shingles, coalesce(low, doc_id) component_id, coalesce(low, doc_id) = doc_id kept
from d left join n using (doc_id) left join m using (doc_id)
"""


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(_table(spark, sf_dir, "documents"))


def op8_maintext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltree.main_text(_table(spark, sf_dir, "pages"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.license_words(_table(spark, sf_dir, "documents"))
    return licenses.license_report(licenses.scan(found, licenses.document_frequencies(found)))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP10_SQL = """
with v as materialized (
  select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id query_id, c.vec_id, cast(list_dot_product(q.e, c.e) as bigint) score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0)
select query_id, cast(rank as integer) rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) rank from s) where rank <= 5
"""

QUERIES = {
    "op1_langid": op1_langid,
    "op2_packing": op2_packing,
    "op3_kneser": op3_kneser,
    "op4_minhash": op4_minhash,
    "op5_decontamination": op5_decontamination,
    "op6_quality": op6_quality,
    "op7_passages": op7_passages,
    "op8_maintext": op8_maintext,
    "op9_licenses": op9_licenses,
    "op10_topk": op10_topk,
}
ORACLES: dict[str, str] = {"op4_minhash": OP4_SQL, "op5_decontamination": OP5_SQL, "op9_licenses": licenses.oracle(_WORDS.format("coalesce(text, '')")), "op10_topk": OP10_SQL}
