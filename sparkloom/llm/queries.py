"""The queries of the llm operators: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, avi, jaccard, lm, mixing, packing, quality, substr, toxic, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_back(warc.bundles(table(spark, sf_dir, "pages"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substr.duplicate_runs(table(spark, sf_dir, "documents")).drop("text_hash")


def op5_avi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return avi.media_digest(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.schedule(table(spark, sf_dir, "documents").select("doc_id", "source"))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "links", "copies")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_lm": op1_lm, "op2_warc": op2_warc, "op3_toxicity": op3_toxicity, "op4_substrings": op4_substrings, "op5_avi": op5_avi, "op6_mixing": op6_mixing, "op7_neighbours": op7_neighbours, "op8_packing": op8_packing, "op9_quality": op9_quality, "op10_jaccard": op10_jaccard}


WARC_SQL = """
with first as (select html, max(page_id) as first from pages where strlen(html) >= 1000 group by html)
select page_id, strlen(coalesce(p.html, ''))::bigint as payload_bytes, sha1(coalesce(p.html, '')) as payload_digest,
  case when first is null or first = page_id then 'response' else 'revisit' end as record_type, case when first <> page_id then first end as refers_to
from pages p left join first f on p.html = f.html
"""

#: Every pair that shares a 5-gram, and components by walking the links.
JACCARD_SQL = r"""
with recursive w as (select doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x09-\x0D ]+'), lambda x: x <> '') as w from documents),
g as (select distinct doc_id, hash(array_to_string(w[i : i + 4], ' ')) as s from w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) t(i) where len(w) > 0),
n as (select doc_id, count(*) as n from g group by 1),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from g a join g b on a.s = b.s and a.doc_id <> b.doc_id group by all),
l as (select a, b, c = x.n and c = y.n as same from p join n x on x.doc_id = a join n y on y.doc_id = b where c >= 0.8 * (x.n + y.n - c)),
r(a, b) as (select doc_id, doc_id from documents union select r.a, l.b from r join l on l.a = r.b)
select doc_id, (select min(b) from r where r.a = d.doc_id) as class_id, (select count(*) from l where l.a = d.doc_id)::bigint as links, (select count(*) from l where l.a = d.doc_id and same)::bigint as copies from documents d
"""


def oracle_sql() -> dict[str, str]:
    """The operators whose results SQL can express; tests hold the others against brute force, round trips or held-out labels."""
    return {"op2_warc": WARC_SQL, "op10_jaccard": JACCARD_SQL}
