"""Vector search, aspect blending, BM25, reciprocal rank fusion, shortlist."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import sigmoid, tokens


#: Fixed value: pairs that a reranker gets at once.
PAIRS_A_BATCH = 32


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, in order; null if the lengths differ."""
    both = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.aggregate(both, F.lit(0.0), lambda s, v: s + v))


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query, ident, score, rank): the k best inner products for each row of `queries` (query, q).

    `queries` is the side of stated size (aspects or a batch of queries) and is sent to
    the vectors; partial top-k in each partition keeps what is shuffled small.
    """
    scored = vectors.crossJoin(F.broadcast(queries)).select("query", F.col(ident), F.round(dot(F.col(vector), F.col("q")), 9).alias("score")).where("score is not null")
    best = scored.withColumn("__part", F.spark_partition_id())
    here = Window.partitionBy("query", "__part").orderBy(F.desc("score"), ident)
    over = Window.partitionBy("query").orderBy(F.desc("score"), ident)
    best = best.withColumn("rank", F.row_number().over(here)).where(F.col("rank") <= k)
    return best.withColumn("rank", F.row_number().over(over)).where(F.col("rank") <= k).drop("__part")


def aspect_blend(hits: DataFrame, weights: dict[str, float], ident: str = "vec_id") -> DataFrame:
    """(ident, semantic): weighted sum of scores over those aspects whose top k has the row. Aspects of no weight are left out.

    The terms are added in aspect order, so that equal rows get equal sums.
    """
    use = {a: w for a, w in weights.items() if w > 0}
    w = F.create_map(*[x for a, v in sorted(use.items()) for x in (F.lit(a), F.lit(float(v)))]) if use else F.create_map().cast("map<string,double>")
    terms = hits.where(F.col("query").isin(list(use))).select(ident, "query", (F.element_at(w, F.col("query")) * F.col("score")).alias("v"))
    terms = terms.groupBy(ident).agg(F.sort_array(F.collect_list(F.struct("query", "v"))).alias("t"))
    return terms.select(ident, F.aggregate("t", F.lit(0.0), lambda s, x: s + x["v"]).alias("semantic"))


def term_counts(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """(ident, term, tf, length)."""
    t = docs.select(ident, tokens(F.col(text)).alias("t")).withColumn("length", F.size("t"))
    return t.select(ident, "length", F.explode("t").alias("term")).groupBy(ident, "term").agg(F.count("*").alias("tf"), F.first("length").alias("length"))


def bm25_idf(counts: DataFrame, n_docs: int, epsilon: float = 0.25) -> DataFrame:
    """(term, df, idf): negative ones become epsilon times the mean over all terms, negatives included."""
    df = counts.groupBy("term").agg(F.count("*").alias("df"))
    df = df.withColumn("raw", F.log(F.lit(n_docs) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = df.agg(F.avg("raw").alias("mean"))
    return df.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, epsilon * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def bm25(docs: DataFrame, query_terms: list[str], ident: str = "doc_id", text: str = "text", k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25, only: DataFrame | None = None) -> DataFrame:
    """(ident, bm25) for every row, or for those whose ident is in `only`; repeated query terms count again. No rows without query terms or documents.

    Query terms are counted where the rows lie: one pass for the sizes and the terms'
    document frequencies, one projection for the scores. The vocabulary is counted only
    if a query term is so frequent that its idf falls back on the mean over all terms.
    """
    spark, terms = docs.sparkSession, sorted(set(query_terms))
    t = docs.select(ident, tokens(F.col(text)).alias("t"))
    hits = lambda x: x.select(ident, F.size("t").alias("length"), F.filter("t", lambda v: v.isin(terms)).alias("hit"))
    has = [F.sum(F.array_contains("hit", q).cast("long")) for q in terms]
    n, avg, *df = hits(t).agg(F.count("*"), F.avg("length"), *has).first() if terms else (0, 0.0)
    if not terms or not n or not avg:
        return spark.createDataFrame([], docs.select(ident).schema.add("bm25", "double"))
    idf = {q: math.log(n - d + 0.5) - math.log(d + 0.5) for q, d in zip(terms, df, strict=True) if d}
    if min(idf.values(), default=0.0) < 0:
        every = t.select(F.explode(F.array_distinct("t")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        mean = every.agg(F.avg(F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))).first()[0]
        idf = {q: v if v >= 0 else epsilon * mean for q, v in idf.items()}
    score = F.lit(0.0)
    for q, v in idf.items():
        tf = F.size("hit") - F.size(F.array_remove("hit", q))
        score = score + query_terms.count(q) * v * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("length") / float(avg)))
    wanted = t if only is None else t.join(only.select(ident), ident, "left_semi")
    return hits(wanted).select(ident, score.alias("bm25"))


def ranked(scores: DataFrame, score: str, ident: str, digits: int = 12) -> DataFrame:
    """(ident, rank) by score, best first, ties by id."""
    return scores.select(ident, F.row_number().over(Window.orderBy(F.desc(F.round(score, digits)), ident)).alias("rank"))


def rrf(lists: DataFrame, k: int = 60, ident: str = "id") -> DataFrame:
    """(ident, rrf) of rows (list, ident, rank): an id's first place in a list counts, later ones only take up places."""
    first = lists.groupBy("list", ident).agg(F.min("rank").alias("rank"))
    terms = first.groupBy(ident).agg(F.sort_array(F.collect_list(F.struct("list", (1.0 / (k + F.col("rank"))).alias("v")))).alias("t"))
    return terms.select(ident, F.aggregate("t", F.lit(0.0), lambda s, x: s + x["v"]).alias("rrf"))


def shortlist(scores: DataFrame, score: str, ident: str, n: int = 800) -> DataFrame:
    return scores.orderBy(F.desc(F.round(score, 12)), ident).limit(n)


def reranked_head(head: DataFrame, logits: DataFrame | None, ident: str = "candidate_id") -> DataFrame:
    """ce_score: sigmoid of the reranker's logit, null where there is none (or no reranker)."""
    if logits is None:
        return head.withColumn("ce_score", F.lit(None).cast("double"))
    return head.join(logits.select(ident, sigmoid(F.col("logit")).alias("ce_score")), ident, "left")


def reranked(head: DataFrame, query: str, reranker: Callable, ident: str = "candidate_id", text: str = "text") -> DataFrame:
    """(ident, logit) by a reranker: a function from a list of (query, text) pairs to scores, called with PAIRS_A_BATCH pairs at most. The head is the side of bounded size; it is dealt over tasks."""
    import numpy as np
    import pandas as pd

    def run(frames):
        for p in frames:
            pairs = [(query, t or "") for t in p[text]]
            parts = [np.asarray(reranker(pairs[a : a + PAIRS_A_BATCH]), dtype=float).reshape(-1) for a in range(0, len(pairs), PAIRS_A_BATCH)]
            if parts:
                yield pd.DataFrame({ident: p[ident], "logit": np.concatenate(parts)})

    kind = dict(head.dtypes)[ident]
    return head.select(ident, text).repartition(ident).mapInPandas(run, f"`{ident}` {kind}, logit double")


def rerank_all(rows: DataFrame, logits: DataFrame, ident: str = "candidate_id") -> DataFrame:
    """Every row with a logit: those that were not scored come a step below the least score (0 if none was)."""
    least = logits.agg(F.coalesce(F.min("logit") - 1.0, F.lit(0.0)).alias("__tail"))
    return rows.join(logits, ident, "left").crossJoin(F.broadcast(least)).withColumn("logit", F.coalesce("logit", "__tail")).drop("__tail")


def encoded(rows: DataFrame, encoder: Callable, ident: str, text: str, batch: int = 256) -> DataFrame:
    """(ident, embedding) by an encoder: a function from a list of texts to a matrix; vectors are scaled to length 1."""
    import numpy as np
    import pandas as pd

    def run(frames):
        for p in frames:
            out = [np.asarray(encoder(p[text].iloc[a : a + batch].tolist()), dtype=np.float32) for a in range(0, len(p), batch)]
            if out:
                m = np.concatenate(out)
                m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
                yield pd.DataFrame({ident: p[ident], "embedding": list(m)})

    kind = dict(rows.dtypes)[ident]
    return rows.select(ident, text).mapInPandas(run, f"`{ident}` {kind}, embedding array<float>")
