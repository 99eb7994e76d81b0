"""The ranking from records to the best n with reasons: `python -m sparkloom.plans.rank --help`."""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.profile import RankProfile, load_profile
from ..operators import behaviour, consistency, features, reasoning, retrieval, scoring, text
from ..sources.records import SIGNALS_KEY, read_records
from . import artifacts


def prepared(records: DataFrame, p: RankProfile) -> DataFrame:
    """Records with signals, features, honeypot_reasons, is_honeypot and behavioral_mult."""
    x = features.with_features(records, p)
    x = x.withColumn("honeypot_reasons", consistency.contradiction_reasons(p))
    return x.withColumns({"is_honeypot": F.size("honeypot_reasons") > 0, "behavioral_mult": behaviour.multiplier(F.col("signals"), p.reference_date)})


def retrieve(records: DataFrame, vectors: DataFrame, aspect_vectors: DataFrame, p: RankProfile, k: int = 800, lexical: bool = True) -> DataFrame:
    """(candidate_id, semantic_sim, rrf_score): the shortlist. Lexical scores reorder the semantic pool and are taken over it alone."""
    hits = retrieval.vector_topk(vectors, aspect_vectors, k, "candidate_id")
    pool = retrieval.aspect_blend(hits, {a: x.weight for a, x in p.aspects.items()}, "candidate_id")
    lists = retrieval.ranked(pool, "semantic", "candidate_id").withColumn("list", F.lit("semantic"))
    terms = p.query_terms()
    if lexical and terms:
        docs = records.join(pool.select("candidate_id"), "candidate_id", "left_semi").select("candidate_id", text.lexical_text().alias("text"))
        lex = retrieval.bm25(docs, terms, "candidate_id")
        lists = lists.unionByName(retrieval.ranked(lex, "bm25", "candidate_id").withColumn("list", F.lit("lexical")))
    fused = retrieval.rrf(lists, ident="candidate_id")
    out = fused.join(pool, "candidate_id").select("candidate_id", F.col("semantic").alias("semantic_sim"), F.col("rrf").alias("rrf_score"))
    return retrieval.shortlist(out, "rrf_score", "candidate_id", k)


def score(records: DataFrame, found: DataFrame, p: RankProfile, logits: DataFrame | None = None, weights: dict[str, float] | None = None, combine: Column | None = None, head: int = 200) -> DataFrame:
    """Scores of the shortlist. A reranker's logits count for the first `head` of it; its size is bounded, so it goes to the records."""
    first = retrieval.shortlist(found, "rrf_score", "candidate_id", head).select("candidate_id", F.lit(True).alias("in_head"))
    found = retrieval.reranked_head(found.join(first, "candidate_id", "left"), logits)
    found = found.withColumn("ce_score", F.when(F.col("in_head"), F.col("ce_score"))).drop("in_head")
    x = prepared(records.join(F.broadcast(found), "candidate_id"), p).withColumn("ce_used", F.col("ce_score").isNotNull())
    x = scoring.with_scores(x, weights)
    if combine is not None:
        x = x.withColumn("base_score", combine).withColumn("final_score", F.when(F.col("is_honeypot"), scoring.FLOOR).otherwise(F.col("base_score") * F.col("behavioral_mult")))
    return x


def rerank_logits(records: DataFrame, found: DataFrame, p: RankProfile, reranker: Callable | None, head: int = 200) -> DataFrame | None:
    """(candidate_id, logit) of the first `head` of the shortlist against the whole profile text; None without a reranker, whose weight then drops out."""
    if reranker is None:
        return None
    first = retrieval.shortlist(found, "rrf_score", "candidate_id", head).select("candidate_id")
    rows = records.join(F.broadcast(first), "candidate_id").select("candidate_id", text.rich_text().alias("text"))
    return retrieval.reranked(rows, p.whole_text(), reranker)


def submission(scored: DataFrame, n: int = 100) -> DataFrame:
    """candidate_id, rank, score, reasoning of the best n."""
    top = scoring.select_top(scored, n)
    return top.select("candidate_id", "rank", "score", reasoning.reasoning(F.col("profile.current_title"), F.col("profile.years_of_experience")).alias("reasoning"))


def produce(spark: SparkSession, records_path: str, vectors: DataFrame, profile_path: str, out: str, encode: Callable[[list[str]], list], n: int = 100, logits: DataFrame | None = None, signals_key: str = SIGNALS_KEY, reranker: Callable | None = None, query_prefix: str = "") -> list[str]:
    """Reads, checks that records and vectors belong together, ranks, writes the CSV and checks it; the faults found, none for a good file."""
    p = load_profile(profile_path)
    records = read_records(spark, records_path, signals_key=signals_key)
    q = artifacts.encode_queries(p, encode, query_prefix)
    artifacts.check(records, vectors, len(q[0][1]) if q else None)
    aspects = spark.createDataFrame(q, "query string, q array<double>")
    found = retrieve(records, vectors, aspects, p)
    scored = score(records, found, p, rerank_logits(records, found, p, reranker) if logits is None else logits)
    scoring.write_submission(submission(scored, n), out)
    return scoring.validate_submission(out, n)


def main() -> None:
    a = argparse.ArgumentParser(description="Ranks profile records against a job profile.")
    a.add_argument("--records", required=True)
    a.add_argument("--vectors", required=True, help="Parquet (candidate_id, embedding)")
    a.add_argument("--aspects", required=True, help="Parquet (query, q): one vector for each aspect")
    a.add_argument("--profile", required=True)
    a.add_argument("--out", required=True)
    a.add_argument("--n", type=int, default=100)
    a.add_argument("--signals-key", default=SIGNALS_KEY, help="the records' field of engagement signals")
    o = a.parse_args()
    spark = SparkSession.builder.getOrCreate()
    p = load_profile(o.profile)
    records = read_records(spark, o.records, signals_key=o.signals_key)
    found = retrieve(records, spark.read.parquet(o.vectors), spark.read.parquet(o.aspects), p)
    scoring.write_submission(submission(score(records, found, p), o.n), o.out)
    faults = scoring.validate_submission(o.out, o.n)
    print("\n".join(faults) or "valid")


if __name__ == "__main__":
    main()
