"""Evaluation of a ranking against grades, as rows and as a short report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.profile import RankProfile
from ..operators import grading, metrics, sampling
from ..operators.metrics import reconciled
from .rank import prepared


def rank_silver(grades: DataFrame, scored: DataFrame) -> DataFrame:
    """(candidate_id, rank): by unrounded score, then id; unscored ids come last, by id."""
    x = grades.select("candidate_id").join(scored.select("candidate_id", "final_score"), "candidate_id", "left")
    return x.select("candidate_id", F.row_number().over(Window.orderBy(F.desc_nulls_last("final_score"), "candidate_id")).alias("rank"))


def evaluate_silver(grades: DataFrame, scored: DataFrame, threshold: float = 3.0) -> DataFrame:
    return metrics.evaluate(rank_silver(grades, scored), grades, threshold=threshold)


def evaluate_realistic(grades: DataFrame, pool: DataFrame, scored: DataFrame, threshold: float = 3.0) -> DataFrame:
    """The graded ids among a pool of ungraded ones, which count as 0."""
    ids = grades.select("candidate_id").union(pool.select("candidate_id")).distinct()
    return metrics.evaluate(rank_silver(ids, scored), grades, threshold=threshold)


def silver_labels(records: DataFrame, p: RankProfile, model: DataFrame | None = None, **sample) -> DataFrame:
    """The label sample: candidate_id, stratum, grade_rules, grade_llm, grade_final, needs_review, in order of id."""
    x = grading.graded(prepared(records, p), p).withColumn("stratum", sampling.stratum())
    picked = sampling.stratified_sample(x.select("candidate_id", "stratum"), **sample)
    x = x.drop("stratum").join(picked, "candidate_id")
    x = x.join(model.select("candidate_id", "grade_llm"), "candidate_id", "left") if model is not None else x.withColumn("grade_llm", F.lit(None).cast("int"))
    final, review = reconciled(F.col("grade"), F.col("grade_llm"), F.size("forced") > 0)
    return x.select("candidate_id", "stratum", F.col("grade").alias("grade_rules"), "grade_llm", final.alias("grade_final"), review.alias("needs_review"), F.struct("components", F.col("base_grade_score").alias("base_score"), "gates", "caps", "forced").alias("rule_breakdown")).orderBy("candidate_id")


def report(result: DataFrame) -> str:
    """Lines `name value` of a one-row result."""
    row = result.first()
    return "\n".join(f"{k:12s} {v:.4f}" if isinstance(v, float) else f"{k:12s} {v}" for k, v in row.asDict().items())
