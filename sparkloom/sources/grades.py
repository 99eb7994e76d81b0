"""Grade tables: silver labels, manual anchors, tolerant model grades."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load_silver(spark: SparkSession, path: str) -> DataFrame:
    """candidate_id, grade of a JSON array; rows without a final grade or under review are left out."""
    x = spark.read.schema("candidate_id string, grade_final double, needs_review boolean").option("multiLine", True).json(path)
    return x.where("grade_final is not null and not coalesce(needs_review, false)").select("candidate_id", F.col("grade_final").alias("grade"))


def load_manual(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("candidate_id string, grade double").option("multiLine", True).json(path).where("candidate_id is not null and grade is not null")


def load_model_grades(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; those that don't parse, or whose grade isn't 0 to 4 when rounded, are left out. The last line of an id counts."""
    x = spark.read.text(path).select(F.monotonically_increasing_id().alias("n"), F.from_json("value", "candidate_id string, grade_llm double, reason string", {"mode": "PERMISSIVE"}).alias("r")).select("n", "r.*")
    x = x.withColumn("grade_llm", F.bround("grade_llm").cast("int")).where("candidate_id is not null and grade_llm between 0 and 4")
    return x.groupBy("candidate_id").agg(F.max_by(F.struct("grade_llm", "reason"), "n").alias("r")).select("candidate_id", "r.*")


def overlay(base: DataFrame, over: DataFrame) -> DataFrame:
    """Grades of `base`, replaced or extended by those of `over`."""
    return base.alias("b").join(over.alias("o"), "candidate_id", "full_outer").select("candidate_id", F.coalesce("o.grade", "b.grade").alias("grade"))
