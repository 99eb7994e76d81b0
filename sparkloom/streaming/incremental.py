"""Scoring of records as they arrive. An extension: the batch ranking has no stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.profile import RankProfile
from ..operators.scoring import with_scores
from ..plans.rank import prepared
from ..sources.records import RECORD


def stream_records(spark: SparkSession, folder: str, files: int = 16) -> DataFrame:
    return spark.readStream.schema(RECORD).option("maxFilesPerTrigger", files).json(folder)


def scored_stream(records: DataFrame, p: RankProfile) -> DataFrame:
    """Row by row and so without state: features, flags and scores, without retrieval and reranker."""
    x = records.withColumns({"semantic_sim": F.lit(None).cast("double"), "ce_score": F.lit(None).cast("double")})
    x = prepared(x, p)
    return with_scores(x.withColumn("semantic_sim", F.lit(0.0))).select("candidate_id", "is_honeypot", "honeypot_reasons", "behavioral_mult", "base_score", "final_score")
