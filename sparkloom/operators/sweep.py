"""Weight sweep over cached features: grid, re-ranking, split metrics, choice, faithfulness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.lexicons import SEED, WEIGHTS
from . import metrics, sampling

#: Levels of the three levers.
CE_LEVELS = [0.0, 0.10, 0.20, 0.30, 0.40]
ROLE_LEVELS = [0.15, 0.23, 0.30, 0.40]
SEMANTIC_LEVELS = [0.10, 0.20, 0.30]
LEVERS = ["ce_score", "role_substance", "semantic_sim"]
OTHERS = [f for f in WEIGHTS if f not in LEVERS]


def weight_grid(spark: SparkSession, ce: list[float] = CE_LEVELS, role: list[float] = ROLE_LEVELS, semantic: list[float] = SEMANTIC_LEVELS) -> DataFrame:
    """(config, one column w_<feature> each): what the levers leave is shared out pro rata; settings that leave nothing are dropped."""
    x = spark.range(1).select(F.explode(F.array(*map(F.lit, ce))).alias("w_ce_score"))
    x = x.select("*", F.explode(F.array(*map(F.lit, role))).alias("w_role_substance")).select("*", F.explode(F.array(*map(F.lit, semantic))).alias("w_semantic_sim"))
    rest = F.lit(1.0) - F.col("w_ce_score") - F.col("w_role_substance") - F.col("w_semantic_sim")
    small = sum(WEIGHTS[f] for f in OTHERS)
    x = x.where(rest > 1e-9).withColumns({f"w_{f}": rest * (WEIGHTS[f] / small) for f in OTHERS})
    name = F.format_string("ce=%.2f role=%.2f sem=%.2f", *[F.col(f"w_{f}") for f in LEVERS])
    return x.select(name.alias("config"), *[f"w_{f}" for f in WEIGHTS])


def default_weights(spark: SparkSession) -> DataFrame:
    """The grid of one row that holds the default weights."""
    return spark.range(1).select(F.lit("default").alias("config"), *[F.lit(w).alias(f"w_{f}") for f, w in WEIGHTS.items()])


def rescored() -> Column:
    """Final score from cached features under the weights in w_<feature>."""
    top = low = F.lit(0.0)
    for f in WEIGHTS:
        v, w = F.col(f), F.col(f"w_{f}")
        top, low = top + F.when(v.isNotNull(), v * w).otherwise(0.0), low + F.when(v.isNotNull(), w).otherwise(0.0)
    base = F.when(low > 0, F.try_divide(top, low)).otherwise(0.0)
    return F.when(F.col("is_honeypot"), -1.0).otherwise(base * F.col("behavioral_mult"))


def reranked(cache: DataFrame, grid: DataFrame, ident: str = "candidate_id") -> DataFrame:
    """(config, ident, final_score, rank). The grid has at most some dozens of rows and goes to the cache."""
    x = cache.crossJoin(F.broadcast(grid)).select("config", ident, rescored().alias("final_score"))
    return x.withColumn("rank", F.row_number().over(Window.partitionBy("config").orderBy(F.desc(F.round("final_score", 12)), ident)))


def split_metrics(ranking: DataFrame, parts: DataFrame, part: str, anchors: DataFrame | None = None, ident: str = "candidate_id", threshold: float = 3.0) -> DataFrame:
    """Metrics of each config over one part: rows of the other part and anchors go, ungraded rows stay as 0."""
    gone = parts.where(F.col("part") != part).select(ident)
    if anchors is not None:
        gone = gone.union(anchors.select(ident))
    x = ranking.join(gone.distinct(), ident, "left_anti")
    x = x.withColumn("rank", F.row_number().over(Window.partitionBy("config").orderBy("rank")))
    return metrics.metrics(metrics.graded(x, parts.where(F.col("part") == part), ident), ["config"], threshold)


def run_sweep(cache: DataFrame, grades: DataFrame, grid: DataFrame | None = None, anchors: DataFrame | None = None, top: int = 8, seed: int = SEED, ident: str = "candidate_id") -> DataFrame:
    """(config, train, val, chosen): the best `top` on train; of these the best on val is chosen."""
    grid = weight_grid(cache.sparkSession) if grid is None else grid
    if anchors is not None:
        grades = grades.join(anchors.select(ident), ident, "left_anti")
    parts = sampling.split(grades, ident, seed)
    ranking = reranked(cache, grid, ident)
    train = split_metrics(ranking, parts, "train", anchors, ident).select("config", F.round("composite", 9).alias("train"))
    val = split_metrics(ranking, parts, "val", anchors, ident).select("config", F.round("composite", 9).alias("val"))
    x = train.join(val, "config", "left").orderBy(F.desc("train"), "config").limit(top)
    return x.withColumn("chosen", F.row_number().over(Window.orderBy(F.desc("val"), F.desc("train"), "config")) == 1)


def unfaithful(ranking: DataFrame, original: DataFrame, ident: str = "candidate_id") -> DataFrame:
    """Rows (ident, rank) that are in one ranking and not in the other; none if the cache is faithful."""
    a, b = ranking.select(ident, "rank"), original.select(ident, "rank")
    return a.exceptAll(b).unionAll(b.exceptAll(a))
