"""The offline lab: one scored table that sweeps read, the sweep with its baseline and checks, the learned combiner against the weights, and what they leave on disk."""

from __future__ import annotations

import csv
import json
from pathlib import Path

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.lexicons import SEED, WEIGHTS
from ..functions.profile import RankProfile
from ..operators import anchors, ltr, metrics, sampling, scoring, sweep
from .evaluate import rank_silver, report

CACHE = ["candidate_id", *WEIGHTS, "is_honeypot", "behavioral_mult", "final_score"]


class UnfaithfulCache(RuntimeError):
    pass


def cached(scored: DataFrame) -> DataFrame:
    """What re-ranking needs of scored records."""
    return scored.select(*CACHE)


def build_cache(scored: DataFrame, path: str, ranking_csv: str | None = None, grades: DataFrame | None = None) -> DataFrame:
    """Writes the cache as Parquet and reads it again; raises if re-ranking it with the default weights isn't the scorer's own order. Optionally also the ranking as CSV."""
    cached(scored).write.mode("overwrite").parquet(path)
    cache = load_cache(scored.sparkSession, path)
    own = Window.orderBy(F.desc(F.round("final_score", 12)), "candidate_id")
    other = sweep.unfaithful(sweep.reranked(cache, sweep.default_weights(cache.sparkSession)), cache.select("candidate_id", F.row_number().over(own).alias("rank")))
    if first := other.limit(1).collect():
        raise UnfaithfulCache(f"the default weights give {first[0][0]} another place than the scorer does")
    if ranking_csv:
        write_ranking(cache, ranking_csv, grades)
    return cache


def load_cache(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(*CACHE)


def write_ranking(cache: DataFrame, path: str, grades: DataFrame | None = None, most: int = 100_000) -> None:
    """rank, candidate_id, score, grade of the best `most` as one CSV file; ungraded rows have no grade."""
    rows = rank_silver(cache, cache).join(cache.select("candidate_id", "final_score"), "candidate_id")
    rows = rows.join(grades.select("candidate_id", "grade"), "candidate_id", "left") if grades is not None else rows.withColumn("grade", F.lit(None).cast("double"))
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f)
        out.writerow(["rank", "candidate_id", "score", "grade"])
        for r in rows.where(F.col("rank") <= most).orderBy("rank").toLocalIterator():
            out.writerow([r["rank"], r["candidate_id"], f"{r['final_score']:.6f}", "" if r["grade"] is None else f"{r['grade']:g}"])


def _both_parts(ranking: DataFrame, parts: DataFrame, gone: DataFrame | None) -> dict[str, dict[str, dict]]:
    """config -> part -> metrics of a ranking of few configs."""
    out: dict[str, dict[str, dict]] = {}
    for part in ("train", "val"):
        for r in sweep.split_metrics(ranking, parts, part, gone).collect():
            d = r.asDict()
            out.setdefault(d.pop("config"), {})[part] = d
    return out


def flagged(ranking: DataFrame, cache: DataFrame) -> dict[str, int]:
    return metrics.flagged_in_top(ranking.join(cache.select("candidate_id", "is_honeypot"), "candidate_id")).first().asDict()


def run_sweep(cache: DataFrame, grades: DataFrame, p: RankProfile, grid: DataFrame | None = None, held: DataFrame | None = None, top: int = 8, seed: int = SEED) -> dict:
    """The sweep's best settings and choice, the default weights' metrics, flagged records at the top under either, and the anchors that the grader misses. `held`: ids that are neither ranked nor graded."""
    spark = cache.sparkSession
    grid = sweep.weight_grid(spark) if grid is None else grid
    best = [r.asDict() for r in sweep.run_sweep(cache, grades, grid, held, top, seed).collect()]
    chosen = next((r["config"] for r in best if r["chosen"]), None)
    known = grades if held is None else grades.join(held.select("candidate_id"), "candidate_id", "left_anti")
    parts = sampling.split(known, "candidate_id", seed)
    both = sweep.default_weights(spark).unionByName(grid.where(F.col("config") == chosen))
    ranking = sweep.reranked(cache, both)
    figures = _both_parts(ranking, parts, held)
    tops = {c: flagged(ranking.where(F.col("config") == c), cache) for c in figures}
    missed = [r["name"] for r in anchors.check(spark, p).where("not ok").collect()]
    return {"best": best, "chosen": chosen, "baseline": figures.get("default"), "chosen_metrics": figures.get(chosen), "flagged": tops, "anchors_missed": missed}


def model_ranking(cache: DataFrame, model: PipelineModel) -> DataFrame:
    """(config, candidate_id, final_score, rank) with a fitted learner in the place of the weighted mean; floor and multiplier stay."""
    x = model.transform(cache.select("candidate_id", *[F.col(f).cast("double").alias(f) for f in WEIGHTS], "is_honeypot", "behavioral_mult"))
    base = 1 / (1 + F.exp(-F.col("prediction")))
    x = x.select(F.lit("model").alias("config"), "candidate_id", F.when(F.col("is_honeypot"), scoring.FLOOR).otherwise(base * F.col("behavioral_mult")).alias("final_score"))
    return x.withColumn("rank", F.row_number().over(Window.partitionBy("config").orderBy(F.desc(F.round("final_score", 12)), "candidate_id")))


def head_to_head(cache: DataFrame, model: PipelineModel, parts: DataFrame, held: DataFrame | None = None, least_gain: float = 0.0) -> dict:
    """Metrics of learner and weights on both parts, flagged records at the top, the gain on val, and whether to adopt."""
    ranking = model_ranking(cache, model).unionByName(sweep.reranked(cache, sweep.default_weights(cache.sparkSession)))
    figures = _both_parts(ranking, parts, held)
    gain = figures["model"]["val"]["composite"] - figures["default"]["val"]["composite"]
    tops = {c: flagged(ranking.where(F.col("config") == c), cache) for c in figures}
    return {"model": figures["model"], "baseline": figures["default"], "flagged": tops, "val_gain": gain, "adopt": ltr.adopt(gain, 0.0, least_gain)}


def run_learned(cache: DataFrame, grades: DataFrame, folder: str, held: DataFrame | None = None, rounds: int = 50, seed: int = SEED, least_gain: float = 0.0) -> dict:
    """Splits, trains on train, saves the model below `folder`, loads it again, compares, and saves the figures."""
    spark = cache.sparkSession
    none = spark.createDataFrame([], "candidate_id string")
    known = grades if held is None else grades.join(held.select("candidate_id"), "candidate_id", "left_anti")
    parts = sampling.split(known, "candidate_id", seed)
    rows = ltr.training_set(cache, parts, none if held is None else held.select("candidate_id"))
    ltr.train_pointwise(rows, rounds).write().overwrite().save(f"{folder}/model")
    out = head_to_head(cache, PipelineModel.load(f"{folder}/model"), parts, held, least_gain)
    return save_result(out | {"features": list(WEIGHTS), "rounds": rounds, "seed": seed}, f"{folder}/result.json")


def save_result(result: dict, path: str) -> dict:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(result, indent=1, sort_keys=True), encoding="utf-8")
    return result


def result_text(result: dict) -> str:
    """Lines `path  value` of a result's figures."""
    out = []

    def walk(at: str, x) -> None:
        if isinstance(x, dict):
            for k, v in sorted(x.items()):
                walk(f"{at}.{k}" if at else k, v)
        elif isinstance(x, list):
            for k, v in enumerate(x):
                walk(f"{at}[{k}]", v)
        else:
            out.append(f"{at:40s} {x:.4f}" if isinstance(x, float) else f"{at:40s} {x}")

    walk("", result)
    return "\n".join(out)


def write_silver(labels: DataFrame, prompts: DataFrame, p: RankProfile, folder: str) -> None:
    """What a labelling run leaves: labels and prompts as JSON lines, the sample's ids, and the anchors' check. `labels` is evaluate.silver_labels; `prompts` has candidate_id and prompt."""
    labels.write.mode("overwrite").json(f"{folder}/labels")
    labels.select("candidate_id").orderBy("candidate_id").write.mode("overwrite").text(f"{folder}/sample_ids")
    prompts.join(labels.select("candidate_id"), "candidate_id", "left_semi").select("candidate_id", "prompt").write.mode("overwrite").json(f"{folder}/prompts")
    anchors.check(labels.sparkSession, p).write.mode("overwrite").json(f"{folder}/anchors")


def ranking_text(top: DataFrame, n: int = 10) -> str:
    """The first n rows (rank, candidate_id, score) as lines."""
    return "\n".join(f"{r['rank']:>4d}  {r['candidate_id']}  {r['score']:.6f}" for r in top.orderBy("rank").limit(n).collect())


__all__ = ["UnfaithfulCache", "build_cache", "cached", "flagged", "head_to_head", "load_cache", "model_ranking", "ranking_text", "report", "result_text", "run_learned", "run_sweep", "save_result", "write_ranking", "write_silver"]
