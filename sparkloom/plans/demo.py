"""A small sample to show: its records and vectors on disk, and the view of a ranking of it."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.profile import RankProfile
from ..operators import reasoning, sampling

#: Fixed value: skills that no role bears out lie below this.
CORROBORATED = 0.5


def write_sample(x: DataFrame, vectors: DataFrame, folder: str, targets: dict[str, int], total: int = 150) -> DataFrame:
    """Chooses the sample (see sampling.demo_select), writes its records with their category and its vectors as Parquet, and returns the former."""
    spark = x.sparkSession
    chosen = sampling.demo_select(x, targets, total)
    columns = [c for c in ("candidate_id", "profile", "career_history", "education", "skills", "certifications", "languages", "signals") if c in x.columns]
    x.select(*columns).join(F.broadcast(chosen), "candidate_id").orderBy("candidate_id").write.mode("overwrite").parquet(f"{folder}/records")
    rows = spark.read.parquet(f"{folder}/records")
    vectors.join(F.broadcast(rows.select("candidate_id")), "candidate_id", "left_semi").write.mode("overwrite").parquet(f"{folder}/vectors")
    return rows


def view(scored: DataFrame, n: int = 15) -> dict[str, list[dict]]:
    """cards: the n best sound records with their score as a share of the best one; flagged: contradictory ones with their reasons; unproven: sound ones whose skills few roles bear out. `scored` is a sample, of a size to show."""
    order = [F.desc(F.round("final_score", 6)), "candidate_id"]
    sound = scored.where("not is_honeypot")
    best = F.max("final_score")
    top = sound.agg(best.alias("best"))
    share = F.when(F.col("best") > 0, F.round(100 * F.greatest(F.lit(0.0), F.col("final_score")) / F.col("best"), 1)).otherwise(0.0)
    cards = sound.orderBy(*order).limit(n).crossJoin(F.broadcast(top)).orderBy(*order)
    cards = cards.select("candidate_id", F.col("profile.current_title").alias("title"), F.col("profile.years_of_experience").alias("years"), F.col("profile.location").alias("location"), share.alias("percent"), reasoning.reasoning(F.col("profile.current_title"), F.col("profile.years_of_experience")).alias("reasoning"))
    flagged = scored.where("is_honeypot").orderBy("candidate_id").select("candidate_id", F.col("profile.current_title").alias("title"), "honeypot_reasons")
    unproven = sound.where(F.col("skill_corroboration") < CORROBORATED).orderBy("skill_corroboration", "candidate_id").select("candidate_id", F.col("profile.current_title").alias("title"), F.round("skill_corroboration", 2).alias("corroboration"))
    return {"cards": [r.asDict() for r in cards.collect()], "flagged": [r.asDict() for r in flagged.collect()], "unproven": [r.asDict() for r in unproven.collect()]}


def page(shown: dict[str, list[dict]], p: RankProfile) -> str:
    """The view as one HTML page; every text is escaped. Aspects stand by weight, the heaviest first."""
    e = lambda x: html.escape("" if x is None else str(x))
    aspects = "".join(f"<li>{e(k)} ({a.weight:g}): {e(a.query_text)}</li>" for k, a in sorted(p.aspects.items(), key=lambda x: (-x[1].weight, x[0])))
    cards = "".join(f"<article><h2>{k}. {e(c['title'])}</h2><p>{e(c['candidate_id'])}, {e(c['years'])} years, {e(c['location'])}</p><meter max=100 value={c['percent']:g}>{c['percent']:g} %</meter><p>{e(c['reasoning'])}</p></article>" for k, c in enumerate(shown["cards"], 1))
    flagged = "".join(f"<li>{e(c['candidate_id'])} {e(c['title'])}: {e('; '.join(c['honeypot_reasons']))}</li>" for c in shown["flagged"])
    unproven = "".join(f"<li>{e(c['candidate_id'])} {e(c['title'])}: {c['corroboration']:.2f}</li>" for c in shown["unproven"])
    return f"<!doctype html><meta charset=utf-8><title>{e(p.role)}</title><h1>{e(p.role)}</h1><ul>{aspects}</ul>{cards}<h2>Contradictory</h2><ul>{flagged}</ul><h2>Skills without proof</h2><ul>{unproven}</ul>"
