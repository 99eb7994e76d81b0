"""The rule grader: eight components, weights, gates, caps and forced zeros, all kept for inspection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions.profile import RankProfile
from ..functions.scalars import clean
from . import consistency, features

COMPONENTS = list(L.RUBRIC_WEIGHTS)


def _experience(p: RankProfile, y: Column) -> Column:
    near = ((y >= p.band_min - 1) & (y < p.band_min)) | ((y > p.band_max) & (y <= p.band_max + 2))
    return F.when((y >= p.ideal_min) & (y <= p.ideal_max), 1.0).when((y >= p.band_min) & (y <= p.band_max), 0.7).when(near, 0.35).otherwise(0.0)


def components(p: RankProfile) -> dict[str, Column]:
    """Of records with features; experience, recency and external validation differ from the ranker's on purpose."""
    github = F.coalesce("signals.github_activity_score", F.lit(-1.0))
    recency = F.col("production_recency")
    return {
        "role_substance": F.col("role_substance"),
        "experience_band": _experience(p, features.years()),
        "nlp_ir": F.col("nlp_ir_signal"),
        "product_company": F.when(F.col("firm_fraction") >= 0.999, 0.0).otherwise(1.0 - F.col("firm_fraction")),
        "production_recency": F.when(recency == 0.1, 0.2).otherwise(recency),
        "tenure_stability": F.col("tenure_stability"),
        "external_validation": F.when(github <= 0, 0.3).otherwise(0.5 + 0.5 * F.least(F.lit(1.0), github / 70.0)),
        "location": F.col("location_fit"),
    }


def caps(p: RankProfile) -> Column:
    """Map of the disqualifiers that hold to the grade they allow at most."""
    t, y = F.col("career_text"), features.years()
    hits = features.hits
    home = F.lower(clean(F.col("profile.country"))) == p.home_country
    rules = [
        ("consulting_only", 1, F.col("firm_fraction") >= 0.999),
        ("cv_speech_robotics_no_nlp", 1, hits(L.VISION_SPEECH_ROBOTICS, t) & ~hits(L.NLP_IR, t)),
        ("title_chaser", 2, (F.col("avg_tenure") < 18) & (F.size(features.completed()) >= 3)),
        ("pure_research_no_prod", 1, hits(L.RESEARCH, t) & ~hits(L.BUILD_VERBS, t)),
        ("langchain_only_recent", 1, hits(L.LANGCHAIN, t) & (y < 3) & ~hits(L.CLASSICAL_ML, t)),
        ("too_junior", 2, y < 4),
        ("too_senior", 2, y > 12),
        ("non_india_no_relocate", 3, ~home & ~F.coalesce("signals.willing_to_relocate", F.lit(False))),
    ]
    cells = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(n).alias("k"), F.lit(g).alias("v"))) for n, g, c in rules]))
    return F.map_from_entries(cells)


def graded(x: DataFrame, p: RankProfile) -> DataFrame:
    """Adds components, base_grade_score, gates, caps, forced and grade to records with features and honeypot_reasons."""
    total = float(sum(L.RUBRIC_WEIGHTS.values()))
    x = x.withColumn("components", F.struct(*[v.alias(k) for k, v in components(p).items()]))
    c = {k: F.col(f"components.{k}") for k in COMPONENTS}
    score = F.lit(0.0)
    for k in COMPONENTS:
        score = score + F.round(L.RUBRIC_WEIGHTS[k] / total * c[k], 4)
    x = x.withColumn("base_grade_score", F.round(score, 4)).withColumn("caps", caps(p))
    s = F.col("base_grade_score")
    tier = F.when(s >= 0.72, 4).when(s >= 0.55, 3).when(s >= 0.38, 2).when(s >= 0.20, 1).otherwise(0)
    y = features.years()
    core = (c["nlp_ir"] >= 0.5) & (c["product_company"] > 0)
    all_of = core & (c["role_substance"] >= 0.65) & y.between(p.band_min, p.band_max) & (c["production_recency"] >= 0.5)
    first = F.when((tier >= 4) & ~all_of, 3).otherwise(tier)
    x = x.withColumns({"tier": tier, "gate1": first})
    x = x.withColumn("gate2", F.when((F.col("gate1") >= 3) & ~(core & (c["role_substance"] >= 0.45)), 2).otherwise(F.col("gate1")))
    sub = c["role_substance"]
    cap = F.when(sub < 0.10, 0).when(sub < 0.20, 1).when(sub < 0.40, 2).otherwise(4)
    gates = F.array_compact(F.array(F.when(F.col("gate1") < F.col("tier"), F.lit("4->3: a must-have is missing")), F.when(F.col("gate2") < F.col("gate1"), F.lit("3->2: core substance is missing")), F.when(cap < F.col("gate2"), F.concat(F.lit("substance cap "), cap.cast("string")))))
    least = F.coalesce(F.array_min(F.map_values("caps")), F.lit(4))
    forced = F.array_compact(F.array(F.when(F.size("honeypot_reasons") > 0, F.lit("honeypot")), F.when(consistency.is_stuffer(), F.lit("keyword_stuffer"))))
    x = x.withColumns({"gates": gates, "forced": forced})
    return x.withColumn("grade", F.when(F.size("forced") > 0, 0).otherwise(F.least(F.col("gate2"), cap, least))).drop("gate1", "gate2", "tier")
