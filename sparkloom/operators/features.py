"""Relevance features of a record, each a column built from the record and the rank profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions.profile import RankProfile
from ..functions.scalars import calendar_months, clean, iso_date, whole_words
from . import text

P = "profile"


def years() -> Column:
    return F.coalesce(F.col(f"{P}.years_of_experience"), F.lit(0.0))


def roles() -> Column:
    return F.coalesce("career_history", F.array())


def months(r: Column) -> Column:
    return F.coalesce(r["duration_months"], F.lit(0))


def hits(words, s: Column, prefixes=()) -> Column:
    return s.rlike(whole_words(words, prefixes))


def title_class(p: RankProfile, title: Column) -> Column:
    """strong, nontech, adjacent or other: the first that matches in this order."""
    t = clean(title)
    return F.when(hits(p.strong_titles, t), "strong").when(hits(p.nontech_words, t, p.nontech_prefixes), "nontech").when(hits(p.adjacent_titles, t), "adjacent").otherwise("other")


def areas_hit(p: RankProfile, s: Column) -> Column:
    return F.array_compact(F.array(*[F.when(hits(words, s), F.lit(name)) for name, words in p.areas.items()]))


def skill_count(p: RankProfile) -> Column:
    """Skill rows, not distinct names."""
    return F.size(F.filter(F.coalesce("skills", F.array()), lambda s: F.lower(clean(s["name"])).isin(list(p.skills))))


def firm_fraction(p: RankProfile) -> Column:
    """Share of roles whose company's name contains a firm's; 0 without roles."""
    at_firm = lambda r: F.exists(F.array(*map(F.lit, p.firms)), lambda f: F.contains(F.lower(F.coalesce(r["company"], F.lit(""))), f)) if p.firms else F.lit(False)
    return F.coalesce(F.try_divide(F.size(F.filter(roles(), at_firm)).cast("double"), F.size(roles())), F.lit(0.0))


def completed() -> Column:
    return F.filter(roles(), lambda r: ~F.coalesce(r["is_current"], F.lit(False)))


def average_tenure() -> Column:
    """Mean months of roles that have ended; null for fewer than two."""
    done = completed()
    total = F.aggregate(done, F.lit(0).cast("long"), lambda s, r: s + months(r))
    return F.when(F.size(done) >= 2, total / F.size(done))


def present_role() -> Column:
    """The first current role, else the first; null without roles."""
    return F.coalesce(F.try_element_at(F.filter(roles(), lambda r: F.coalesce(r["is_current"], F.lit(False))), F.lit(1)), F.try_element_at(roles(), F.lit(1)))


def role_substance(kind: Column, areas: Column) -> Column:
    title = F.when(kind == "strong", 1.0).when(kind == "adjacent", 0.45).when(kind == "other", 0.25).otherwise(0.0)
    n = F.size(areas)
    desc = F.when(n == 0, 0.0).when(n == 1, 0.5).when(n == 2, 0.8).otherwise(1.0)
    return F.round(0.45 * title + 0.55 * desc, 4)


def skill_corroboration(n_skills: Column, areas: Column) -> Column:
    return F.when(n_skills < 4, 1.0).otherwise(F.least(F.lit(1.0), F.size(areas) / 2.0))


def experience_band(p: RankProfile, y: Column, below: float = 2.0, above: float = 4.0) -> Column:
    """1 in the ideal band; straight to 0 at `below` under the band's least and `above` over its most."""
    low, high = p.band_min - below, p.band_max + above
    rise = (y - low) / (p.ideal_min - low)
    fall = (high - y) / (high - p.ideal_max)
    return F.when((y >= p.ideal_min) & (y <= p.ideal_max), 1.0).otherwise(F.round(F.greatest(F.lit(0.0), F.when(y < p.ideal_min, rise).otherwise(fall)), 4))


def nlp_signal(s: Column) -> Column:
    return F.when(hits(L.NLP_IR, s), 1.0).when(hits(L.VISION_SPEECH_ROBOTICS, s), 0.0).otherwise(0.5)


def product_share(fraction: Column) -> Column:
    return F.when(fraction >= 0.999, 0.0).otherwise(F.round(1.0 - fraction, 4))


def production_recency(p: RankProfile) -> Column:
    r = present_role()
    about = F.concat_ws("  ", r["title"], r["description"])
    leads, ships = hits(L.LEAD_WORDS, F.coalesce(r["title"], F.lit(""))), hits(L.BUILD_VERBS, about)
    held = F.coalesce(calendar_months(iso_date(r["start_date"]), F.lit(p.reference_date).cast("date")), F.lit(0))
    return F.when(r.isNull(), 0.5).when(leads & ~ships, F.when(held >= 18, 0.1).otherwise(0.2)).when(ships, 1.0).otherwise(0.6)


def tenure_stability(avg: Column) -> Column:
    return F.when(avg.isNull(), 0.7).when(avg >= 24, 1.0).when(avg >= 18, 0.6).otherwise(0.2)


def external_validation(github: Column) -> Column:
    return F.when(github.isNull() | F.isnan(github) | (github < 0), 0.5).otherwise(F.round(0.5 + 0.5 * F.least(F.lit(1.0), github / 70.0), 4))


def location_fit(p: RankProfile) -> Column:
    home = F.lower(clean(F.col(f"{P}.country"))) == p.home_country
    city = hits(p.cities, F.coalesce(f"{P}.location", F.lit("")))
    return F.when(home, F.when(city, 1.0).otherwise(0.8)).when(F.coalesce(F.col("signals.willing_to_relocate"), F.lit(False)), 0.45).otherwise(0.15)


FEATURES = ["role_substance", "skill_corroboration", "experience_band", "nlp_ir_signal", "product_vs_consulting", "production_recency", "tenure_stability", "external_validation", "location_fit"]


def with_features(records: DataFrame, p: RankProfile) -> DataFrame:
    """Adds title_class, areas, n_skills, firm_fraction, avg_tenure and the nine features. Engagement signals are in `signals`."""
    x = records.withColumn("career_text", text.career_text())
    x = x.withColumns({"title_class": title_class(p, F.col(f"{P}.current_title")), "areas": areas_hit(p, F.col("career_text")), "n_skills": skill_count(p), "firm_fraction": firm_fraction(p), "avg_tenure": average_tenure()})
    return x.withColumns({
        "role_substance": role_substance(F.col("title_class"), F.col("areas")),
        "skill_corroboration": skill_corroboration(F.col("n_skills"), F.col("areas")),
        "experience_band": experience_band(p, years()),
        "nlp_ir_signal": nlp_signal(F.col("career_text")),
        "product_vs_consulting": product_share(F.col("firm_fraction")),
        "production_recency": production_recency(p),
        "tenure_stability": tenure_stability(F.col("avg_tenure")),
        "external_validation": external_validation(F.col("signals.github_activity_score")),
        "location_fit": location_fit(p),
    })
