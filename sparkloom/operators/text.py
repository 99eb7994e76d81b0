"""Texts made of a record: for embedding, for features, for lexical search, for a reader."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scalars import clean, filled


def _at(a: Column, b: Column, before: str = "") -> Column:
    """'a at b.', or the one of them that there is, or null."""
    both = F.concat_ws(" at ", filled(a), filled(b))
    return F.when(both != "", F.concat(F.lit(before), both, F.lit(".")))


def rich_text() -> Column:
    """Headline, summary, present role, each role with its description, skills; a line each, absent parts left out."""
    p = F.col("profile")
    roles = F.transform(F.coalesce("career_history", F.array()), lambda r: F.nullif(F.concat_ws(" ", _at(r["title"], r["company"]), filled(r["description"])), F.lit("")))
    named = F.filter(F.coalesce("skills", F.array()), lambda s: clean(s["name"]) != "")
    skills = F.array_join(F.transform(named, lambda s: F.when(clean(s["proficiency"]) != "", F.concat(clean(s["name"]), F.lit(" ("), clean(s["proficiency"]), F.lit(")"))).otherwise(clean(s["name"]))), ", ")
    return F.concat_ws("\n", filled(p["headline"]), filled(p["summary"]), _at(p["current_title"], p["current_company"], "Current role: "), F.array_compact(roles), F.when(skills != "", F.concat(F.lit("Skills: "), skills)))


def _some(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def career_text() -> Column:
    """Headline, summary, each role's title and description, two spaces between; what features read."""
    roles = F.flatten(F.transform(F.coalesce("career_history", F.array()), lambda r: F.array(_some(r["title"]), _some(r["description"]))))
    return F.concat_ws("  ", _some(F.col("profile.headline")), _some(F.col("profile.summary")), F.array_compact(roles))


def lexical_text() -> Column:
    """Headline, summary and descriptions: titles and skill names, which are easily stuffed, stay out."""
    return F.concat_ws("  ", _some(F.col("profile.headline")), _some(F.col("profile.summary")), F.array_compact(F.transform(F.coalesce("career_history", F.array()), lambda r: _some(r["description"]))))


def compact_text(summary: int = 500, description: int = 320, skills: int = 15) -> Column:
    """A short form for a human or a model that grades."""
    p = F.col("profile")
    cut = lambda c, n: F.substring(clean(c), 1, n)
    roles = F.transform(F.coalesce("career_history", F.array()), lambda r: F.concat(F.lit("- "), clean(r["title"]), F.lit(" @ "), clean(r["company"]), F.lit(" ("), F.coalesce(r["duration_months"].cast("string"), F.lit("?")), F.lit("mo): "), cut(r["description"], description)))
    names = F.transform(F.slice(F.coalesce("skills", F.array()), 1, skills), lambda s: clean(s["name"]))
    head = F.concat(clean(p["current_title"]), F.lit(", "), F.coalesce(p["years_of_experience"].cast("string"), F.lit("?")), F.lit(" yrs, "), clean(p["location"]), F.lit(", "), clean(p["country"]))
    return F.concat_ws("\n", head, _some(cut(p["summary"], summary)), roles, F.when(F.size(names) > 0, F.concat(F.lit("skills: "), F.array_join(names, ", "))))
