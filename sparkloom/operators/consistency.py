"""Records that contradict themselves, and records that list skills their career doesn't show."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.profile import RankProfile
from ..functions.scalars import iso_date
from .features import months, roles, years


def contradiction_reasons(p: RankProfile) -> Column:
    """Reasons in fixed order; an empty array for a sound record. Unknown months of a skill count as none."""
    career = years() * 12.0
    shown = F.format_string("%.0f", F.bround(career, 0))
    long_role = F.try_element_at(F.filter(roles(), lambda r: months(r) > career + 6), F.lit(1))
    total = F.aggregate(roles(), F.lit(0).cast("long"), lambda s, r: s + months(r))
    idle = F.size(F.filter(F.coalesce("skills", F.array()), lambda s: F.coalesce(s["proficiency"], F.lit("")).isin("advanced", "expert") & (F.coalesce(s["duration_months"], F.lit(0)) == 0)))
    today = F.lit(p.reference_date).cast("date")

    def dates(r: Column) -> Column:
        start, end = iso_date(r["start_date"]), iso_date(r["end_date"])
        return F.when(start > today, "role start date in the future").when(end < start, "role end date precedes start date")

    return F.array_compact(F.array(
        F.when((career > 0) & long_role.isNotNull(), F.concat(F.lit("role tenure "), months(long_role).cast("string"), F.lit("mo exceeds total experience "), shown, F.lit("mo"))),
        F.when((career > 0) & (total > career * 1.5 + 24), F.concat(F.lit("summed role tenure "), total.cast("string"), F.lit("mo >> career "), shown, F.lit("mo"))),
        F.when(idle >= 3, F.concat(idle.cast("string"), F.lit(" advanced/expert skills with 0 months used"))),
        F.try_element_at(F.array_compact(F.transform(roles(), dates)), F.lit(1)),
    ))


def is_stuffer() -> Column:
    """A title outside the field, four skills of the field or more, and nothing of it in the career."""
    return (F.col("title_class") == "nontech") & (F.col("n_skills") >= 4) & (F.size("areas") == 0)
