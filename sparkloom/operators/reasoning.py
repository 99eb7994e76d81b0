"""One line of text that says why a row stands where it does, from its own values alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scalars import clean

MOST = 320

# ---- Fixed values: (feature, [(condition, text, is a gap)]); the first condition that holds speaks. ----
CLAUSES = [
    ("role_substance", [(">= 0.8", "career history shows real retrieval/ranking/applied-ML substance", False), (">= 0.5", "some applied-ML substance in the role descriptions", False), ("< 0.25", "career descriptions show no retrieval/ranking/ML substance", True), ("< 0.5", "limited career substance for the role", True)]),
    ("experience_band", [(">= 0.999", "experience in the JD's target band", False), (">= 0.5", "experience close to the target band", False), ("< 0.5", "experience outside the target band", True)]),
    ("nlp_ir_signal", [(">= 0.999", "NLP/IR background present", False), ("<= 0.001", "CV/speech/robotics-heavy with no NLP/IR (a JD negative)", True)]),
    ("product_vs_consulting", [(">= 0.999", "product-company experience", False), ("<= 0.001", "career entirely at services/consulting firms", True), ("< 0.5", "much of the career at services/consulting firms", True)]),
    ("production_recency", [(">= 0.999", "recently shipping production code", False), ("<= 0.2", "in a non-coding lead role with no recent shipping", True)]),
    ("tenure_stability", [(">= 0.999", "stable role tenure", False), ("<= 0.2", "short average tenure (title-chaser signal)", True)]),
    ("external_validation", [(">= 0.8", "strong external GitHub/open-source validation", False), ("> 0.5", "some GitHub/open-source activity", False)]),
    ("location_fit", [(">= 0.999", "India Tier-1 location", False), (">= 0.8", "India-based", False), (">= 0.4", "non-India but relocation-willing", True), ("< 0.4", "non-India and not relocation-willing (JD down-weights)", True)]),
    ("skill_corroboration", [("< 0.5", "AI skills not corroborated by career history (keyword-stuffing signal)", True)]),
    ("semantic_sim", [(">= 0.6", "strong semantic match to the JD", False)]),
    ("ce_score", [(">= 0.6", "cross-encoder confirms description-level fit", False)]),
    ("behavioral_mult", [(">= 1.03", "engaged and available (behaviour lifts the score)", False), ("<= 0.95", "low engagement / availability drags the score", True)]),
]
FLOORED = "Flagged as an internally inconsistent profile and forced to the score floor: %s. Not ranked on merit."


def _spoken(gap: bool) -> Column:
    out = []
    for name, cases in CLAUSES:
        c = F.lit(None).cast("string")
        for cond, text, is_gap in reversed(cases):
            c = F.when(F.expr(f"{name} {cond}"), F.lit(text) if is_gap == gap else F.lit(None)).otherwise(c)
        out.append(c)
    return F.array_compact(F.array(*out))


def truncated(s: Column, most: int = MOST) -> Column:
    """White space collapsed; cut at a word, with an ellipsis, if too long."""
    s = F.regexp_replace(F.regexp_replace(s, r"\s+", " "), "^ | $", "")
    head = F.substring(s, 1, most - 1)
    cut = F.regexp_replace(F.when(F.contains(head, F.lit(" ")), F.regexp_replace(head, " [^ ]*$", "")).otherwise(head), "[,;. ]+$", "")
    return F.when(F.length(s) <= most, s).otherwise(F.concat(cut, F.lit("…")))


def lead(title: Column, years: Column) -> Column:
    """Title and years, one decimal at most; null if neither is there."""
    y = F.regexp_replace(F.format_string("%.1f", years), r"\.?0+$", "")
    y = F.when(F.round(years, 1) == 0, F.lit("0")).otherwise(F.when(F.format_string("%.1f", years).endswith(".0"), F.format_string("%.0f", years)).otherwise(y))
    return F.nullif(F.concat_ws(", ", F.nullif(clean(title), F.lit("")), F.when(years != 0, F.concat(y, F.lit(" yrs")))), F.lit(""))


def reasoning(title: Column | None = None, years: Column | None = None, most: int = MOST) -> Column:
    good, bad = _spoken(False), _spoken(True)
    opener = F.when((F.col("role_substance") >= 0.8) & (F.size(good) >= 2), "Strong fit").when(F.size(good) > 0, "Fit").otherwise("Limited fit")
    first = lead(title, years) if title is not None and years is not None else F.lit(None).cast("string")
    body = F.when(F.size(good) > 0, F.concat(opener, F.lit(": "), F.array_join(good, "; "))).otherwise(opener)
    gaps = F.when(F.size(bad) > 0, F.concat(F.lit("Gaps: "), F.array_join(bad, "; ")))
    merit = F.concat(F.concat_ws(". ", first, body, gaps), F.lit("."))
    why = F.when(F.size("honeypot_reasons") > 0, F.array_join("honeypot_reasons", "; ")).otherwise("internal inconsistency")
    return truncated(F.when(F.col("is_honeypot"), F.format_string(FLOORED, why)).otherwise(merit), most)
