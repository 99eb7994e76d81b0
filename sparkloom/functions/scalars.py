"""Column builders: numbers, dates, texts and word patterns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clamp01(x: Column) -> Column:
    """Within 0 and 1; NaN and null become 0."""
    return F.when(x.isNull() | F.isnan(x), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def ramp(x: Column, low: float, high: float) -> Column:
    """0 at low, 1 at high, straight between; 0 if the ends meet or cross."""
    return F.lit(0.0) if high <= low else clamp01((x - low) / (high - low))


def bidirectional(x: Column, low: float, neutral: float, high: float, down: float, up: float) -> Column:
    """From 0 at neutral up to +up at high and down to -down at low."""
    return F.when(x >= neutral, up * ramp(x, neutral, high)).otherwise(-down * ramp(neutral - x, 0.0, neutral - low))


def sigmoid(x: Column) -> Column:
    """Logistic function whose exponent is never positive."""
    small = F.exp(-F.abs(x))
    return F.when(x >= 0, 1.0 / (1.0 + small)).otherwise(small / (1.0 + small))


def iso_date(s: Column) -> Column:
    """A date of the form yyyy-MM-dd, else null."""
    return F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(s, "yyyy-MM-dd"))


def calendar_months(start: Column, end: Column) -> Column:
    """Months between two dates by calendar month; days don't count."""
    return (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)


def clean(s: Column) -> Column:
    """Without white space around it; null becomes empty."""
    return F.coalesce(F.regexp_replace(s, r"^\s+|\s+$", ""), F.lit(""))


def filled(s: Column) -> Column:
    """The cleaned text, null if empty, so that concat_ws leaves it out."""
    return F.nullif(clean(s), F.lit(""))


def tokens(s: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(s, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def whole_words(terms: Iterable[str], prefixes: Iterable[str] = ()) -> str:
    """A pattern that finds any term as whole words, or any prefix at a word's beginning, whatever the case."""
    terms, prefixes = list(terms), list(prefixes)
    parts = ([rf"(?:{'|'.join(terms)})\b"] if terms else []) + prefixes
    return rf"(?iu)\b(?:{'|'.join(parts)})"


def ascii_words(terms: Iterable[str]) -> str:
    """Like whole_words over lower-case text, with ASCII word ends only: the same in engines whose \\b differs."""
    return rf"(^|[^a-z0-9])({'|'.join(terms)})([^a-z0-9]|$)"


def weighted_mean(pairs: list[tuple[Column, float]]) -> Column:
    """Mean over the values that are not null, weights scaled up to them; 0 if no weight is left."""
    top = sum((F.when(v.isNotNull(), v * w).otherwise(0.0) for v, w in pairs), F.lit(0.0))
    low = sum((F.when(v.isNotNull(), F.lit(float(w))).otherwise(0.0) for v, w in pairs), F.lit(0.0))
    return F.when(low > 0, F.try_divide(top, low)).otherwise(0.0)
