"""The engagement multiplier: a bounded product of signals, 1 when nothing is known."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scalars import bidirectional, iso_date, ramp

LOW, HIGH = 0.50, 1.15
DAYS_A_MONTH = 30.44


def recency(last: Column, reference: str) -> Column:
    """Up to 0.04 for activity within three months, down to -0.20 at twelve."""
    m = F.datediff(F.lit(reference).cast("date"), last) / DAYS_A_MONTH
    return F.when(m.isNull(), 0.0).when(m <= 3, 0.04 * ramp(3 - m, 0, 3)).otherwise(-0.20 * ramp(m, 3, 12))


def multiplier(s: Column, reference: str) -> Column:
    """Of a struct of signals. Negative rates and scores stand for unknown, as do nulls."""

    def known(x: Column, term: Column) -> Column:
        return F.when(x >= 0, term).otherwise(0.0)

    def if_there(x: Column, term: Column) -> Column:
        return F.when(x.isNull(), 0.0).otherwise(term)

    response, interview, github = s["recruiter_response_rate"], s["interview_completion_rate"], s["github_activity_score"]
    terms = [
        recency(iso_date(s["last_active_date"]), reference),
        known(response, bidirectional(response, 0.0, 0.44, 1.0, 0.12, 0.03)),
        known(interview, bidirectional(interview, 0.0, 0.50, 1.0, 0.10, 0.02)),
        if_there(s["notice_period_days"], -0.08 * ramp(s["notice_period_days"], 30, 120)),
        F.when(s["open_to_work_flag"], 0.02).otherwise(0.0),
        if_there(s["saved_by_recruiters_30d"], 0.02 * ramp(s["saved_by_recruiters_30d"], 0, 5)),
        if_there(s["profile_completeness_score"], bidirectional(s["profile_completeness_score"], 0.30, 0.70, 1.0, 0.03, 0.02)),
        F.when(s["verified_email"], 0.01).otherwise(0.0),
        F.when(s["verified_phone"], 0.01).otherwise(0.0),
        known(github, bidirectional(github, 0.0, 25.0, 70.0, 0.02, 0.02)),
    ]
    total = F.lit(1.0)
    for t in terms:
        total = total + t
    return F.greatest(F.lit(LOW), F.least(F.lit(HIGH), total))
