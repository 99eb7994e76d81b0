"""Composite score, selection of the best, guardrail, invariants, the submission file and its validator."""

from __future__ import annotations

import csv
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.lexicons import WEIGHTS
from ..functions.scalars import clamp01, weighted_mean

FLOOR = -1.0
HEADER = ["candidate_id", "rank", "score", "reasoning"]


def combined(weights: dict[str, float] | None = None) -> Column:
    """Weighted mean over the features that are there."""
    return weighted_mean([(F.col(f), w) for f, w in (weights or WEIGHTS).items()])


def with_scores(x: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """base_score and final_score; a contradictory record (is_honeypot) gets the floor."""
    x = x.withColumn("semantic_sim", clamp01(F.col("semantic_sim"))).withColumn("base_score", combined(weights))
    return x.withColumn("final_score", F.when(F.col("is_honeypot"), FLOOR).otherwise(F.col("base_score") * F.col("behavioral_mult")))


class SelectionError(ValueError):
    pass


def select_top(scored: DataFrame, n: int = 100, most_flagged: float = 0.10, unique: bool = True) -> DataFrame:
    """The n best by rounded score, ties by id, with rank and score; an error for repeated ids, too few rows or too many flagged ones."""
    if unique:
        twice = scored.groupBy("candidate_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
        if twice:
            raise SelectionError(f"id {twice[0][0]} occurs more than once")
    # The n rows are kept, so that the counts and what is made of the rows don't score everything again.
    top = scored.withColumn("score", F.round("final_score", 6)).orderBy(F.desc("score"), "candidate_id").limit(n).cache()
    found, flagged = top.agg(F.count("*"), F.coalesce(F.sum(F.col("is_honeypot").cast("int")), F.lit(0))).first()
    if found < n:
        raise SelectionError(f"{found} rows for {n} places")
    if n and flagged / n >= most_flagged:
        raise SelectionError(f"{flagged} of {n} selected rows are contradictory")
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "candidate_id")))


def violations(rows: DataFrame, n: int, place: str | None = None) -> DataFrame:
    """(error) for each broken rule of ranks 1 to n, unique ids, scores that don't rise, and ties by id. Rows stand in the order of `place`, else of their ranks; a selection is n rows, few enough for one task."""
    w = Window.orderBy(place or "rank")
    x = rows.withColumns({"place": F.row_number().over(w), "before": F.lag("score").over(w), "id_before": F.lag("candidate_id").over(w), "same": F.count("*").over(Window.partitionBy("candidate_id")), "all": F.count("*").over(Window.partitionBy())})
    rules = [
        ((F.col("place") == 1) & (F.col("all") != n), F.concat(F.lit(f"expected {n} rows, found "), F.col("all"))),
        (F.col("rank") != F.col("place"), F.concat(F.lit("rank "), F.col("rank"), F.lit(" at place "), F.col("place"))),
        (F.col("same") > 1, F.concat(F.lit("repeated id "), F.col("candidate_id"))),
        (F.isnan(F.col("score").cast("double")) | F.col("score").isNull(), F.concat(F.lit("score of "), F.col("candidate_id"), F.lit(" is no number"))),
        (F.col("score") > F.col("before"), F.concat(F.lit("score rises at rank "), F.col("rank"))),
        ((F.col("score") == F.col("before")) & (F.col("candidate_id") < F.col("id_before")), F.concat(F.lit("tie out of order at rank "), F.col("rank"))),
    ]
    return x.select(F.explode(F.array_compact(F.array(*[F.when(c, m) for c, m in rules]))).alias("error"))


def write_submission(rows: DataFrame, path: str) -> None:
    """One CSV file of the selected rows (a bounded number), scores with six decimals."""
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f)
        out.writerow(HEADER)
        for r in rows.orderBy("rank").select(*HEADER).collect():
            out.writerow([r[0], r[1], f"{r[2]:.6f}", r[3]])


def validate_submission(path: str, n: int = 100, pattern: str = r"CAND_[0-9]{7}") -> list[str]:
    """Every fault of a submission file; none for a good one. NaN scores are faults."""
    import re

    p = Path(path)
    if p.suffix.lower() != ".csv":
        return ["the file's name must end in .csv"]
    try:
        with p.open(encoding="utf-8", newline="") as f:
            rows = list(csv.reader(f))
    except UnicodeDecodeError:
        return ["the file is not UTF-8"]
    if not rows or rows[0] != HEADER:
        return [f"the header must be {','.join(HEADER)}"]
    rows = [r for r in rows[1:] if r]
    out = [] if len(rows) == n else [f"expected {n} rows, found {len(rows)}"]
    ids, ranks, good = set(), set(), []
    for k, r in enumerate(rows, 2):
        if len(r) != 4:
            out.append(f"line {k}: {len(r)} cells")
            continue
        ident, rank, score, _ = r
        if not re.fullmatch(pattern, ident):
            out.append(f"line {k}: id {ident!r}")
        if ident in ids:
            out.append(f"line {k}: repeated id {ident}")
        ids.add(ident)
        if not re.fullmatch(r"[1-9]\d*", rank) or int(rank) > n:
            out.append(f"line {k}: rank {rank!r}")
        elif int(rank) in ranks:
            out.append(f"line {k}: repeated rank {rank}")
        else:
            ranks.add(int(rank))
            try:
                value = float(score)
            except ValueError:
                value = float("nan")
            if value != value:
                out.append(f"line {k}: score {score!r}")
            else:
                good.append((int(rank), value, ident))
    good.sort()
    for (a, x, i), (b, y, j) in zip(good, good[1:], strict=False):
        if y > x:
            out.append(f"score rises from rank {a} to {b}")
        elif y == x and j < i:
            out.append(f"equal scores at ranks {a} and {b} are not in order of id")
    return out
