"""Ranking metrics over rows (rank, relevance), and agreement of two graders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.order import with_average_place

MOST_CELLS = 20_000
COMPOSITE = {"ndcg10": 0.50, "ndcg50": 0.30, "map": 0.15, "p10": 0.05}


def gain(rel: Column, rank: Column) -> Column:
    return (F.pow(F.lit(2.0), rel) - 1.0) / F.log2(rank + 1.0)


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def with_ideal(rows: DataFrame, by: list[str]) -> DataFrame:
    """Adds the place each row would have if relevance ruled."""
    return rows.withColumn("ideal_rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("rel"), "rank")))


def dcg(k: int, rank: str = "rank") -> Column:
    return F.coalesce(F.sum(F.when(F.col(rank) <= k, gain(F.col("rel"), F.col(rank)))), F.lit(0.0))


def precision(k: int, threshold: float) -> Column:
    """Places beyond the list's end don't count against it."""
    hit = F.sum(F.when((F.col("rank") <= k) & (F.col("rel") >= threshold), 1.0).otherwise(0.0))
    return ratio(hit, F.least(F.lit(k), F.max("rank")).cast("double"))


def metrics(rows: DataFrame, by: list[str] | None = None, threshold: float = 1.0) -> DataFrame:
    """ndcg10, ndcg50, map, p10 and composite of each group of rows (rank from 1 without gaps, rel)."""
    by = by or []
    w = Window.partitionBy(*by).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    x = with_ideal(rows, by).withColumn("hit", (F.col("rel") >= threshold).cast("double"))
    x = x.withColumn("seen", F.sum("hit").over(w))
    ap = ratio(F.sum(F.when(F.col("hit") > 0, F.col("seen") / F.col("rank")).otherwise(0.0)), F.sum("hit"))
    out = x.groupBy(*by).agg(ratio(dcg(10), dcg(10, "ideal_rank")).alias("ndcg10"), ratio(dcg(50), dcg(50, "ideal_rank")).alias("ndcg50"), F.coalesce(ap, F.lit(0.0)).alias("map"), F.coalesce(precision(10, threshold), F.lit(0.0)).alias("p10"))
    return out.withColumn("composite", sum((F.col(m) * c for m, c in COMPOSITE.items()), F.lit(0.0)))


def graded(ranking: DataFrame, grades: DataFrame, ident: str = "candidate_id") -> DataFrame:
    """(ident, rank, rel): rows without a grade count as 0."""
    return ranking.join(grades.select(ident, F.col("grade").alias("rel")), ident, "left").select(*[c for c in ranking.columns], F.coalesce(F.col("rel").cast("double"), F.lit(0.0)).alias("rel"))


def evaluate(ranking: DataFrame, grades: DataFrame, ident: str = "candidate_id", threshold: float = 3.0) -> DataFrame:
    return metrics(graded(ranking, grades, ident), threshold=threshold)


def grade_histogram(rows: DataFrame, most: int = 4) -> DataFrame:
    """(grade, n) for each grade from 0 to the most, those without rows too; null grades count as 0."""
    n = rows.groupBy(F.coalesce(F.col("grade").cast("int"), F.lit(0)).alias("grade")).agg(F.count("*").alias("n"))
    return rows.sparkSession.range(most + 1).select(F.col("id").cast("int").alias("grade")).join(n, "grade", "left").select("grade", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def flagged_in_top(rows: DataFrame, tops: tuple[int, ...] = (10, 50, 100)) -> DataFrame:
    return rows.agg(*[F.coalesce(F.sum(F.when((F.col("rank") <= k) & F.col("is_honeypot"), 1).otherwise(0)), F.lit(0)).cast("long").alias(f"top{k}") for k in tops])


def pearson(x: str, y: str) -> Column:
    """0 where it isn't defined."""
    c = F.corr(x, y)
    return F.when(c.isNull() | F.isnan(c), 0.0).otherwise(c)


def spearman(pairs: DataFrame) -> DataFrame:
    """Correlation of places; equal values share the mean of theirs. 0 of fewer than two pairs."""
    return with_average_place(with_average_place(pairs, "a", "ra"), "b", "rb").agg(F.when(F.count("*") < 2, 0.0).otherwise(pearson("ra", "rb")).alias("rho"))


def kendall(pairs: DataFrame) -> DataFrame:
    """Tau-b from counts of equal pairs: work grows with the square of distinct pairs, not of rows. Made for grades; more than MOST_CELLS distinct pairs are refused."""
    g = pairs.groupBy("a", "b").agg(F.count("*").alias("n"))
    h = g.select(F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("n").alias("n2"))
    if g.limit(MOST_CELLS + 1).count() > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} distinct pairs of grades")
    x = g.join(F.broadcast(h), (F.col("a") < F.col("a2")) | ((F.col("a") == F.col("a2")) & (F.col("b") < F.col("b2"))))
    sign = F.signum(F.col("a2") - F.col("a")) * F.signum(F.col("b2") - F.col("b"))
    pairs_n = F.col("n").cast("double") * F.col("n2")
    s = x.agg(F.sum(F.when(sign > 0, pairs_n).otherwise(0.0)).alias("c"), F.sum(F.when(sign < 0, pairs_n).otherwise(0.0)).alias("d"), F.sum(F.when((F.col("a") == F.col("a2")), pairs_n).otherwise(0.0)).alias("ta"), F.sum(F.when((F.col("b") == F.col("b2")), pairs_n).otherwise(0.0)).alias("tb"))
    low = F.sqrt((F.col("c") + F.col("d") + F.col("ta")) * (F.col("c") + F.col("d") + F.col("tb")))
    return s.select(F.coalesce(F.try_divide(F.col("c") - F.col("d"), low), F.lit(0.0)).alias("tau"))


def agreement(pairs: DataFrame) -> DataFrame:
    """n, exact, within_one, rho, tau of (a, b); nulls without pairs."""
    base = pairs.agg(F.count("*").alias("n"), F.round(F.avg((F.col("a") == F.col("b")).cast("double")), 4).alias("exact"), F.round(F.avg((F.abs(F.col("a") - F.col("b")) <= 1).cast("double")), 4).alias("within_one"))
    x = base.crossJoin(spearman(pairs)).crossJoin(kendall(pairs))
    return x.select("n", "exact", "within_one", *[F.when(F.col("n") > 0, F.round(c, 4)).alias(c) for c in ("rho", "tau")])


def reconciled(rules: Column, model: Column, forced: Column) -> tuple[Column, Column]:
    """Final grade and needs_review: forced zeros stand; without a model's grade the rules'; two apart or more is for review; else the mean, halves up."""
    far = F.abs(rules - model) >= 2
    grade = F.when(forced, 0).when(model.isNull(), rules).when(~far, F.floor((rules + model) / 2.0 + 0.5).cast("int"))
    return grade, F.coalesce(~forced & far, F.lit(False))
