"""Strata, seeded samples by hash order, splits, round-robin picks.

Order by the hash of seed and id stands in for a random generator: it is the same in
every engine and for every partitioning, depends on the seed, and gives exact counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.lexicons import IR_AREAS, SEED
from . import consistency, features

#: Sizes of the label sample.
STRATA = {"suspected_honeypot": 80, "suspected_stuffer": 80, "strong_ml": 100, "adjacent_gem": 80}
TOTAL = 400


def lot(ident: str, seed: int | Column) -> Column:
    s = F.lit(str(seed)) if isinstance(seed, int) else seed.cast("string")
    return F.sha2(F.concat(s, F.lit(":"), F.col(ident).cast("string")), 256)


def stratum() -> Column:
    """Of records with features and honeypot_reasons; null for none of the special strata."""
    return F.when(F.size("honeypot_reasons") > 0, "suspected_honeypot").when(consistency.is_stuffer(), "suspected_stuffer").when(F.col("title_class") == "strong", "strong_ml").when((F.col("title_class") == "adjacent") & (F.size("areas") > 0), "adjacent_gem")


def stratified_sample(rows: DataFrame, ident: str = "candidate_id", targets: dict[str, int] = STRATA, total: int = TOTAL, seed: int = SEED) -> DataFrame:
    """(ident, stratum): each stratum's target, then rows of no stratum (as random_pool) up to the total."""
    w = Window.partitionBy("stratum").orderBy(lot(ident, seed), ident)
    x = rows.where(F.col(ident).isNotNull()).select(ident, F.coalesce("stratum", F.lit("random_pool")).alias("stratum")).withColumn("n", F.row_number().over(w))
    top = F.create_map(*[v for k, n in targets.items() for v in (F.lit(k), F.lit(n))])
    special = x.where(F.col("n") <= F.try_element_at(top, F.col("stratum")))
    used = special.agg(F.count("*").alias("used"))
    fill = x.where("stratum = 'random_pool'").crossJoin(F.broadcast(used)).where(F.col("n") <= F.greatest(F.lit(0), total - F.col("used"))).drop("used")
    return special.union(fill).select(ident, "stratum")


def pool_sample(rows: DataFrame, exclude: DataFrame, n: int, ident: str = "candidate_id", seed: int = SEED) -> DataFrame:
    """n rows that aren't excluded."""
    return rows.join(exclude.select(ident), ident, "left_anti").orderBy(lot(ident, seed), ident).limit(n)


def split(grades: DataFrame, ident: str = "candidate_id", seed: int = SEED) -> DataFrame:
    """Adds part: of each whole grade the first half, rounded down, is train, the rest val."""
    g = F.col("grade").cast("int")
    w = Window.partitionBy(g)
    x = grades.withColumn("n", F.row_number().over(w.orderBy(lot(ident, F.lit(seed) + g), ident))).withColumn("all", F.count("*").over(w))
    return x.withColumn("part", F.when(F.col("n") <= F.floor(F.col("all") / 2), "train").otherwise("val")).drop("n", "all")


def round_robin(rows: DataFrame, bucket: str, order: list, bucket_order: list, k: int) -> DataFrame:
    """k rows: the best of each bucket in bucket order, then the second best of each, and so on."""
    x = rows.withColumn("turn", F.row_number().over(Window.partitionBy(bucket).orderBy(*order)))
    return x.orderBy("turn", *bucket_order).limit(k)


def demo_category() -> Column:
    """honeypot, stuffer, genuine, hidden_gem or noise, of records with features and honeypot_reasons."""
    home = F.lower(F.trim(F.coalesce("profile.country", F.lit("")))) == "india"
    n, y = F.size("areas"), features.years()
    ir = F.size(F.array_intersect("areas", F.array(*map(F.lit, IR_AREAS))))
    return (
        F.when(F.size("honeypot_reasons") > 0, "honeypot")
        .when(consistency.is_stuffer(), "stuffer")
        .when(home & (F.col("title_class") == "strong") & y.between(5, 9) & (n >= 2) & (ir >= 1), "genuine")
        .when(home & (F.col("title_class") == "adjacent") & y.between(4, 10) & (n >= 1), "hidden_gem")
        .otherwise("noise")
    )


def demo_select(rows: DataFrame, targets: dict[str, int], total: int = 150, seed: int = SEED) -> DataFrame:
    """(candidate_id, category): the best of each category, honeypots spread over kinds of reason and gems over titles, noise up to the total."""
    x = rows.withColumns({"category": demo_category(), "n_areas": F.size("areas"), "n_ir": F.size(F.array_intersect("areas", F.array(*map(F.lit, IR_AREAS))))})
    best = {"genuine": [F.desc("n_ir"), F.desc("n_areas"), "candidate_id"], "stuffer": [F.desc("n_skills"), "candidate_id"]}
    picks = [x.where(F.col("category") == c).orderBy(*o).limit(targets.get(c, 0)) for c, o in best.items()]
    pots = x.where("category = 'honeypot'").withColumn("kind", F.split(F.get("honeypot_reasons", F.lit(0)), " ")[0])
    picks.append(round_robin(pots, "kind", ["candidate_id"], ["kind"], targets.get("honeypot", 0)))
    gems = x.where("category = 'hidden_gem'").withColumn("kind", F.col("profile.current_title")).withColumn("top", F.max("n_areas").over(Window.partitionBy("kind")))
    picks.append(round_robin(gems, "kind", [F.desc("n_areas"), F.desc("n_ir"), "candidate_id"], [F.desc("top"), "kind"], targets.get("hidden_gem", 0)))
    chosen = picks[0].select("candidate_id", "category")
    for p in picks[1:]:
        chosen = chosen.union(p.select("candidate_id", "category"))
    used = chosen.count()
    rest = x.where("category in ('noise', 'hidden_gem', 'genuine')").join(chosen.select("candidate_id"), "candidate_id", "left_anti")
    noise = rest.orderBy(lot("candidate_id", seed), "candidate_id").limit(max(0, total - used)).select("candidate_id", F.lit("noise").alias("category"))
    return chosen.union(noise)
