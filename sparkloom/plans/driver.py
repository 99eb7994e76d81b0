"""The star-schema test tables seen as records: customers are profiles, orders their roles, parts their skills."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.profile import Aspect, RankProfile

REFERENCE = "2001-09-01"
TITLES = {"1-URGENT": "ML Engineer", "2-HIGH": "Backend Engineer", "3-MEDIUM": "Sales Executive", "4-NOT SPECIFIED": "Analyst", "5-LOW": "Data Scientist"}
DESCRIPTIONS = {"O": "built vector search and ranking", "F": "deployed a recommender in production", "P": "wrote reports"}
SKILLS = {"ECONOMY": "NLP", "PROMO": "PyTorch", "SMALL": "Excel", "MEDIUM": "LLM", "LARGE": "Bert", "STANDARD": "Welding"}
TERMS = ["our", "ated", "ente", "ensch", "outre", "estion", "ndat", "ente"]
ASPECTS = {"a": 0.6, "b": 0.4}

PROFILE = RankProfile(role="engineer", aspects={"a": Aspect(0.6, "our ated ente ensch"), "b": Aspect(0.4, "outre estion ndat ente")}, firms=("machinery", "furniture"), home_country="asia", cities=("nation_1", "nation_2", "nation_3"), reference_date=REFERENCE)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _map(d: dict[str, str], key) -> F.Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in d.items() for x in kv]), key)


def roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_custkey, o_orderkey, title, description, company, start, months, is_current)"""
    o = table(spark, sf_dir, "orders")
    last = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))) == 1
    return o.select("o_custkey", "o_orderkey", _map(TITLES, F.col("o_orderpriority")).alias("title"), _map(DESCRIPTIONS, F.col("o_orderstatus")).alias("description"), F.col("o_orderdate").cast("date").alias("start"), (F.col("o_orderkey") % 40).cast("int").alias("months"), last.alias("is_current"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with the canonical nested columns (education, certificates and languages are not used by any score)."""
    c, n, g = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    place = n.join(F.broadcast(g), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("city"), F.col("r_name").alias("country"))
    c = c.join(F.broadcast(place), "c_nationkey", "left")
    r = roles(spark, sf_dir)
    end = F.when(~F.col("is_current"), F.date_format(F.add_months("start", F.col("months")), "yyyy-MM-dd"))
    role = F.struct("o_orderkey", F.lower(F.col("description")).alias("company0"), "title", F.date_format("start", "yyyy-MM-dd").alias("start_date"), end.alias("end_date"), F.col("months").alias("duration_months"), "is_current", "description")
    r = r.groupBy("o_custkey").agg(F.sort_array(F.collect_list(role)).alias("r"))
    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    items = items.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    skill = F.struct("l_orderkey", "l_linenumber", "l_partkey", _map(SKILLS, F.col("p_type")).alias("name"), F.when(F.col("l_linenumber") % 3 == 0, "expert").otherwise("beginner").alias("proficiency"), (F.col("p_size") % 3).alias("duration_months"))
    s = items.where("l_linenumber <= 2 or l_linenumber = 3 and l_quantity < 10").groupBy("o_custkey").agg(F.sort_array(F.collect_list(skill)).alias("s"))
    x = c.join(r, F.col("c_custkey") == r["o_custkey"], "left").drop("o_custkey").join(s, F.col("c_custkey") == s["o_custkey"], "left").drop("o_custkey")
    none = F.array()
    present = F.try_element_at(F.filter(F.coalesce("r", none.cast(x.schema["r"].dataType)), lambda v: v["is_current"]), F.lit(1))
    profile = F.struct(F.col("c_name").alias("headline"), F.lit("").alias("summary"), F.col("city").alias("location"), F.col("country"), F.round(F.col("c_acctbal") / 1000 + 1, 1).alias("years_of_experience"), present["title"].alias("current_title"), F.col("c_mktsegment").alias("current_company"))
    career = F.transform("r", lambda v: F.struct(F.when(v["o_orderkey"] % 4 == 0, F.col("c_mktsegment")).otherwise("ACME").alias("company"), v["title"].alias("title"), v["start_date"].alias("start_date"), v["end_date"].alias("end_date"), v["duration_months"].alias("duration_months"), v["is_current"].alias("is_current"), v["description"].alias("description")))
    skills = F.transform("s", lambda v: F.struct(v["name"].alias("name"), v["proficiency"].alias("proficiency"), v["duration_months"].cast("int").alias("duration_months")))
    ev = table(spark, sf_dir, "events").groupBy("user_id").agg(F.date_format(F.max("ts"), "yyyy-MM-dd").alias("last"), F.count("*").alias("n"))
    x = x.join(ev, F.col("c_custkey") == F.col("user_id"), "left")
    k = F.col("c_custkey")
    signals = F.struct(
        F.when(F.col("last").isNotNull(), F.date_format(F.date_sub(F.lit(REFERENCE).cast("date"), F.coalesce(F.col("n"), F.lit(0)).cast("int") * 3), "yyyy-MM-dd")).alias("last_active_date"),
        (k % 11 / 10.0).alias("recruiter_response_rate"), (k % 7 / 6.0).alias("interview_completion_rate"), (k % 150).cast("int").alias("notice_period_days"), (k % 2 == 0).alias("open_to_work_flag"),
        (k % 8).cast("int").alias("saved_by_recruiters_30d"), (k % 10 / 10.0).alias("profile_completeness_score"), (k % 3 == 0).alias("verified_email"), (k % 5 == 0).alias("verified_phone"), (k % 90 - 1).cast("double").alias("github_activity_score"), (k % 4 == 0).alias("willing_to_relocate"),
    )
    return x.select(F.format_string("CAND_%07d", k).alias("candidate_id"), k.alias("c_custkey"), profile.alias("profile"), F.coalesce(career, none.cast("array<struct<company:string,title:string,start_date:string,end_date:string,duration_months:int,is_current:boolean,description:string>>")).alias("career_history"), F.coalesce(skills, none.cast("array<struct<name:string,proficiency:string,duration_months:int>>")).alias("skills"), signals.alias("signals"))
