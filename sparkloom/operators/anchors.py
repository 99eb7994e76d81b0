"""Twelve made-up records whose grade is beyond doubt, and the check of the rule grader against them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.profile import RankProfile
from ..sources.records import RECORD
from . import consistency, features, grading

SEARCH = "Built and deployed embeddings with semantic search and learning to rank, and served it in production; watched NDCG and an A/B test."
TEXTS = "Built a recommender over natural language and information retrieval; the ranking model was trained and deployed."

#: (name, least and greatest grade, title, years, roles (firm, title, months, description), skills (name, level, months), what differs)
CASES = [
    ("fit_in_every_respect", 4, 4, "Senior AI Engineer", 7.0, [("Shopfront", "Senior AI Engineer", 30, SEARCH), ("Bazaar", "Machine Learning Engineer", 36, TEXTS)], [("NLP", "advanced", 24), ("Embeddings", "advanced", 24)], {}),
    ("role_longer_than_the_career", 0, 0, "Machine Learning Engineer", 3.0, [("Searchers", "ML Engineer", 120, TEXTS)], [("NLP", "advanced", 24)], {}),
    ("expert_without_a_month_of_use", 0, 0, "AI Engineer", 6.0, [("Riverside", "AI Engineer", 24, TEXTS)], [("NLP", "expert", 0), ("Embeddings", "expert", 0), ("Information Retrieval", "expert", 0), ("LLM", "expert", 0)], {}),
    ("skills_that_no_role_shows", 0, 0, "HR Manager", 8.0, [("Staffing", "HR Manager", 48, "Ran hiring, payroll and induction.")], [("Machine Learning", "advanced", 24), ("NLP", "advanced", 24), ("LLMs", "advanced", 24), ("Deep Learning", "advanced", 24)], {}),
    ("another_profession", 0, 0, "Accountant", 9.0, [("Ledgers", "Accountant", 60, "Kept the books, filed taxes, prepared audits.")], [("Excel", "advanced", 24)], {}),
    ("services_firms_only", 0, 1, "Machine Learning Engineer", 7.0, [("TCS", "Machine Learning Engineer", 36, TEXTS), ("Infosys", "Data Scientist", 36, SEARCH)], [("NLP", "advanced", 24)], {"company": "TCS"}),
    ("images_and_speech_only", 0, 1, "AI Engineer", 7.0, [("Cameras", "AI Engineer", 48, "Built object detection and image classification, and speech recognition for cars.")], [("Computer Vision", "advanced", 24)], {}),
    ("plain_title_real_work", 3, 4, "Data Engineer", 7.0, [("Kitchens", "Data Engineer", 30, SEARCH), ("Rides", "Software Engineer", 30, TEXTS)], [("Embeddings", "advanced", 24), ("NLP", "advanced", 24)], {}),
    ("two_years", 1, 2, "Machine Learning Engineer", 2.0, [("Newcomer", "ML Engineer", 24, SEARCH)], [("NLP", "intermediate", 18)], {}),
    ("end_of_the_band", 3, 4, "Machine Learning Engineer", 9.0, [("Dishes", "Machine Learning Engineer", 40, SEARCH), ("Purse", "Data Scientist", 40, TEXTS)], [("NLP", "advanced", 24), ("Embeddings", "advanced", 24)], {}),
    ("next_to_the_field", 0, 2, "Backend Engineer", 7.0, [("Forms", "Backend Engineer", 48, "Built web forms, payment services and their tables.")], [("Java", "advanced", 24)], {}),
    ("far_away_and_staying", 2, 3, "Senior AI Engineer", 7.0, [("Tills", "Senior AI Engineer", 40, SEARCH + " " + TEXTS)], [("NLP", "advanced", 24), ("Embeddings", "advanced", 24)], {"location": "Lisbon", "country": "Portugal", "willing_to_relocate": False}),
]


def records(spark: SparkSession) -> DataFrame:
    """The cases as typed records; ids are ANCHOR_001 and so on, the first role of each is the present one."""
    rows = []
    for n, (_, _, _, title, years, roles, skills, other) in enumerate(CASES, 1):
        profile = {"headline": title, "summary": "", "location": other.get("location", "Pune"), "country": other.get("country", "India"), "years_of_experience": years, "current_title": title, "current_company": other.get("company", roles[0][0])}
        career = [{"company": c, "title": t, "start_date": "2018-01-01", "end_date": None if k == 0 else "2021-01-01", "duration_months": m, "is_current": k == 0, "description": d} for k, (c, t, m, d) in enumerate(roles)]
        signals = {"github_activity_score": 40.0, "willing_to_relocate": other.get("willing_to_relocate", True), "last_active_date": "2026-06-01", "recruiter_response_rate": 0.6, "open_to_work_flag": True, "interview_completion_rate": 0.9, "notice_period_days": 30}
        rows.append({"candidate_id": f"ANCHOR_{n:03d}", "profile": profile, "career_history": career, "education": [], "skills": [{"name": s, "proficiency": p, "duration_months": m} for s, p, m in skills], "certifications": [], "languages": [], "signals": signals})
    return spark.createDataFrame(rows, RECORD)


def check(spark: SparkSession, p: RankProfile) -> DataFrame:
    """(name, candidate_id, expected, grade, ok) of each case."""
    x = features.with_features(records(spark), p).withColumn("honeypot_reasons", consistency.contradiction_reasons(p))
    want = spark.createDataFrame([(f"ANCHOR_{n:03d}", c[0], c[1], c[2]) for n, c in enumerate(CASES, 1)], "candidate_id string, name string, least int, most int")
    got = grading.graded(x, p).select("candidate_id", F.col("grade").cast("int").alias("grade")).join(F.broadcast(want), "candidate_id")
    expected = F.when(F.col("least") == F.col("most"), F.col("least").cast("string")).otherwise(F.concat_ws("-", "least", "most"))
    return got.select("name", "candidate_id", expected.alias("expected"), "grade", F.col("grade").between(F.col("least"), F.col("most")).alias("ok"))
