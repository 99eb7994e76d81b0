"""Hand-computed values and small records."""

import json

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import scalars as S
from sparkloom.functions.profile import Aspect, RankProfile, load_profile
from sparkloom.operators import behaviour, grading, ltr, metrics, reasoning, retrieval, sampling, scoring, text
from sparkloom.plans.rank import prepared, retrieve, score, submission
from sparkloom.sources import grades, records

SIGNALS = {
    "profile_completeness_score": 0.9, "signup_date": "2024-01-01", "last_active_date": "2026-06-10", "open_to_work_flag": True, "profile_views_received_30d": 3,
    "applications_submitted_30d": 1, "recruiter_response_rate": 0.8, "avg_response_time_hours": 5.0, "skill_assessment_scores": {}, "connection_count": 10,
    "endorsements_received": 2, "notice_period_days": 15, "expected_salary_range_inr_lpa": {"min": 10.0, "max": 20.0}, "preferred_work_mode": "remote",
    "willing_to_relocate": True, "github_activity_score": 50.0, "search_appearance_30d": 4, "saved_by_recruiters_30d": 5, "interview_completion_rate": 0.9,
    "offer_acceptance_rate": -1.0, "verified_email": True, "verified_phone": True, "linkedin_connected": True,
}


def person(n, title="ML Engineer", yoe=7.0, desc="Built and deployed semantic search and ranking for recommendation.", company="Acme", country="India", city="Pune", months=40, skills=("NLP",), **signals):
    role = {"company": company, "title": title, "start_date": "2023-01-01", "end_date": None, "duration_months": months, "is_current": True, "industry": "x", "company_size": "y", "description": desc}
    return {
        "candidate_id": f"CAND_{n:07d}",
        "profile": {"anonymized_name": "A", "headline": "h", "summary": "s", "location": city, "country": country, "years_of_experience": yoe, "current_title": title, "current_company": company, "current_company_size": "1", "current_industry": "i"},
        "career_history": [role], "education": [], "skills": [{"name": s, "proficiency": "expert", "endorsements": 1, "duration_months": 5} for s in skills],
        records.SIGNALS_KEY: SIGNALS | signals,
    }


def write(path, rows):
    path.write_text("\n\n".join(json.dumps(r) for r in rows) + "\n")
    return str(path)


PROFILE = RankProfile(role="Engineer", aspects={"a": Aspect(0.6, "semantic search ranking"), "b": Aspect(0.4, "recommendation", ("deployed",))}, firms=("infosys",))


@pytest.fixture(scope="module")
def people(spark, tmp_path_factory):
    rows = [person(1), person(2, title="HR Manager", desc="hiring", skills=("NLP", "LLM", "PyTorch", "Bert")), person(3, yoe=1.0, months=60), person(4, company="Infosys Ltd"), person(5, country="US", city="x", willing_to_relocate=False), person(6, title="Backend Engineer")]
    return prepared(records.read_records(spark, write(tmp_path_factory.mktemp("r") / "r.jsonl", rows)), PROFILE).cache()


def value(spark, c):
    return spark.range(1).select(c).first()[0]


def test_scalars(spark):
    assert [value(spark, S.sigmoid(F.lit(x))) for x in (1000.0, -1000.0, 0.0)] == [1.0, 0.0, 0.5]
    assert value(spark, S.clamp01(F.lit(float("nan")))) == 0.0
    assert value(spark, S.ramp(F.lit(3.0), 5, 5)) == 0.0
    assert value(spark, S.iso_date(F.lit("2020-1-1"))) is None and value(spark, S.iso_date(F.lit("2020-02-30"))) is None
    assert value(spark, S.tokens(F.lit("Ab-c 9é"))) == ["ab", "c", "9"]
    ones = [(F.lit(1.0), w) for w in (0.2, 0.3)] + [(F.lit(None).cast("double"), 0.5)]
    assert value(spark, S.weighted_mean(ones)) == pytest.approx(1.0)
    assert value(spark, F.lit("recommendations").rlike(S.whole_words(["recommendation"]))) is False


def test_metrics(spark):
    rel = [3, 2, 3, 0, 1, 2]
    m = metrics.metrics(spark.createDataFrame([(i, float(r)) for i, r in enumerate(rel, 1)], "rank int, rel double")).first()
    assert m["ndcg10"] == pytest.approx(0.9488107485678985)
    ap = metrics.metrics(spark.createDataFrame([(i, float(r)) for i, r in enumerate([1, 0, 1, 1, 0, 1], 1)], "rank int, rel double")).first()
    assert ap["map"] == pytest.approx(0.7708333333)
    ap3 = metrics.metrics(spark.createDataFrame([(i, float(r)) for i, r in enumerate([3, 1, 4, 0, 3], 1)], "rank int, rel double"), threshold=3.0).first()
    assert ap3["map"] == pytest.approx(2.266667 / 3, abs=1e-6)
    t = metrics.kendall(spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (3.0, 4.0), (4.0, 3.0)], "a double, b double")).first()[0]
    assert t == pytest.approx(4 / 6)
    a = metrics.agreement(spark.createDataFrame([(4.0, 4.0), (3.0, 3.0), (2.0, 3.0), (1.0, 0.0), (0.0, 2.0)], "a double, b double")).first()
    assert (a["n"], a["exact"], a["within_one"]) == (5, 0.4, 0.8)
    assert metrics.agreement(spark.createDataFrame([], "a double, b double")).first()["rho"] is None


def test_rrf(spark):
    lists = [("A", x, i) for i, x in enumerate("xyz", 1)] + [("B", x, i) for i, x in enumerate("yxw", 1)]
    got = {r["id"]: r["rrf"] for r in retrieval.rrf(spark.createDataFrame(lists, "list string, id string, rank int")).collect()}
    assert got["x"] == got["y"] == pytest.approx(0.032522, abs=1e-6) and got["z"] == got["w"] == pytest.approx(0.015873, abs=1e-6)


def test_bm25_without_terms_is_empty(spark):
    assert retrieval.bm25(spark.createDataFrame([(1, "a")], "doc_id long, text string"), []).count() == 0


def test_reader(spark, tmp_path):
    bad = person(7)
    del bad["profile"]["headline"]
    with pytest.raises(Exception, match="profile.headline"):
        records.read_records(spark, write(tmp_path / "bad.jsonl", [bad])).collect()
    import gzip

    with gzip.open(tmp_path / "r.jsonl.gz", "wt") as f:
        f.write("\n" + json.dumps(person(1)) + "\n\n" + json.dumps(person(2)) + "\n")
    assert records.read_records(spark, str(tmp_path / "r.jsonl.gz")).count() == 2
    assert records.read_records(spark, str(tmp_path / "r.jsonl.gz"), limit=1).count() == 1
    (tmp_path / "a.json").write_text(json.dumps([person(1), person(2), person(3)]))
    assert records.read_any(spark, str(tmp_path / "a.json")).count() == 3
    with pytest.raises(Exception):  # noqa: B017
        p = tmp_path / "m.jsonl"
        p.write_text("{not json}\n")
        records.read_records(spark, str(p), strict=False).collect()


def test_features(people):
    r = {x["candidate_id"][-1]: x for x in people.collect()}
    assert (r["1"]["title_class"], r["2"]["title_class"], r["6"]["title_class"]) == ("strong", "nontech", "adjacent")
    assert r["1"]["role_substance"] == 1.0 and r["2"]["role_substance"] == 0.0
    assert r["2"]["skill_corroboration"] == 0.0 and r["1"]["location_fit"] == 1.0 and r["5"]["location_fit"] == 0.15
    assert r["4"]["product_vs_consulting"] == 0.0
    assert r["3"]["is_honeypot"] and r["3"]["honeypot_reasons"][0] == "role tenure 60mo exceeds total experience 12mo"


def test_behaviour(spark):
    s = F.struct(*[F.lit(v).alias(k) for k, v in SIGNALS.items() if not isinstance(v, dict)])
    assert value(spark, behaviour.multiplier(s, "2026-06-16")) == pytest.approx(1.15)
    low = SIGNALS | {"last_active_date": "2024-01-01", "recruiter_response_rate": 0.0, "interview_completion_rate": 0.0, "notice_period_days": 200, "open_to_work_flag": False, "saved_by_recruiters_30d": 0, "profile_completeness_score": 0.0, "verified_email": False, "verified_phone": False, "github_activity_score": 0.0}
    s = F.struct(*[F.lit(v).alias(k) for k, v in low.items() if not isinstance(v, dict)])
    assert value(spark, behaviour.multiplier(s, "2026-06-16")) == pytest.approx(0.5)


def test_grades(people):
    g = {r["candidate_id"][-1]: r["grade"] for r in grading.graded(people, PROFILE).collect()}
    assert g["1"] == 4 and g["2"] == 0 and g["3"] == 0 and g["4"] == 1 and g["5"] <= 3


def test_reconcile(spark):
    cases = {(3, None, False): 3, (3, 4, False): 4, (1, 4, False): None, (4, 4, True): 0, (2, 3, False): 3}
    for (a, b, f), want in cases.items():
        g, review = metrics.reconciled(F.lit(a), F.lit(b).cast("int"), F.lit(f))
        assert value(spark, g) == want and value(spark, review) == (want is None)


def test_whole_ranking(spark, people, tmp_path):
    v = people.select("candidate_id", F.array(F.lit(1.0), F.lit(0.1)).cast("array<float>").alias("embedding"))
    q = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "query string, q array<double>")
    base = people.select("candidate_id", "profile", "career_history", "skills", "signals")
    out = score(base, retrieve(base, v, q, PROFILE), PROFILE, logits=spark.createDataFrame([("CAND_0000001", 3.0)], "candidate_id string, logit double"))
    rows = submission(out, 5)
    path = str(tmp_path / "s.csv")
    scoring.write_submission(rows, path)
    assert scoring.validate_submission(path, 5) == []
    assert scoring.violations(rows, 5).count() == 0
    first = rows.orderBy("rank").first()
    assert first["candidate_id"] == "CAND_0000001" and first["reasoning"].startswith("ML Engineer, 7 yrs. Strong fit: ")
    with pytest.raises(scoring.SelectionError):
        scoring.select_top(out, 7)
    with pytest.raises(scoring.SelectionError):
        scoring.select_top(out.union(out), 3)
    with pytest.raises(scoring.SelectionError):
        scoring.select_top(out, 6)  # one of six is contradictory


def test_validator_faults(tmp_path):
    p = tmp_path / "s.csv"
    p.write_text("candidate_id,rank,score,reasoning\nCAND_0000002,1,0.5,x\nCAND_0000001,2,0.5,x\nCAND_0000001,3,nan,x\nbad,03,0.9,x\n")
    faults = "\n".join(scoring.validate_submission(str(p), 4))
    assert all(w in faults for w in ("not in order of id", "repeated id", "nan", "'bad'", "'03'"))
    assert scoring.validate_submission(str(tmp_path / "s.txt"))


def test_truncation(spark):
    s = value(spark, reasoning.truncated(F.lit("word, " * 80)))
    assert len(s) <= 320 and s.endswith("word…")


def test_texts(people):
    r = people.where("candidate_id = 'CAND_0000001'").select(text.rich_text().alias("t"), text.lexical_text().alias("l"), text.compact_text().alias("c")).first()
    assert r["t"].split("\n")[2] == "Current role: ML Engineer at Acme." and r["t"].endswith("Skills: NLP (expert)")
    assert "ML Engineer" not in r["l"] and r["c"].startswith("ML Engineer, 7.0 yrs")


def test_profile_file(tmp_path):
    p = tmp_path / "p.json"
    p.write_text(json.dumps({"role": "R", "experience_band": {"min": 4}, "aspects": {"z": {"weight": 0.4, "query_text": "B c", "keywords": ["d"]}, "a": {"weight": 0.6, "query_text": "A"}}, "consulting_firms": ["TCS"]}))
    x = load_profile(str(p))
    assert x.query_terms() == ["a", "b", "c", "d"] and x.whole_text() == "R  A  B c" and x.firms == ("tcs",)


def test_grade_files(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps([{"candidate_id": "a", "grade_final": 3}, {"candidate_id": "b", "grade_final": None}, {"candidate_id": "c", "grade_final": 1, "needs_review": True}]))
    assert [tuple(r) for r in grades.load_silver(spark, str(tmp_path / "s.json")).collect()] == [("a", 3.0)]
    (tmp_path / "m.jsonl").write_text('{"candidate_id": "a", "grade_llm": 2.6}\nnonsense\n{"candidate_id": "b", "grade_llm": 9}\n')
    assert [(r[0], r[1]) for r in grades.load_model_grades(spark, str(tmp_path / "m.jsonl")).collect()] == [("a", 3)]


def test_learned_combiner_falls_back():
    assert not ltr.register("none", lambda: 1 / 0)
    assert not ltr.available("none") and ltr.adopt(0.5, 0.4) and not ltr.adopt(0.4, 0.4)


def test_sample_depends_on_seed(spark):
    x = spark.range(1000).withColumnRenamed("id", "candidate_id")
    none = x.limit(0)
    a, b, c = ([r[0] for r in sampling.pool_sample(x, none, 20, seed=s).collect()] for s in (1, 1, 2))
    assert a == b != c


def test_stream(spark, tmp_path):
    from sparkloom.streaming.incremental import scored_stream, stream_records

    (tmp_path / "in").mkdir()
    write(tmp_path / "in" / "a.jsonl", [person(1), person(3, yoe=1.0, months=60)])
    q = scored_stream(stream_records(spark, str(tmp_path / "in")), PROFILE).writeStream.format("memory").queryName("scored").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {r["candidate_id"]: r["final_score"] for r in spark.table("scored").collect()}
    assert got["CAND_0000003"] == -1.0 and got["CAND_0000001"] > 0.5
