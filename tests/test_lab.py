"""Vectors, rerankers, anchors, the sweep's cache, the learned combiner and the demo, end to end on small records."""

import csv
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.functions.lexicons import WEIGHTS
from sparkloom.functions.profile import Aspect, RankProfile
from sparkloom.operators import anchors, grading, ltr, retrieval, sweep
from sparkloom.plans import artifacts, demo, evaluate, lab, rank
from sparkloom.sources import records

from .test_engine import person, write

PROFILE = RankProfile(role="Engineer", aspects={"a": Aspect(0.6, "semantic search ranking"), "b": Aspect(0.4, "recommendation")}, firms=("tcs", "infosys", "wipro"))


def encoder(texts):
    out = np.zeros((len(texts), 16))
    for i, t in enumerate(texts):
        for w in t.lower().split():
            out[i, sum(w.encode()) % 16] += 1
    return out


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    titles = ["ML Engineer", "Backend Engineer", "Data Scientist", "HR Manager"]
    texts = ["Built and deployed semantic search and ranking for recommendation.", "Built a recommender in production.", "wrote reports", "hiring"]
    rows = [person(n, title=titles[n % 4], yoe=3.0 + n % 8, desc=texts[(n // 2) % 4], company="Infosys" if n % 9 == 0 else "Acme", months=20 + n % 30, skills=("NLP", "LLM", "PyTorch", "Bert") if n % 4 == 3 else ("NLP",)) for n in range(1, 61)]
    return records.read_records(spark, write(tmp_path_factory.mktemp("lab") / "r.jsonl", rows)).cache()


@pytest.fixture(scope="module")
def scored(spark, raw):
    x = raw.select("candidate_id", F.rand(3).alias("semantic_sim"), F.lit(0.1).alias("rrf_score"))
    return rank.score(raw, x, PROFILE).cache()


@pytest.fixture(scope="module")
def grades(scored):
    return grading.graded(scored, PROFILE).select("candidate_id", F.col("grade").cast("double").alias("grade")).cache()


def test_anchors_get_their_grades(spark):
    got = anchors.check(spark, PROFILE).collect()
    assert len(got) == 12 and [r["name"] for r in got if not r["ok"]] == []


def test_vectors_are_built_once_and_checked(spark, raw, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def counted(texts):
        calls.add(len(texts))
        return encoder(texts)

    path = f"file://{tmp_path}/v"
    v = artifacts.build_vectors(raw, counted, path, shard_rows=10, shards_a_job=2)
    assert v.count() == 60 and calls.value == 60
    artifacts.check(raw, v, 16)
    lost = next((tmp_path / "v" / "vectors").glob("from=2/_SUCCESS"))
    lost.unlink()
    with pytest.raises(artifacts.ArtifactError, match="lacks the shards from 2"):
        artifacts.load_vectors(spark, path)
    v = artifacts.build_vectors(raw, counted, path, shard_rows=10, shards_a_job=2)
    assert 60 < calls.value < 110  # only the lost group again
    with pytest.raises(artifacts.ArtifactError, match="of another size"):
        artifacts.build_vectors(raw, encoder, path, shard_rows=20, shards_a_job=2)
    for bad, message in ((v.where("candidate_id > 'CAND_0000003'"), "without a vector"), (v.union(v), "twice"), (v.withColumn("embedding", F.slice("embedding", 1, 3)), "instead of 16")):
        with pytest.raises(artifacts.ArtifactError, match=message):
            artifacts.check(raw, bad, 16)
    with pytest.raises(artifacts.ArtifactError, match="without a record"):
        artifacts.check(raw.limit(5), v, 16)
    with pytest.raises(artifacts.ArtifactError, match="no manifest"):
        artifacts.load_vectors(spark, f"{path}-none")


def test_models_are_not_fetched(tmp_path):
    with pytest.raises(FileNotFoundError):
        artifacts.load_model(str(tmp_path), str)
    (tmp_path / "config.json").write_text("{}")
    assert artifacts.load_model(str(tmp_path), str.upper) == str(tmp_path).upper()


def test_reranker_scores_the_head(spark, raw):
    found = raw.select("candidate_id", F.lit(0.5).alias("semantic_sim"), F.col("profile.years_of_experience").alias("rrf_score"))
    sizes = spark.sparkContext.accumulator(0)

    def reranker(pairs):
        assert len(pairs) <= retrieval.PAIRS_A_BATCH and all(q == PROFILE.whole_text() for q, _ in pairs)
        sizes.add(len(pairs))
        return [len(t) / 100 for _, t in pairs]

    logits = rank.rerank_logits(raw, found, PROFILE, reranker, head=7)
    got = rank.score(raw, found, PROFILE, logits, head=7).select("candidate_id", "ce_score", "rrf_score").collect()
    assert sum(r["ce_score"] is not None for r in got) == 7 and len(got) == 60
    assert rank.rerank_logits(raw, found, PROFILE, None) is None
    assert [n for n, _ in artifacts.rerank_seconds(lambda pairs: pairs, [("q", "t")], (3, 5))] == [3, 5]


def test_strong_records_are_nearer_than_stuffers(spark, scored, raw):
    v = scored.select("candidate_id", F.when(F.col("title_class") == "strong", F.array(F.lit(1.0), F.lit(0.1))).otherwise(F.array(F.lit(0.1), F.lit(1.0))).alias("embedding"))
    x = scored.withColumn("n_skills", F.col("n_skills"))
    got = {r["kind"]: r for r in artifacts.sanity(x, v, [1.0, 0.0]).collect()}
    if got:
        assert got["strong"]["ok"] and got["strong"]["cosine"] > got["stuffer"]["cosine"]
    assert artifacts.sanity(x.where("title_class = 'strong'"), v, [1.0, 0.0]).count() == 0


def test_cache_and_sweep(spark, scored, grades, tmp_path):
    cache = lab.build_cache(scored, f"file://{tmp_path}/cache", str(tmp_path / "ranking.csv"), grades)
    with open(tmp_path / "ranking.csv", newline="") as f:
        rows = list(csv.DictReader(f))
    assert [int(r["rank"]) for r in rows] == list(range(1, 61))
    assert [r["candidate_id"] for r in rows] == [r[0] for r in evaluate.rank_silver(cache, cache).orderBy("rank").select("candidate_id").collect()]
    with pytest.raises(lab.UnfaithfulCache):
        lab.build_cache(scored.withColumn("final_score", -F.col("final_score")), f"file://{tmp_path}/bad")
    grid = sweep.weight_grid(spark, [0.0, 0.2], [0.23], [0.1, 0.2])
    out = lab.run_sweep(cache, grades, PROFILE, grid)
    assert out["chosen"] in {r["config"] for r in out["best"]} and out["anchors_missed"] == []
    assert set(out["baseline"]) == {"train", "val"} and set(out["flagged"]) == {"default", out["chosen"]}
    # the baseline by hand: rank the val rows and those without a grade by final score
    parts = {r["candidate_id"]: r for r in __import__("sparkloom.operators.sampling", fromlist=["x"]).split(grades, "candidate_id").collect()}
    order = [r["candidate_id"] for r in rows if parts[r["candidate_id"]]["part"] == "val"]
    rel = [parts[c]["grade"] for c in order]
    gain = lambda r: sum((2**g - 1) / math.log2(k + 2) for k, g in enumerate(r[:10]))
    ideal = gain(sorted(rel, reverse=True))
    assert out["baseline"]["val"]["ndcg10"] == pytest.approx(gain(rel) / ideal if ideal else 0.0)
    text = lab.result_text(lab.save_result(out, str(tmp_path / "out" / "sweep.json")))
    assert "baseline.val.composite" in text and json.loads((tmp_path / "out" / "sweep.json").read_text())["chosen"] == out["chosen"]


def test_learned_combiner_end_to_end(spark, scored, grades, tmp_path):
    cache = lab.cached(scored)
    out = lab.run_learned(cache, grades, str(tmp_path / "ltr"), rounds=3)
    assert out["adopt"] == (out["val_gain"] > 0) and json.loads((tmp_path / "ltr" / "result.json").read_text())["rounds"] == 3
    assert out["val_gain"] == pytest.approx(out["model"]["val"]["composite"] - out["baseline"]["val"]["composite"])
    parts = __import__("sparkloom.operators.sampling", fromlist=["x"]).split(grades, "candidate_id")
    some = ltr.training_set(cache, parts, grades.limit(2)).collect()
    assert {r["candidate_id"] for r in some}.isdisjoint({r[0] for r in parts.where("part = 'val'").select("candidate_id").collect()})

    class Model:
        def predict(self, x):
            return np.nan_to_num(x[:, 0])

    assert ltr.register("m", Model) and ltr.available("m")
    got = cache.select(F.col("role_substance").alias("r"), ltr.predicted("m").alias("p"), *WEIGHTS).collect()
    assert all(r["p"] == pytest.approx(1 / (1 + math.exp(-r["r"]))) for r in got)
    assert not ltr.register("m", lambda: 1 / 0) and not ltr.available("m")


def test_silver_and_evaluation(spark, raw, scored, grades, tmp_path):
    labels = evaluate.silver_labels(raw, PROFILE, targets={"strong_ml": 5, "suspected_stuffer": 5}, total=20)
    assert labels.count() == 20
    lab.write_silver(labels, raw.select("candidate_id", F.lit("p").alias("prompt")), PROFILE, f"file://{tmp_path}/silver")
    assert spark.read.json(f"file://{tmp_path}/silver/prompts").count() == 20 == spark.read.text(f"file://{tmp_path}/silver/sample_ids").count()
    assert spark.read.json(f"file://{tmp_path}/silver/anchors").where("ok").count() == 12
    few = grades.orderBy("candidate_id").limit(20)
    silver = evaluate.evaluate_silver(few, scored)
    wide = evaluate.evaluate_realistic(few, scored.select("candidate_id"), scored)
    a, b = silver.first(), wide.first()
    assert 0 <= b["composite"] <= 1 and a["ndcg10"] >= 0 and "composite" in evaluate.report(wide)


def test_demo(spark, scored, tmp_path):
    v = scored.select("candidate_id", F.array(F.lit(1.0)).cast("array<float>").alias("embedding"))
    sample = demo.write_sample(scored, v, f"file://{tmp_path}/demo", {"genuine": 5, "hidden_gem": 5, "stuffer": 3, "honeypot": 3}, 30)
    assert sample.count() == 30 == spark.read.parquet(f"file://{tmp_path}/demo/vectors").count()
    shown = demo.view(scored.withColumn("profile", F.col("profile").withField("current_title", F.lit("<b>"))), 15)
    assert len(shown["cards"]) == 15 and shown["cards"][0]["percent"] == 100.0
    assert all(r["corroboration"] <= 0.5 for r in shown["unproven"])
    assert "<b>" not in demo.page(shown, PROFILE) and "&lt;b&gt;" in demo.page(shown, PROFILE)
