"""Every query of the engine against its SQL in DuckDB, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from sparkloom.plans.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def db(sf_dir):
    c = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    return c


def plain(v):
    return None if v is None else round(v, 6) + 0.0 if isinstance(v, float) else v


def key(row):
    return [(v is None, str(type(v)), v if v is not None else 0) for v in row]


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, db, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    r = db.sql(SQL[name])
    names = sorted(df.columns)
    assert names == sorted(r.columns)
    ours = sorted((tuple(plain(row[c]) for c in names) for row in df.collect()), key=key)
    at = [r.columns.index(c) for c in names]
    theirs = sorted((tuple(plain(row[i]) for i in at) for row in r.fetchall()), key=key)
    assert len(ours) == len(theirs)
    for a, b in zip(ours, theirs, strict=True):
        assert all(math.isclose(x, y, abs_tol=2e-6) if isinstance(x, float) and isinstance(y, float) else x == y for x, y in zip(a, b, strict=True)), (a, b)


def test_entry(spark):
    import __spark_entry__ as e

    rows = e.entry(spark).collect()
    assert [r["rank"] for r in rows] == list(range(1, 101))
    assert rows == e.entry(spark).collect()


def test_sweep_chooses_one(spark, sf_dir):
    assert sum(r["chosen"] for r in QUERIES["sweep_best"](spark, sf_dir).collect()) == 1


def test_sweep_covers_the_whole_table(spark, monkeypatch):
    from sparkloom.functions.lexicons import WEIGHTS
    from sparkloom.operators import sweep
    from sparkloom.plans import driver, queries

    sf, seen = "/root/testdata/sf0.01", {}
    run = sweep.run_sweep
    monkeypatch.setattr(sweep, "run_sweep", lambda cache, grades: seen.update(cache=cache, grades=grades) or run(cache, grades))
    QUERIES["sweep_best"](spark, sf)
    people = driver.table(spark, sf, "customer").count()
    assert people > 300
    assert seen["cache"].count() == seen["grades"].count() == people
    cache = queries._cache(spark, sf).collect()
    got = {}
    for r in QUERIES["sweep_rerank"](spark, sf).collect():
        got.setdefault(r["config"], []).append((r["rank"], r["candidate_id"]))
    for w in sweep.weight_grid(spark).collect():
        scores = []
        for r in cache:
            some = [f for f in WEIGHTS if r[f] is not None]
            low = sum(w[f"w_{f}"] for f in some)
            score = -1.0 if r["is_honeypot"] else (sum(r[f] * w[f"w_{f}"] for f in some) / low if low else 0.0) * r["behavioral_mult"]
            scores.append((-round(score, 9), r["candidate_id"]))
        best = dict((c, s) for s, c in scores)
        mine = [c for _, c in sorted(got[w["config"]])]
        assert [best[c] for c in mine] == [s for s, _ in sorted(scores)[:20]]
    assert QUERIES["faithfulness"](spark, sf).where("rank <> scorer_rank or rank is null or scorer_rank is null").count() == 0
