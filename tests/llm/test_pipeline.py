"""The stages one after another, on the smallest tables and on odd ones."""

import collections
import random

import corpus_pipeline as cp
from sparkloom.llm import mixing, packing, quality, scratch


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in cp.STAGES:
        docs = scratch.written(stage(spark, docs, sf_dir), name)
        counts.append(docs.count())
        if name != cp.STAGES[-1][0]:
            assert docs.columns == columns
    assert counts[0] > counts[1] > counts[2] >= counts[3] == counts[4] <= counts[5]
    assert cp.run(spark, sf_dir).count() == counts[-1]


def test_odd_tables(spark, sf_dir, odd, none):
    for d in (odd, none):
        docs = d
        for name, stage in cp.STAGES:
            docs = scratch.written(stage(spark, docs, sf_dir), name)
            if name != cp.STAGES[-1][0]:
                assert docs.columns == d.columns


def test_stages_against_brute_force(spark, sf_dir):
    """Every stage on its own input, row by row: 200 documents."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = lambda d: [(r["doc_id"], r["text"]) for r in d.select("doc_id", "text").collect()]
    docs = scratch.written(spark.read.parquet(f"{sf_dir}/documents.parquet"), "given")
    stages = dict(cp.STAGES)

    model = quality.train(docs, labels)
    kept = scratch.written(stages["quality"](spark, docs, sf_dir), "kept")
    assert sorted(rows(kept)) == sorted(r for r in rows(docs) if quality.scores_of([r[1]], model)[0] >= 0.3)

    words = {r: r[1].lower().split() for r in sorted(rows(kept))}
    sets = {r: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for r, w in words.items()}
    root = {r: r for r in sets}

    def find(r):
        while root[r] != r:
            r = root[r]
        return r

    for a in sets:
        for b in sets:
            if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    alone = scratch.written(stages["near_duplicates"](spark, kept, sf_dir), "alone")
    assert sorted(rows(alone)) == sorted({find(r) for r in sets})

    cut = scratch.written(stages["repeated_passages"](spark, alone, sf_dir), "cut")
    before, after = dict(rows(alone)), dict(rows(cut))
    grams = lambda t: {tuple(w[k : k + 5]) for w in [t.lower().split()] for k in range(len(w) - 4)}
    holders = collections.Counter(g for t in before.values() for g in grams(t))
    for i, t in before.items():
        now = iter(t.split())
        assert all(w in now for w in after.get(i, "").split())  # words only go, none is added or moved
        gone = grams(t) - grams(after.get(i, ""))
        assert not gone or sum(holders[g] > 1 for g in gone) >= 0.5 * len(gone)  # the rest lies across a cut or an edit
    for i, w in ((i, t.lower().split()) for i, t in after.items()):
        for k in range(len(w) - 50):  # of 51 equal words at most one text keeps them
            passage = " ".join(w[k : k + 51])
            if holders[tuple(w[k : k + 5])] > 1 and holders[tuple(w[k + 46 : k + 51])] > 1:
                assert sum(passage in " ".join(t.lower().split()) for t in after.values()) == 1, i

    mixed = scratch.written(stages["mixing"](spark, cut, sf_dir), "mixed")
    assert sorted(map(str, mixed.collect())) == sorted(map(str, cut.collect()))
    pieces = collections.defaultdict(list)
    for r in stages["packing"](spark, mixed, sf_dir).collect():
        pieces[r["doc_id"]].append((r["start"], r["length"]))
    for i, t in rows(mixed):
        p = sorted(pieces[i])
        assert p[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(p, p[1:], strict=False)) and sum(n for _, n in p) == len(t or "")


def test_bins_follow_the_mix(spark):
    """Packing keeps to the order that mixing gives: by ranges of the mix, and in a range by the bins' first items."""
    rng = random.Random(11)
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 60))), rng.choice("aaaaaab")) for i in range(600)]
    docs = spark.createDataFrame([*rows, (600, "x" * 40_000, "b"), (601, None, "a")], "doc_id long, text string, source string")
    given = mixing.mixed(docs).collect()
    order = [r["doc_id"] for r in given]
    at = {i: k for k, i in enumerate(order)}
    other = scratch.written(docs, "other")  # the same rows in another order
    tables = [scratch.written(spark.createDataFrame(spark.sparkContext.parallelize(given, 5), docs.schema), "mixed"), other]
    for table in (tables[0], scratch.written(mixing.mixed(docs), "mixed"), mixing.mixed(docs)):
        assert {r["doc_id"]: r["at"] for r in scratch.placed(table, "at").collect()} == at
    pieces = [dict(cp.STAGES)["packing"](spark, t, "").collect() for t in tables]
    first = collections.defaultdict(lambda: len(order))
    for r in pieces[0]:
        first[r["bin_id"]] = min(first[r["bin_id"]], at[r["doc_id"]])
    assert [first[b] for b in sorted(first)] == sorted(first.values())
    assert sorted(pieces[0]) != sorted(pieces[1])
    shards = collections.defaultdict(set)
    for r in packing.pack(scratch.placed(tables[0], "at"), shard_items=64, order="at").collect():
        shards[r["bin_id"] >> 32].add(r["doc_id"])
    assert len(shards) == 10
    done: set[int] = set()
    for s in sorted(shards):  # the bins up to a shard hold a beginning of the mix
        done |= shards[s]
        assert done == set(order[: len(done)]) and len(shards[s]) in (60, 61)
