"""Operators on small tables: brute force, contracts, and odd rows."""

import collections
import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
import zstandard as zstd
from pyspark.sql import functions as F

from sparkloom.llm.eliasfano import TrieLevel, mapped
from sparkloom.llm import ann, avi, components, jaccard, lm, mixing, packing, quality, scratch, substr, toxic, warc

from .conftest import SCHEMA, prose, row


def crc(i, n):
    return zlib.crc32(str(i).encode()) % n


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(11)
    base = [prose(rng, rng.randrange(60, 300)) for _ in range(60)]
    rows = [row(i, t, f"s{i % 5 if i % 3 else 0}") for i, t in enumerate(base)]
    for i in range(20):
        rows.append(row(100 + i, base[i % 5]))  # copies
        w = base[10 + i % 4].split()
        w[rng.randrange(len(w))] = f"changed{i}"
        rows.append(row(200 + i, " ".join(w)))  # near copies
    passage = prose(rng, 55, 10**6)
    for i in range(8):
        rows.append(row(300 + i, prose(rng, 80, 10**6) + " " + passage + " " + prose(rng, 40 + i, 10**6)))
    return spark.createDataFrame(rows, SCHEMA).cache()


# ---------------------------------------------------------------- 1


@pytest.mark.parametrize("order", [2, 3])
def test_scores_equal_plain_counting(docs, order):
    rows = docs.select("doc_id", "text").collect()
    tok = {r[0]: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or "")) + ["</s>"] for r in rows}
    counts = collections.defaultdict(collections.Counter)
    for i, w in tok.items():
        if crc(i, 7) != 2:
            x = ["<s>", *w]
            for j in range(1, len(x)):
                for k in range(1, order + 1):
                    if j - k + 1 >= 0:
                        counts[tuple(x[j - k + 1 : j])][x[j]] += 1
    n, v = sum(counts[()].values()), len(counts[()])
    few = lm.score(docs, order=order, shard_tokens=2000)
    got = {r["doc_id"]: r for r in few.collect()}
    assert got.keys() == tok.keys()
    if order == 3:  # through several passes of messages, in small units
        assert few.exceptAll(lm.score(docs, order=order, shard_tokens=2000, fan=3, unit=20_000)).count() == 0
        known = {1: set(), 3: set()}
        for r in lm.levels(docs, order=3, shard_tokens=2000).where("order <> 2").collect():
            known[r["order"]].add(r["lane"])
            level = TrieLevel(mapped(bytes(r["level"])))
            assert len(level.values) == level.successors.n and (np.diff(level.contexts.all().astype(float)) >= 0).all()
        assert known[1] and known[3]
    for i, w in tok.items():
        x, base, score = ["<s>", *w], 0.0, 0.0
        for j in range(1, len(x)):
            c = counts[()][x[j]]
            base += math.log10((c + 1) / (n + v + 1))
            p = (c + v / (v + 1)) / (n + v)
            for k in range(2, order + 1):
                h = counts.get(tuple(x[j - k + 1 : j])) if j - k + 1 >= 0 else None
                if h:
                    p = (h[x[j]] + len(h) * p) / (h.total() + len(h))
            score += math.log10(p)
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (crc(i, 7) == 2, len(w), sum(counts[()][t] > 0 for t in w), n)
        assert r["base_score"] == pytest.approx(base) and r["score"] == pytest.approx(score, abs=1e-3 * len(w))


def test_lm_odd(odd, none, odd_rows):
    got = lm.score(odd).collect()
    assert len(got) == len(odd_rows) and all(math.isfinite(r["score"]) for r in got)
    assert [r["n_tokens"] for r in got if r["doc_id"] == 0] == [1]
    assert lm.score(none).count() == 0


def test_lm_moves_messages_alone(spark, docs):
    """Blocks and replies lie by block, so that scoring shuffles neither again; what is done with is deleted."""
    from pathlib import Path

    got = lm.score(docs, shard_tokens=2000, fan=3, unit=20_000)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroups" in plan and "Exchange" not in plan
    at = Path(scratch.folder(spark).removeprefix("file://"), f"sparkloom-{spark.sparkContext.applicationId}")
    assert not [p for x in ("lm-messages", "lm-replies") for p in at.glob(f"{x}-*")]
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("sparkloom_")]
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(r["doc_id"] for r in docs.select("doc_id").collect())


def test_dealt_rows(spark, none):
    parts = [spark.range(k, 1000, 3, 4).selectExpr("cast(id % 10 as string) as k", "id as v") for k in range(3)]
    table = scratch.dealt(iter(parts), "dealt", "k")
    assert sorted(r["v"] for r in table.collect()) == list(range(1000))
    assert "Exchange" not in table.groupBy("k").count()._jdf.queryExecution().executedPlan().toString()
    assert scratch.dealt([none], "dealt", "doc_id").count() == 0


# ---------------------------------------------------------------- 2


def test_warc_contract(spark):
    html = ["x" * 999, "y" * 1000, "ü" * 600, None, ""]
    pages = spark.createDataFrame([(i, None if i % 7 == 0 else f"http://a/{i}", html[i % 5], 1) for i in range(40)] + [(36, "again", "y" * 1000, 1), (None, None, "ü" * 600, 1)], "page_id long, url string, html string, bundle int")
    got = warc.read_back(warc.bundles(pages, frame_bytes=2000, bundle_bytes=9000)).collect()
    assert len(got) == 42
    for r in got:
        if r["page_id"] is None:
            assert (r["record_type"], r["refers_to"]) == ("revisit", 37)
            continue
        raw = (html[r["page_id"] % 5] or "").encode()
        assert r["payload_bytes"] == len(raw) and r["payload_digest"] == hashlib.sha1(raw).hexdigest()
        last = {1: 36, 2: 37}.get(r["page_id"] % 5)
        want = ("response", None) if last is None or r["page_id"] == last else ("revisit", last)
        assert (r["record_type"], r["refers_to"]) == want
    assert warc.read_back(warc.bundles(pages.limit(0))).count() == 0


# ---------------------------------------------------------------- 3, 9


def test_classifiers_odd(odd, none, odd_labels, no_labels, odd_rows):
    for f, threshold in ((toxic.classify, 0.7), (quality.classify, 0.3)):
        for d, labels in ((odd, odd_labels), (odd, no_labels), (none, odd_labels)):
            got = f(d, labels).collect()
            assert len(got) == (0 if d is none else len(odd_rows))
            assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= threshold) for r in got)
    assert quality.score(odd, None, 0.3, keep_columns=True).columns == odd.columns


@pytest.mark.parametrize(("f", "label", "parts", "held"), [(toxic.classify, "toxic", 3, 1), (quality.classify, "quality", 5, 0)])
def test_classifiers_hold_out(spark, f, label, parts, held):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 6000")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = f(docs, labels)
    rows = got.join(labels, "doc_id").where("held_out").select(label, "predicted").collect()
    assert all(r["held_out"] == (crc(r["doc_id"], parts) == held) for r in got.limit(50).collect())
    right = sum(r[0] == r[1] for r in rows) / len(rows)
    assert right > (0.92 if label == "toxic" else 0.97)
    blind = f(docs, labels.withColumn(label, F.when(F.crc32(F.col("doc_id").cast("string")) % parts == held, 1 - F.col(label)).otherwise(F.col(label))))
    assert blind.exceptAll(got).count() == 0  # held-out labels change nothing


def test_toxic_words_are_nearer_to_the_toxic_dictionary(spark):
    rng = random.Random(8)
    common = [f"{a}{b}{c}" for a in ("ther", "ing", "ond") for b in ("ea", "ou", "st") for c in ("", "on", "ly")]
    text = lambda bad: " ".join(rng.choice(["vilegunk", "zorpface"]) if bad and rng.random() < 0.1 else rng.choice(common) for _ in range(80))
    rows = [(i, text(i < 300)) for i in range(600)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 300)) for i, _ in rows], "doc_id long, toxic int")
    m = toxic.train(d, labels)
    near = toxic.Distance(m.toxic, m.ordinary)
    assert near(b"therouly vilegunk") >= 4 > near(b"therouly ondst")
    assert sum(m.scores([text(True)], near)[0] >= 0.7 for _ in range(50)) >= 48 and not any(m.scores([text(False)], near)[0] >= 0.7 for _ in range(50))
    assert m.scores([None, ""], near)[0] == m.scores([None, ""], near)[1]

    # Brute force: every window of every text by a compressor of its own, counted one by one.
    def size(dictionary, window):
        p = zstd.ZstdCompressionParameters.from_level(12, source_size=128, dict_size=len(dictionary), min_match=4, strategy=zstd.STRATEGY_GREEDY, format=zstd.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0)
        c = zstd.ZstdCompressor(dict_data=zstd.ZstdCompressionDict(dictionary + toxic.LEAD, dict_type=zstd.DICT_TYPE_RAWCONTENT), compression_params=p)
        return len(c.compress(toxic.LEAD + b" " + window + b" " + toxic.LEAD))

    few = rows[::40] + [(1000, None), (1001, ""), (1002, "One")]
    got = {r["doc_id"]: r for r in toxic.score(spark.createDataFrame(few, "doc_id long, text string"), m, 0.7, 3, 1).collect()}
    for i, t in few:
        w = (t or "").lower().encode().split()
        dist = [size(m.ordinary, x) - size(m.toxic, x) for x in (b" ".join(w[k : k + 2]) for k in range(0, len(w), 2))]
        n = len(dist)
        x = [1.0, sum(sorted(dist)[-3:]) / 20, math.log1p(n), sum(dist) / n if n else 0.0]
        counts = [sum(v >= s for v in dist) for s in range(1, 8)]
        over = [(c - n * p) / math.sqrt(n * p + 0.5) for c, p in zip(counts, m.shares, strict=True)]
        x += [math.log1p(c) for c in counts] + [math.copysign(math.log1p(abs(v)), v) if v else 0.0 for v in over]
        want = 1 / (1 + math.exp(-sum(a * b for a, b in zip(x, m.weights, strict=True))))
        assert got[i]["score"] == pytest.approx(want, abs=1e-9) and got[i]["predicted"] == int(want >= 0.7) and got[i]["held_out"] == (crc(i, 3) == 1)


# ---------------------------------------------------------------- 4


def test_passages(docs):
    runs = substr.duplicate_runs(docs).collect()
    planted = [r for r in runs if 300 <= r["doc_id"] < 308]
    assert {r["doc_id"] for r in planted} == set(range(300, 308)) and {r["class_id"] for r in planted} == {300}
    assert {r["doc_id"] for r in planted if not r["removed"]} == {300}
    assert all(80 <= r["first_word"] and r["end_word"] <= 135 for r in planted)
    alone = set(range(20, 60))
    assert not alone & {r["doc_id"] for r in runs}
    out = substr.deduplicated(docs)
    assert out.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(texts[i] == before[i] for i in alone | {300}) and all(len(texts[i]) < len(before[i]) for i in range(301, 308))
    assert not texts.keys() & set(range(105, 120)) or all(len(texts.get(i, "")) < 400 for i in range(105, 120))


def test_runs_are_whole_passages(spark):
    rng = random.Random(23)
    sizes, rows = [51, 60, 80, 200], []
    for i, n in enumerate(sizes * 3):
        passage = prose(rng, n, 10**6)
        rows += [row(10 * i + c, f"{prose(rng, 30 + 7 * c, 10**6)} {passage} {prose(rng, 40, 10**6)}") for c in range(3)]
    runs = substr.duplicate_runs(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len({r["doc_id"] for r in runs}) >= 33
    for r in runs:
        c = r["doc_id"] % 10
        assert (r["first_word"], r["end_word"], r["removed"]) == (30 + 7 * c, 30 + 7 * c + sizes[r["doc_id"] // 10 % 4], c > 0)


def test_runs_cross_single_edits(spark):
    rng, rows = random.Random(29), []
    for i in range(40):
        passage = prose(rng, 60, 10**6).split()
        for c in range(2):
            if c:
                passage[30:31] = [["changed"], [passage[30], "added"], []][i % 3]
            rows.append(row(10 * i + c, f"{prose(rng, 30 + 7 * c, 10**6)} {' '.join(passage)} {prose(rng, 40, 10**6)}"))
    runs = substr.duplicate_runs(spark.createDataFrame(rows, SCHEMA)).where("removed").collect()
    found = {r["doc_id"] for r in runs}
    # A paragraph may pass with another outermost word; an edit may leave too few words to its end.
    whole = [r for r in runs if abs(r["first_word"] - 37) <= 1 and abs(r["end_word"] - 97 - [0, 1, -1][r["doc_id"] // 10 % 3]) <= 2]
    assert len(found) >= 34 and len(whole) == len(runs) == len(found), (len(found), len(whole), len(runs))


def test_passages_odd(odd, none, odd_rows):
    assert {(r["doc_id"], r["class_id"]) for r in substr.duplicate_runs(odd).collect()} == {(5, 5), (50, 5)}
    got = substr.deduplicated(odd)
    assert got.columns == odd.columns and got.where("text is null").count() == 2
    assert substr.duplicate_runs(none).count() == 0 and substr.deduplicated(none).count() == 0


# ---------------------------------------------------------------- 5


def test_media(odd, none, odd_rows):
    for r in avi.media_digest(odd).collect():
        assert r["payload_bytes"] % 192 == 0 and r["payload_bytes"] >= max(192, r["n_bytes"]) and r["n_bytes"] + 192 > r["payload_bytes"] - 192
    texts = {r[0]: r[1] for r in odd_rows if r[0] in (3, 6)}
    for r in avi.media_digest(odd).where("doc_id in (3, 6)").collect():
        raw = texts[r["doc_id"]].encode()
        raw += b" " * (-len(raw) % 192)
        assert (r["payload_sha256"], r["tail_crc32"]) == (hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-16:]))
    assert avi.media_digest(none).count() == 0
    clips = avi.clip_rows(avi.media_column(odd)).where("doc_id = 6").collect()
    assert clips and clips[0]["start_s"] == 0.0 and all(c["end_s"] > c["start_s"] for c in clips)


# ---------------------------------------------------------------- 6


def test_mixing(docs, odd, none, odd_rows):
    got = mixing.schedule(docs.select("doc_id", "source"), {"s0": 3, "s1": 1, "s2": 1}, block_docs=2, period=20).collect()
    blocks = {(r["source"], r["block"]): r["slot"] for r in got}
    assert sorted(blocks.values()) == list(range(len(blocks))) and len(got) == docs.count()
    assert all(r["place"] < 2 for r in got)
    order = [s for (s, _), _ in sorted(blocks.items(), key=lambda x: x[1])]
    weights = dict(zip(["s0", "s1", "s2"], [x / 20 for x in mixing.parts_of([3, 1, 1], 20)], strict=True))
    for t in range(1, 11):
        for s, w in weights.items():
            assert abs(order[:t].count(s) - w * t) < 1
    assert max(blocks[k] for k in blocks if k[0] in weights) < min(blocks[k] for k in blocks if k[0] not in weights)
    m = mixing.mixed(odd)
    assert m.columns == odd.columns and m.count() == len(odd_rows)
    assert mixing.mixed(none).count() == 0
    plan = mixing.schedule(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


@pytest.mark.parametrize("weights", [[10.0] + [1.0] * 7, [3.0, 1.0, 1.0], [1.0, 1e-4]])
def test_mixing_holds_the_given_weights(spark, weights):
    total, rows = sum(weights), 6000
    kind = F.element_at(F.array([F.lit(f"s{k}") for k, w in enumerate(weights) for _ in range(max(1, round(w)))]), F.pmod("id", F.lit(sum(max(1, round(w)) for w in weights))).cast("int") + 1)
    got = mixing.schedule(spark.range(rows).select(F.col("id").alias("doc_id"), kind.alias("source")), {f"s{k}": w for k, w in enumerate(weights)}, block_docs=1).collect()
    slots = [np.sort([r["slot"] for r in got if r["source"] == f"s{k}"]) for k in range(len(weights))]
    assert sorted(np.concatenate(slots)) == list(range(rows))
    t = np.arange(1, min(s[-1] for s in slots) + 2)  # until a source runs out
    for s, w in zip(slots, weights, strict=True):
        assert (np.abs(np.searchsorted(s, t) - w / total * t) < 1).all()


def test_schedule_equals_a_slot_by_slot_simulation():
    rng = random.Random(41)
    for _ in range(30):
        n = rng.randrange(1, 6)
        blocks, weights = [rng.randrange(1, 40) for _ in range(n)], [rng.choice([0.1, 0.3, 1.0, 2.5, 7.0]) for _ in range(n)]
        got = {}
        for p in mixing.phases(blocks, weights):
            got |= {p["start"] + p["slots"][i]: p["k"] for i in range(p["hi"] - p["lo"])}
        left, t, want = list(blocks), 0, {}
        while any(left):
            active = [k for k in range(n) if left[k]]
            w = {k: Fraction(weights[k]) / sum(Fraction(weights[j]) for j in active) for k in active}
            had, begin = dict.fromkeys(active, 0), t
            while all(left[k] for k in active):
                free = [k for k in active if math.floor(had[k] / w[k]) <= t - begin]
                k = min(free, key=lambda k: (math.ceil((had[k] + 1) / w[k]), k))
                want[t], left[k], had[k], t = k, left[k] - 1, had[k] + 1, t + 1
                assert all(abs(had[j] - w[j] * (t - begin)) < 1 for j in active)
        assert got == want


def test_number_of_blocks_is_bounded(docs):
    got = mixing.schedule(docs, block_docs=1, most_blocks=10)
    sources = docs.select("source").distinct().count()
    assert got.select("slot").distinct().count() <= 10 + sources and got.count() == docs.count()


# ---------------------------------------------------------------- 7


def test_neighbours_equal_brute_force_on_a_small_table(spark):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((300, 8)).astype(np.float32)
    v[10:40] = v[10]  # copies
    bad = [(1000, None), (1001, [0.0] * 8), (1002, [float("nan")] * 8), (1003, [1.0]), (1004, [None] * 8), (None, [1.0] * 8), (5, v[5].tolist())]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + bad, "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 10 == 0, share=1.0).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 300, 10))
    x = v.astype(float)
    for q, rows in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        want = [i for i in np.lexsort((np.arange(300), d)) if i != q][:10]
        rows.sort()
        assert [r[1] for r in rows] == want and [r[2] for r in rows] == [d[i] for i in want]
    assert ann.nearest(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    few = ann.nearest(df.where("vec_id < 3"), F.col("vec_id") == 0).collect()
    assert len(few) == 2


def test_recall(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = e.collect()
    x, ids = np.array([r["embedding"] for r in rows], float), np.array([r["vec_id"] for r in rows])
    got = collections.defaultdict(set)
    for r in ann.nearest(e, F.col("vec_id") % 100 == 0).collect():
        got[r["query_id"]].add(r["vec_id"])
    hits = 0
    for q, found in got.items():
        d = ((x - x[ids == q][0]) ** 2).sum(1)
        hits += len(found & set(ids[np.argsort(d)[1:11]].tolist()))
    assert hits / (10 * len(got)) >= 0.9


# ---------------------------------------------------------------- 8


def test_packing(docs, odd, none, odd_rows):
    for d in (docs, odd):
        rows = packing.pack(d, capacity=2000, shard_items=50).collect()
        texts = {r["doc_id"]: r["text"] for r in d.select("doc_id", "text").collect() if r["doc_id"] != 7}
        bins = collections.defaultdict(list)
        for r in rows:
            bins[r["bin_id"]].append(r)
        for b in bins.values():
            assert sum(r["length"] for r in b) <= 2000
            s = [r["source"] for r in b if r["source"] is not None]
            assert len(s) == len(set(s))
            c = [texts[r["doc_id"]] for r in b if r["start"] == 0 and texts.get(r["doc_id"])]
            assert len(c) == len(set(c))  # equal texts are a cluster
            at = sorted((r["bin_offset"], r["length"]) for r in b)
            assert all(x[0] + x[1] <= y[0] for x, y in zip(at, at[1:], strict=False))
        assert sum(r["length"] for r in rows) == d.agg(F.sum(F.length("text"))).first()[0]
        assert sum(r["start"] == 0 for r in rows) == d.count()
    assert packing.pack(none).count() == 0


# ---------------------------------------------------------------- 10


def test_join_equals_brute_force(docs):
    rows = {r["doc_id"]: r["text"].lower().split() for r in docs.collect()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in rows.items()}
    links, root = collections.Counter(), {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)))
                root[y] = x
    # 8, and few n-grams: groups are cut into pairs of blocks; 1: components go by their buckets.
    for how in ({}, {"block": 8}, {"block": 1}, {"block_grams": 400}):
        got = {r["doc_id"]: (r["class_id"], r["links"]) for r in jaccard.join(docs, **how).collect()}
        assert got == {i: (find(i), links[i]) for i in ids}


def test_pairs_are_verified_once_by_buckets():
    rng = np.random.default_rng(1)
    bands = rng.integers(0, 3, (40, 6))
    shared = [jaccard.first_shared(bands, 1 << k) for k in range(6)]
    assert (sum(s.astype(int) for s in shared) == (bands[:, None, :] == bands[None, :, :]).any(2)).all()


def test_one_row_of_each_class_stays(spark):
    rng = random.Random(31)
    a, c = prose(rng, 120, 10**6), prose(rng, 150, 10**6)
    near = c + " three more words"
    rows = [row(1, a), row(2, a), row(2, c), row(3, near), row(4, prose(rng, 80, 10**6)), row(4, prose(rng, 90, 10**6)), row(5, a, "other"), row(1, a), row(1, a, "b"), row(6, None), row(6, None), row(None, a), row(None, prose(rng, 70, 10**6))]
    got = [(r["doc_id"], r["text"]) for r in jaccard.kept_rows(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got, key=str) == sorted([(1, a), (2, c), rows[4][:2], rows[5][:2], (6, None), rows[-1][:2]], key=str)


def test_passages_go_row_by_row(spark):
    rng = random.Random(37)
    passage, c = prose(rng, 60, 10**6), prose(rng, 150, 10**6)
    rows = [row(1, f"{prose(rng, 40, 10**6)} {passage}"), row(2, f"{prose(rng, 50, 10**6)} {passage}"), row(2, c), row(2, c), row(None, f"{passage} {prose(rng, 30, 10**6)}")]
    got = collections.Counter((r["doc_id"], r["text"]) for r in substr.deduplicated(spark.createDataFrame(rows, SCHEMA)).collect())
    cut = [r[1].replace(passage, "").strip() for r in rows]
    assert got == {rows[0][:2]: 1, (2, cut[1]): 1, (2, c): 2, (None, cut[4]): 1}


def test_messages_through_several_passes_say_the_same(docs):
    one = substr.duplicate_runs(docs, shard_chars=2000)
    assert substr.duplicate_runs(docs, shard_chars=2000, fan=3).exceptAll(one).count() == 0 and one.count() > 0


def test_join_odd(odd, none):
    got = sorted((r["doc_id"], r["class_id"], r["links"]) for r in jaccard.join(odd).collect())
    assert (5, 5, 2) in got and (50, 5, 2) in got and (0, 0, 0) in got and (8, 8, 2) in got
    assert len(got) == odd.where("doc_id is not null").count()
    assert jaccard.join(none).count() == 0


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(500 + i, 501 + i) for i in range(60)] + [(3, 3)]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for i in root if find(i) != i}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
