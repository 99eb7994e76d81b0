"""The plain functions under the operators."""

import json
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import ann, avi, eliasfano, jaccard, mixing, packing, quality, shingles, substr, warc


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, (1 << 64) - 1), max_size=300), st.integers(1, 64))
def test_elias_fano(values, bits):
    x = np.sort(np.array([v >> (64 - bits) for v in values], np.uint64))
    e, end = eliasfano.EliasFano.frombuffer(data := eliasfano.EliasFano.build(x, 1 << bits).tobytes(), 0)
    assert end == len(data)
    if len(x):
        assert (e.get(np.arange(len(x))) == x).all()
    q = np.concatenate([x, x ^ np.uint64(1)]) & np.uint64((1 << bits) - 1)
    at, hit = e.successor(q)
    assert (hit == np.isin(q, x)).all()
    assert (at[hit] == np.searchsorted(x, q)[hit]).all()


def test_trie_file(tmp_path):
    c = np.array([3, 9, 1 << 60], np.uint64)
    data = eliasfano.TrieLevel.build(c, np.array([0, 2, 3, 5]), np.array([1, 7, 2, 4, 5], np.uint64), np.array([11, 12, 13, 14, 15], np.uint16), np.array([21, 22, 23], np.uint16))
    (tmp_path / "level").write_bytes(data)
    t = eliasfano.TrieLevel.open(str(tmp_path / "level"))
    code, back = t.find(np.array([1 << 60, 3, 4], np.uint64), np.array([0, 0, 1, 1, 2]), np.array([5, 6, 7, 2, 1], np.uint64))
    assert code.tolist() == [15, 0, 12, 0, 0] and back.tolist() == [23, 21, 0]


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=2000))
def test_avi_round_trip(raw):
    payload = raw + b" " * (-len(raw) % avi.FRAME if raw else avi.FRAME)
    media = avi.encode_payload(payload)
    frames, fps = avi.parse_avi(media)
    assert fps == avi.FPS and avi.clips_of(media)[0].tobytes() == payload
    assert avi.decode_jpeg(frames[0])[::8, ::8].tobytes() == payload[: avi.FRAME]


def test_avi_without_index_and_shots():
    a, b = bytes([20]) * 192 * 10, bytes([200]) * 192 * 5
    media = avi.encode_payload(a + b)
    clips = avi.clips_of(media)[1]
    assert [(c[0], c[3], round(c[4])) for c in clips] == [(0, 10, 20), (1, 5, 200)] and clips[1][1] == 0.4
    cut = media[: media.index(b"idx1")]
    assert avi.parse_avi(cut)[0] == avi.parse_avi(media)[0]
    with pytest.raises(ValueError):
        avi.parse_avi(b"RIFFxxxxWAVE")


def test_jpeg_with_ac_terms():
    """A block with one AC coefficient, entropy-coded by hand under the file's own tables."""
    head = avi.FLAT_HEADER
    ac = avi._segment(0xC4, bytes([0x10]) + bytes([1, 1] + [0] * 14) + bytes([0, 0x01]))
    old = avi._segment(0xC4, bytes([0x10]) + bytes([1] + [0] * 15) + bytes([0]))
    head = head.replace(old, ac)
    bits = ["111111110" + "10" + "1" + "0"] + ["111111110" + "0"] * (avi.FRAME - 1)
    s = "".join(bits)
    s += "1" * (-len(s) % 8)
    raw = bytes(int(s[i : i + 8], 2) for i in range(0, len(s), 8)).replace(b"\xff", b"\xff\x00")
    px = avi.decode_jpeg(head + raw + b"\xff\xd9").astype(float)
    x = np.arange(8)
    want = 128 + 8 * np.cos((2 * x + 1) * np.pi / 16) / (8 * 2**0.5) * 2**0.5 * 2**0.5
    assert np.abs(px[0, :8] - want).max() <= 0.75 and (px[:, 8:] == 128).all()


def test_bundles():
    w = warc.BundleWriter(frame_bytes=4000)
    rng = random.Random(1)
    payload = {i: rng.randbytes(rng.randrange(1500)) for i in range(50)}
    for i, p in payload.items():
        w.add(i, warc.record(i, "http://x/", p, "d", None))
    w.add(7, warc.record(7, None, b"x" * 2000, "d", 3))
    data = w.finish()
    r = warc.BundleReader(data)
    assert len(r._frames) > 5
    for i, p in payload.items():
        f, got = warc.parse_record(r.get(i)[0])
        assert got == p and f["WARC-Type"] == "response"
    f, got = warc.parse_record(r.get(7)[1])
    assert (f["WARC-Type"], got, f["X-Payload-Length"]) == ("revisit", b"", "2000")
    import zstandard

    whole = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
    assert whole.count(b"WARC/1.1") == 51


@settings(max_examples=50, deadline=None)
@given(st.lists(st.floats(0.01, 100), min_size=1, max_size=12))
def test_pfair_deviation(weights):
    parts = mixing.parts_of(weights, 300)
    order = np.array(mixing.edf_period(parts))
    t = np.arange(1, len(order) + 1)
    for k, p in enumerate(parts):
        assert (np.abs(np.cumsum(order == k) - p / len(order) * t) < 1).all()


def test_phases_use_every_block_once():
    blocks, weights = [7, 100, 1, 33], [5.0, 1.0, 1.0, 0.0]
    slots = []
    for p in mixing.phases(blocks, weights, 50):
        for i in range(p["lo"], p["hi"]):
            n = i - p["lo"]
            slots.append(p["start"] + n // len(p["slots"]) * p["period"] + p["slots"][n % len(p["slots"])])
    assert sorted(slots) == list(range(sum(blocks)))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 100), st.integers(-1, 3), st.integers(-1, 5)), max_size=60))
def test_best_fit_equals_plain_search(items):
    items.sort(key=lambda x: -x[0])
    l, s, c = (np.array([x[k] for x in items], np.int64) for k in range(3))
    where, offset = packing.best_fit(l, s, c, 100)
    bins: list[list] = []  # room, sources, clusters
    for i, (n, src, clu) in enumerate(items):
        fit = [b for b, (room, ss, cc) in enumerate(bins) if room >= n and (src < 0 or src not in ss) and (clu < 0 or clu not in cc)]
        if fit:
            assert bins[where[i]][0] == min(bins[b][0] for b in fit)
        else:
            assert where[i] == len(bins)
            bins.append([100, set(), set()])
        b = bins[where[i]]
        assert offset[i] == 100 - b[0] and int(where[i]) in [*fit, len(bins) - 1]
        b[0] -= n
        b[1].add(src)
        b[2].add(clu)


def test_packing_with_a_hot_source_and_cluster_is_quick():
    n = 8000
    l = np.sort(np.random.default_rng(0).integers(1, 3000, n))[::-1]
    where, _ = packing.best_fit(l, np.arange(n) % 3, np.where(np.arange(n) % 3, 0, -1), 16384)
    assert len(set(where.tolist())) >= n - n // 3 - 1


@settings(max_examples=40, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB é\n\t1", max_size=40)), max_size=8))
def test_words_and_shingles(texts):
    starts, codes, distinct = shingles.words(pa.array(texts, pa.string()))
    want = [[w for w in (t or "").lower().encode().split()] for t in texts]
    assert [[distinct[c] for c in codes[a:b]] for a, b in zip(starts[:-1], starts[1:], strict=True)] == want
    s, g = shingles.shingles(pa.array(texts, pa.string()), 3)
    sets = [len({tuple(w[i : i + 3]) for i in range(len(w) - 2)}) if len(w) > 2 else int(bool(w)) for w in want]
    assert [len(set(g[a:b].tolist())) for a, b in zip(s[:-1], s[1:], strict=True)] == sets


@pytest.mark.parametrize("lower", [True, False])
def test_slices_hold_every_word(lower):
    rng = random.Random(9)
    texts = [None if rng.random() < 0.1 else " ".join(rng.choice(["Ab", "c", "É"]) for _ in range(rng.randrange(60))) for _ in range(500)]
    n = []
    for _, part in shingles.slices(pa.array(texts, pa.string()), 1000):
        n += np.diff(shingles.words(part, lower)[0]).tolist()
    assert n == [len((t or "").split()) for t in texts]


def test_links_of_a_large_block():
    rng = np.random.default_rng(2)
    base = np.unique(rng.integers(0, 1 << 60, 200).astype(np.uint64))
    sets = [np.unique(np.concatenate([rng.choice(base, 180, replace=False), rng.integers(0, 1 << 60, k % 40).astype(np.uint64)])) for k in range(60)]
    link = jaccard.links_in(sets, None, 0.8, columns=64)
    for i in range(60):
        for j in range(60):
            a, b = set(sets[i].tolist()), set(sets[j].tolist())
            assert link[i, j] == (i != j and len(a & b) / len(a | b) >= 0.8)


def test_bands_are_tuned():
    for rows in (2, 5, 9):
        n = shingles.tune(0.8, 0.995, rows)
        assert 1 - (1 - 0.8**rows) ** n >= 0.995 > 1 - (1 - 0.8**rows) ** (n - 1)


def test_paragraphs_don_t_depend_on_their_surroundings():
    rng = random.Random(5)
    w = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    found = 0
    for _ in range(60):
        shared = w(52)
        texts = [" ".join(w(30) + shared + w(30)), " ".join(w(77) + shared + w(11))]
        doc, _, content, _, _ = substr.paragraphs(pa.array(texts))
        found += bool(set(content[doc == 0].tolist()) & set(content[doc == 1].tolist()))
    assert found >= 58


def test_cutting_runs():
    assert substr.without("a b  c\nd e f", [(1, 3), (5, 9)]) == "a \nd e"
    assert substr.without("a b", [(0, 2)]) == ""


def test_reach_crosses_edits_that_leave_the_passage_similar():
    a = np.arange(100, dtype=np.uint64)
    b = a.copy()
    b[10] = 1000
    assert substr.reach(a, b) == (100, 100)
    assert substr.reach(a, np.delete(a, 10)) == (100, 99)
    assert substr.reach(a[:40], np.concatenate([a[:10], a[:1], a[10:40]])) == (40, 41)
    assert substr.reach(a[:14], b[:14]) == (10, 10)  # too few words follow
    b[[16, 22, 28, 34]] = 1001
    assert substr.reach(a[:40], b[:40]) == (10, 10)  # too many edits
    assert substr.reach(a, a[:0]) == (0, 0) and substr.reach(a[:5], a[5:]) == (0, 0)


def test_forest_finds_neighbours():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((2000, 16))
    forest = [ann.Tree(x, 32, rng) for _ in range(8)]
    leaves = [t.drop(x) for t in forest]
    hits = 0
    for q in range(50):
        probe = set(ann.search_leaves(forest, x[q], int(0.12 * sum(t.leaves for t in forest))))
        near = np.argsort(((x - x[q]) ** 2).sum(1))[1:11]
        hits += sum(any((t, int(leaves[t][i])) in probe for t in range(8)) for i in near)
    assert hits >= 450


def test_positive_unlabelled_learning():
    rng = np.random.default_rng(4)
    pos = np.c_[rng.normal(2, 1, (600, 1)), np.ones(600)]
    neg = np.c_[rng.normal(-2, 1, (300, 1)), np.ones(300)]
    unl = np.r_[np.c_[rng.normal(2, 1, (700, 1)), np.ones(700)], neg]
    prior = quality.prior_of((pos @ [1, 0])[::2], unl @ [1, 0])
    assert 0.55 < prior < 0.85
    w = quality.nnpu(pos, unl, prior)
    assert ((pos @ w) > 0).mean() > 0.95 and ((neg @ w) > 0).mean() < 0.3


def test_plans_are_json():
    assert json.dumps(mixing.phases([3, 2], [1.0, 1.0], 10))


def test_slices_of_a_few_words():
    for n in range(8):
        t = pa.array([" ".join(f"w{i}" for i in range(n))], pa.string())
        starts, grams = shingles.shingles(t, 5)
        assert len(grams) == starts[-1] == (max(1, n - 4) if n else 0)
        assert all(len(x) == 0 for x in substr.paragraphs(t)[:4])


def test_zeros_of_words():
    rng = np.random.default_rng(6)
    words = np.concatenate([rng.integers(0, 1 << 64, 500, np.uint64), np.array([0, (1 << 64) - 2, (1 << 63) - 1, 0xFF00FF00FF00FF00], np.uint64)])
    for word in words:
        zeros = [i for i in range(64) if not int(word) >> i & 1]
        assert eliasfano._nth_zero_in(np.full(len(zeros), word), np.arange(len(zeros))).tolist() == zeros
