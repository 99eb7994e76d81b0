"""Substring deduplication by MinHash banding of paragraphs.

Shared passages seldom fill a line, so paragraphs are found by content: one begins at
each word whose pair with the next has the least hash within `reach` words on either
side, and runs for `span` words. A passage of over 50 words holds such beginnings at
the same words wherever it stands. Each paragraph's set of word 5-grams is signed by
MinHash; the number of bands is tuned for the target recall at the threshold, and
paragraphs are shuffled on band hashes in packed messages from slices of text to
shards (see `route`). Equal paragraphs of different documents are duplicates; unequal ones that
share a bucket are verified by exact Jaccard similarity of their sets. Components of
verified ties are classes; a class that stands in two documents or more is kept where
its least (doc_id, word) is, and removed elsewhere.

A slice sends each distinct paragraph once, so that a passage in a third of all texts
adds a row for each slice; buckets of many variants are verified in pairs of blocks.

Beginnings are a sample, so a run of paragraphs stops short of its passage. Each end of
a removed run is therefore compared word by word with the kept copy, and both copies'
runs grow by what is equal, across single changed, added or missing words as long as
the whole stays near a similarity of 0.8. What is compared with reaches to the kept text's next
beginnings on that side: a passage that goes on beyond them has paragraphs there.

Result: one row for each maximal run of duplicate words of a document: doc_id,
first_word, end_word (exclusive), removed, class_id (the doc_id that keeps the run's
first paragraph), text_hash. Documents without any have no row. Null and short texts (less
than `span` words) hold no paragraphs; a very long one is a slice of its own. Repetition
inside one document alone is left. Rows without an id are left out. A row is known by
its id and the hash of its text: rows that share an id but not the text are documents
of their own, and none is cut by what the other repeats; repeated rows are one document.
An empty table has no runs. Only doc_id and text are read; `deduplicated` keeps all
columns, whatever their names, and takes rows without an id to come after all others.
"""

from __future__ import annotations

import math
import pickle
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import jaccard, route, scratch, shingles
from .components import components
from .memory import trim
from .shingles import mixed

N, SPAN, REACH, ROWS = 5, 20, 5, 2
ROW = ["doc_id", "mark"]
#: Of two texts' 5-grams, an edit changes N on either side; at a similarity of 0.8 there are 45 grams for each edit.
AWAY, EDIT = 3, 45
BLOCK = 512
_MUL = np.uint64(0x9E3779B97F4A7C15)


def _grams(h: np.ndarray, n: int = N) -> np.ndarray:
    """Hash of the n-gram that begins at each word; the last n - 1 are cut short."""
    acc = np.zeros(len(h), np.uint64)
    for k in range(n):
        nxt = np.zeros(len(h), np.uint64)
        nxt[: max(0, len(h) - k)] = h[k:]
        acc = acc * _MUL + nxt
    return mixed(acc)


def paragraphs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text and word number of each paragraph, its content hash, its place in the slice, and the slice's 5-grams."""
    starts, codes, distinct = shingles.words(texts)
    h = shingles.hashes(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)
    count = np.diff(starts)
    at, left = np.arange(len(h)) - np.repeat(starts[:-1], count), np.repeat(starts[1:], count) - np.arange(len(h))
    pair = mixed(h * _MUL + np.append(h[1:], h[:1]))
    least = left >= SPAN
    for s in range(1, min(REACH, len(h) - 1) + 1):
        least[s:] &= (at[s:] < s) | (pair[s:] < pair[:-s])
        least[: len(h) - s] &= (left[: len(h) - s] <= s) | (pair[: len(h) - s] <= pair[s:])
    p = np.flatnonzero(least)
    g = _grams(h)
    content = np.zeros(len(p), np.uint64)
    for k in range(0, SPAN, N):
        content = mixed(content * _MUL + g[p + k])
    return np.repeat(np.arange(len(texts)), count)[p], at[p], content, p, g


def band_hashes(g: np.ndarray, p: np.ndarray, bands: int, seed: int = 9) -> np.ndarray:
    """(paragraphs, bands): least hashes over the SPAN - N + 1 grams of each paragraph, by doubling windows."""
    width = SPAN - N + 1
    x = (g >> np.uint64(32)).astype(np.uint32)
    cols = []
    for a, b in zip(*shingles.multipliers(bands * ROWS, seed), strict=True):
        v, w = (x ^ b) * a, 1
        while 2 * w <= width:
            v = np.minimum(v[: len(v) - w], v[w:])
            w *= 2
        cols.append(np.minimum(v[p], v[p + width - w]))
    return shingles.bands(np.stack(cols, axis=1) if len(p) else np.zeros((0, bands * ROWS), np.uint32), bands).view(np.uint64)


def _merged(parts: list[tuple]) -> tuple:
    """Entries (band, content, a document, whether there are more, number) in order, one for each band and content."""
    band, content, doc, many, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((content, band))
    band, content, doc, many, n = band[order], content[order], doc[order], many[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], (band[1:] != band[:-1]) | (content[1:] != content[:-1])]))
    low, high = np.minimum.reduceat(doc, first), np.maximum.reduceat(doc, first)
    return band[first], content[first], low, np.logical_or.reduceat(many, first) | (low != high), np.add.reduceat(n, first)


def _cut(entries: tuple, shards: int, width: int) -> list[tuple[int, bytes]]:
    shard = (mixed(entries[0]) % np.uint64(shards)).astype(np.int64)
    return [(k, pickle.dumps(tuple(x[e] for x in entries), 5)) for k, e in route.cut(shard, width)]


def _messages(docs: DataFrame, bands: int, shards: int, fan: int) -> DataFrame:
    wide = route.hops(shards, fan)[0]

    def run(batches):
        for b in batches:
            for at, texts in shingles.slices(b.column(2), 6 << 20):
                doc, _, content, p, g = paragraphs(texts)
                if not len(p):
                    continue
                ident, mark = (b.column(c).slice(at, len(texts)).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for c in (0, 1))
                ids = mixed(ident * _MUL + mark)[doc]
                order = np.argsort(content, kind="stable")
                first = jaccard_runs(content[order])
                low, high = np.minimum.reduceat(ids[order], first), np.maximum.reduceat(ids[order], first)
                pick = order[first]
                band = band_hashes(g, p[pick], bands).reshape(-1)
                many, ones = np.repeat(low != high, bands), np.ones(len(band), np.uint32)
                yield route.batch(_cut((band, np.repeat(content[pick], bands), np.repeat(low, bands), many, ones), shards, wide))

    sent = docs.mapInArrow(run, route.SCHEMA)
    return route.routed(sent, shards, lambda held, width: _cut(_merged([pickle.loads(m) for m in held]), shards, width), fan)


def jaccard_runs(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def _collide(p: pd.DataFrame) -> pd.DataFrame:
    """(content, bucket, size, slices): bucket null for content in several documents, else a bucket of several contents of several documents."""
    band, content, doc, many, n = _merged([pickle.loads(m) for m in p["message"]])
    head = jaccard_runs(band)
    size = np.diff(np.append(head, len(band)))
    mixed_docs = np.logical_or.reduceat(many, head) | (np.minimum.reduceat(doc, head) != np.maximum.reduceat(doc, head))
    near = np.repeat((size > 1) & mixed_docs, size)
    trim()
    a = pd.DataFrame({"content": content[many].view(np.int64), "bucket": None, "size": 1, "slices": n[many]}).drop_duplicates("content")
    b = pd.DataFrame({"content": content[near].view(np.int64), "bucket": band[near].view(np.int64), "size": np.repeat(size, size)[near], "slices": n[near]})
    return pd.concat([a, b], ignore_index=True).astype({"bucket": "Int64", "slices": "int64"})


def _places(docs: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            for at, texts in shingles.slices(b.column(2)):
                doc, word, content, _, _ = paragraphs(texts)
                ident, mark = (b.column(c).slice(at, len(texts)).to_numpy(zero_copy_only=False).astype(np.int64)[doc] for c in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(content.view(np.int64)), pa.array(ident), pa.array(mark), pa.array(word.astype(np.int32))], names=["content", "doc_id", "mark", "word"])

    return docs.mapInArrow(run, "content long, doc_id long, mark long, word int")


def _near_ties(texts: DataFrame, near: DataFrame, places: DataFrame, threshold: float) -> DataFrame:
    """Verified ties between unequal contents of a bucket."""
    at = places.groupBy("content").agg(F.min(F.struct("doc_id", "mark", "word")).alias("p")).join(near.select("content").distinct(), "content")
    by_doc = at.select("p.doc_id", "p.mark", "content").groupBy("doc_id", "mark").agg(F.collect_set("content").alias("contents"))

    def sets(frames):
        for f in frames:
            for k, t in shingles.slices(pa.array(f["text"], pa.string())):
                doc, _, content, p, g = paragraphs(t)
                rows = {}
                for i, c, x in zip(doc.tolist(), content.view(np.int64).tolist(), p.tolist(), strict=True):
                    if c not in rows and c in (want := wants[k + i] if k + i in wants else wants.setdefault(k + i, set(f["contents"].iat[k + i]))) and want:
                        rows[c] = np.unique(g[x : x + SPAN - N + 1]).tobytes()
                yield pd.DataFrame({"content": list(rows), "grams": list(rows.values())}).astype({"content": "int64"})
            wants.clear()

    wants: dict[int, set] = {}
    grams = texts.join(by_doc, ROW).mapInPandas(sets, "content long, grams binary").dropDuplicates(["content"])
    chunks = F.ceil(F.col("size") / BLOCK).cast("int")
    x = near.withColumn("chunks", chunks).withColumn("side", F.pmod("content", "chunks").cast("int"))
    x = x.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    x = x.join(grams, "content").select(F.col("bucket").alias("root"), F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"), "side", F.col("content").alias("node"), F.lit(1).cast("long").alias("copies"), "grams")
    found = x.repartition(F.xxhash64("root", "lo", "hi")).sortWithinPartitions("root", "lo", "hi").mapInPandas(jaccard._verify(threshold), "node long, links long, root long")
    return found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).distinct()


def _outward(h: np.ndarray, word: int, side: int) -> np.ndarray:
    """The words before a paragraph, last first, or after it."""
    return h[:word][::-1] if side < 0 else h[word + SPAN :]


def _equal(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    other = np.flatnonzero(a[:n] != b[:n])
    return int(other[0]) if len(other) else n


def reach(a: np.ndarray, b: np.ndarray, run: int = SPAN) -> tuple[int, int]:
    """How many words of each of two texts, read away from an equal run of so many words, go on being equal.

    A changed, added or missing word is crossed if N equal words follow and the whole, with
    what the sample of beginnings may leave out on the other side, has EDIT words for each.
    """
    i = j = _equal(a, b)
    edits = 0
    while i < len(a) or j < len(b):
        steps = [(_equal(a[i + x :], b[j + y :]), x, y) for x, y in ((1, 1), (1, 0), (0, 1))]
        more, x, y = max(steps, key=lambda s: s[0])
        edits += 1
        if more < N or run + i + x + more + 2 * REACH + 1 < EDIT * edits + N - 1:
            break
        i, j = i + x + more, j + y + more
    return i, j


def _text_words(f: pd.DataFrame):
    """(row of the frame, word hashes, first words of its paragraphs) of each text."""
    for k, t in shingles.slices(pa.array(f["text"], pa.string())):
        starts, codes, distinct = shingles.words(t)
        h = shingles.hashes(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)
        doc, word, *_ = paragraphs(t)
        at = np.searchsorted(doc, np.arange(len(t) + 1))
        for i in range(len(t)):
            yield k + i, h[starts[i] : starts[i + 1]], word[at[i] : at[i + 1]]


def _windows(frames):
    for f in frames:
        rows = []
        for i, h, begin in _text_words(f):
            for want in f["wanted"].iat[i]:
                word, side = want["k_word"], want["side"]
                n = int(np.searchsorted(begin, word))
                b = begin[: max(0, n - AWAY + 1)] if side < 0 else begin[n + AWAY :]
                most = len(h) if not len(b) else word - int(b[-1]) + REACH + 1 if side < 0 else int(b[0]) - word + REACH + 1
                rows.append((f["doc_id"].iat[i], f["mark"].iat[i], word, side, _outward(h, word, side)[:most].tobytes()))
        yield pd.DataFrame(rows, columns=["k_doc", "k_mark", "k_word", "side", "words"]).astype({"k_doc": "int64", "k_mark": "int64", "k_word": "int32", "side": "int32"})


def _grown(frames):
    for f in frames:
        rows = []
        for i, h, begin in _text_words(f):
            ident = f["doc_id"].iat[i], f["mark"].iat[i]
            for e in f["ends"].iat[i]:
                word, side, keeper, k_word = e["word"], e["side"], (e["k_doc"], e["k_mark"]), e["k_word"]
                a, b = _outward(h, word, side), np.frombuffer(e["words"], np.uint64)
                if ident == keeper:  # neither copy grows into the other
                    a, b = (x[: max(0, word - k_word - SPAN)] for x in (a, b))
                for d, w, n, removed in zip((ident, keeper), (word, k_word), reach(a, b, e["size"]), (True, False), strict=True):
                    if n:
                        rows.append((*d, removed, w - n, w, keeper[0]) if side < 0 else (*d, removed, w + SPAN, w + SPAN + n, keeper[0]))
        yield pd.DataFrame(rows, columns=["doc_id", "mark", "removed", "first_word", "end_word", "class_id"]).drop_duplicates().astype({"doc_id": "int64", "mark": "int64", "removed": "bool", "first_word": "int32", "end_word": "int32", "class_id": "int64"})


def _growth(texts: DataFrame, runs: DataFrame) -> DataFrame:
    """What the ends of removed runs, and of the copies that stay, gain: (doc_id, mark, removed, first_word, end_word, class_id)."""
    end = lambda side, word, k: F.struct(F.lit(side).alias("side"), F.col(word).alias("word"), F.col(f"{k}.class_id").alias("k_doc"), F.col(f"{k}.k_mark").alias("k_mark"), F.col(f"{k}.k_word").alias("k_word"), (F.col("last_word") + SPAN - F.col("first_word")).alias("size"))
    ends = runs.where("removed").select(*ROW, F.inline(F.array(end(-1, "first_word", "k_first"), end(1, "last_word", "k_last"))))
    anchor = F.xxhash64("k_doc", "k_mark", "k_word", "side").alias("anchor")
    ends = scratch.written(ends.where("doc_id <> k_doc or mark <> k_mark or word <> k_word").select("*", anchor), "run-ends")
    wanted = ends.select("k_doc", "k_mark", "k_word", "side").distinct().groupBy(F.col("k_doc").alias("doc_id"), F.col("k_mark").alias("mark")).agg(F.collect_list(F.struct("k_word", "side")).alias("wanted"))
    windows = texts.join(wanted, ROW).mapInPandas(_windows, "k_doc long, k_mark long, k_word int, side int, words binary")
    windows = windows.groupBy(anchor).agg(F.min("words").alias("words"))
    by_doc = scratch.salted(ends, windows, "anchor", scratch.hot_keys(ends, "anchor"), ROW).groupBy(*ROW).agg(F.collect_list(F.struct("side", "word", "k_doc", "k_mark", "k_word", "size", "words")).alias("ends"))
    return texts.join(by_doc, ROW).mapInPandas(_grown, "doc_id long, mark long, removed boolean, first_word int, end_word int, class_id long").distinct()


def duplicate_runs(docs: DataFrame, threshold: float = 0.8, recall: float = 0.995, shard_chars: int = 4 << 20, fan: int = route.FAN) -> DataFrame:
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text").where("doc_id is not null and text is not null")
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    shards, bands = max(1, math.ceil(chars / shard_chars)), shingles.tune(threshold, recall, ROWS)
    hits = _messages(texts, bands, shards, fan).groupBy("shard").applyInPandas(_collide, "content long, bucket long, size long, slices long")
    hits = scratch.written(hits, "paragraph-hits")
    once = hits.groupBy("content").agg(F.max("slices").alias("slices"))
    hot = once.where("slices > 16").orderBy(F.desc("slices"), "content").limit(1000).select("content")
    places = scratch.written(scratch.salted(_places(texts), once.select("content"), "content", hot, [*ROW, "word"]), "paragraph-places")
    ties = scratch.written(_near_ties(texts, hits.where("bucket is not null"), places, threshold), "paragraph-ties")
    root = components(ties)
    nodes = hits.where("bucket is null").select("content").union(ties.select("a")).union(ties.select("b")).distinct()
    nodes = scratch.written(nodes.join(root, nodes["content"] == root["node"], "left").select("content", F.coalesce("root", "content").alias("class")), "paragraph-classes")
    seen = scratch.salted(places, nodes, "content", hot, [*ROW, "word"]).select("class", *ROW, "word")
    keep = seen.groupBy("class").agg(F.min(F.struct(*ROW, "word")).alias("k"), F.max(F.struct(*ROW)).alias("last")).where("struct(k.doc_id, k.mark) < last")
    hot_classes = nodes.join(F.broadcast(hot), "content", "left_semi").select("class").distinct()
    seen = scratch.salted(seen, keep.select("class", "k"), "class", hot_classes, [*ROW, "word"]).select(*ROW, "word", F.struct(F.col("k.doc_id").alias("class_id"), F.col("k.mark").alias("k_mark"), F.col("k.word").alias("k_word")).alias("k"), (F.struct(*ROW, "word") != F.col("k")).alias("removed"))
    # Words under several paragraphs: what one of them removes is removed. Runs begin where no earlier paragraph of the kind reaches.
    cells = seen.groupBy(*ROW, "word").agg(F.min("k").alias("k"), F.max("removed").alias("removed"))
    kind = [*ROW, "removed"]
    w = Window.partitionBy(*kind).orderBy("word")
    cells = cells.withColumn("new", F.coalesce((F.lag("word").over(w) + SPAN < F.col("word")).cast("int"), F.lit(1)))
    cells = cells.withColumn("run", F.sum("new").over(w))
    runs = cells.groupBy(*kind, "run").agg(F.min("word").alias("first_word"), F.max("word").alias("last_word"), F.min_by("k", "word").alias("k_first"), F.max_by("k", "word").alias("k_last"))
    runs = scratch.written(runs, "paragraph-runs")
    x = runs.select(*kind, "first_word", (F.col("last_word") + SPAN).alias("end_word"), F.col("k_first.class_id").alias("class_id"))
    x = x.unionByName(_growth(texts, runs))
    w = Window.partitionBy(*kind).orderBy("first_word", "end_word")
    x = x.withColumn("new", F.coalesce((F.max("end_word").over(w.rowsBetween(Window.unboundedPreceding, -1)) < F.col("first_word")).cast("int"), F.lit(1)))
    x = x.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    x = x.groupBy(*kind, "run").agg(F.min("first_word").alias("first_word"), F.max("end_word").alias("end_word"), F.min_by("class_id", F.struct("first_word", "class_id")).alias("class_id"))
    # A paragraph that other copies keep here is no kept run where this text's removed runs have grown over it.
    over = F.max(F.when(F.col("removed"), F.col("end_word"))).over(Window.partitionBy(*ROW).orderBy("first_word", F.desc("removed")).rowsBetween(Window.unboundedPreceding, 0))
    x = x.withColumn("over", over).where("removed or over is null or over < end_word")
    return x.select("doc_id", "first_word", "end_word", "removed", "class_id", F.col("mark").alias("text_hash"))


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def without(text: str, runs: list[tuple[int, int]]) -> str:
    """The text less the words of the runs (first, end), which ascend."""
    spans = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for a, b in sorted(runs):
        if a < len(spans):
            start = spans[a][0]
            if start > at:
                out.append(text[at:start])
            at = max(at, spans[min(b, len(spans)) - 1][1])
    out.append(text[at:])
    return "".join(out).strip()


def deduplicated(docs: DataFrame, **how) -> DataFrame:
    """The input's rows with the removed runs cut out of their texts; n_chars, if there is one, follows. Rows whose text is left empty go."""
    ident = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("doc_id")
    runs = duplicate_runs(docs.select(ident, "text"), **how).where("removed").groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("first_word", "end_word"))).alias("runs"))
    cut = F.pandas_udf(lambda t, r: pd.Series([x if y is None else without(x, [(c["first_word"], c["end_word"]) for c in y]) for x, y in zip(t, r, strict=True)]), "string")
    x = docs.select(F.struct("*").alias("row"), ident, F.xxhash64("text").alias("text_hash")).join(runs, ["doc_id", "text_hash"], "left")
    old = F.col("row")["text"]
    x = x.select("row", "runs", F.when(F.col("runs").isNull() | old.isNull(), old).otherwise(cut(F.coalesce(old, F.lit("")), "runs")).alias("new"))
    x = x.where("runs is null or row.text is null or new <> ''")
    value = {c: F.col("row")[c] for c in docs.columns} | {"text": F.col("new")}
    if "n_chars" in value:
        value["n_chars"] = F.when(F.col("runs").isNull(), value["n_chars"]).otherwise(F.length("new")).cast(docs.schema["n_chars"].dataType)
    return x.select(*[v.alias(c) for c, v in value.items()])
