"""Join of documents whose sets of word n-grams have a Jaccard similarity of at least a threshold.

Texts with equal sets are one node of the join; each node is signed by MinHash. The
signature is cut into bands, as many as the target recall needs at the threshold, and
nodes are shuffled on band hashes. Each bucket ties its nodes to its least node; the
components of these ties hold every colliding pair, and pairs are verified on the full
sets themselves, each once, in groups:

* a component is a group, in which every pair is verified, or
* where that would compare more (a chain of chance collisions, say), its buckets are:
  buckets of the same nodes are one group, and a pair is verified in the group that has
  the first band in which the two agree.

A group of over `block` nodes or `block_grams` n-grams is cut into pairs of blocks,
which go to tasks of their own; a task returns numbers of links and ties between linked
nodes, never pairs.

Result: one row for each row of the input that has an id: doc_id, class_id (the least
doc_id of its component under verified links), links (other rows whose set is within
the threshold, copies included), copies (other rows with an equal set), text_hash, and
class_hash (of the row that the class is named by, the least by id and text hash).

Words are runs between white space, in lower case. A text of one to n - 1 words has
one n-gram: all its words. Null texts and texts without words link to nothing. Rows
without an id are left out; rows with equal ids are rows of their own. A very long text
is a set of one task. An empty table gives no rows. Nodes are named by 64 bits of a
128-bit hash of the set. Only doc_id and text are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import scratch, shingles
from .components import components
from .memory import trim

ROWS = 9


def _node(grams: np.ndarray) -> tuple[int, np.ndarray]:
    u = np.unique(grams)
    return int.from_bytes(xxhash.xxh3_128_digest(u.tobytes())[:8], "big", signed=True), u


def signatures(docs: DataFrame, n: int, count: int) -> DataFrame:
    """doc_id, mark, node (null without words), grams (how many distinct ones), bands."""

    def run(batches):
        for b in batches:
            for at, texts in shingles.slices(b.column(2)):
                starts, grams = shingles.shingles(texts, n)
                sig = shingles.bands(shingles.minhash(starts, grams, count * ROWS), count)
                nodes = [_node(grams[x:y]) if y > x else (None, ()) for x, y in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * count), pa.array(sig.reshape(-1)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), b.column(1).slice(at, len(texts)), pa.array([x for x, _ in nodes], pa.int64()), pa.array([len(u) for _, u in nodes], pa.int64()), lists], names=["doc_id", "mark", "node", "grams", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text").where("doc_id is not null").mapInArrow(run, "doc_id long, mark long, node long, grams long, bands array<long>")


def links_in(sets: list[np.ndarray], side: np.ndarray | None, threshold: float, columns: int = 4096) -> np.ndarray:
    """Matrix of verified links between sets; with `side` given, only between the two sides."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    rows = np.repeat(np.arange(m), sizes)
    _, code, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = df[code] > 1
    rank = np.cumsum(df > 1) - 1
    rows, cols = rows[shared], rank[code[shared]]
    order = np.argsort(cols, kind="stable")
    rows, cols = rows[order], cols[order]
    common = np.zeros((m, m), np.float32)
    for lo in range(0, int(cols[-1]) + 1 if len(cols) else 0, columns):
        a, b = np.searchsorted(cols, [lo, lo + columns])
        part = np.zeros((m, min(columns, int(cols[b - 1]) - lo + 1)), np.float32)
        part[rows[a:b], cols[a:b] - lo] = 1
        common += part @ part.T
    link = common >= threshold * (sizes[:, None] + sizes[None, :] - common) - 1e-6
    np.fill_diagonal(link, False)
    return link if side is None else link & (side[:, None] != side[None, :])


def labels_of(link: np.ndarray) -> np.ndarray:
    """Least index of each row's component."""
    label = np.arange(len(link))
    while True:
        new = np.minimum(label, np.where(link, label[None, :], len(link)).min(axis=1, initial=len(link)))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def first_shared(bands: np.ndarray, of: int) -> np.ndarray:
    """Whether the first band in which two rows agree is one of the bits of `of`."""
    out, open_ = np.zeros((len(bands), len(bands)), bool), np.ones((len(bands), len(bands)), bool)
    for k in range(bands.shape[1]):
        same = open_ & (bands[:, k][:, None] == bands[:, k][None, :])
        if of >> k & 1:
            out |= same
        open_ &= ~same
    return out


SMALL = 12


def _few(sets: list[set], copies: list[int], ok, threshold: float) -> tuple[list[int], list[int]]:
    """Numbers of links and least index of the component of each of a few sets; `ok` says whether a pair counts."""
    m = len(sets)
    links, label = [0] * m, list(range(m))
    for i in range(m):
        for j in range(i):
            a, b = len(sets[i]), len(sets[j])
            if min(a, b) < threshold * max(a, b) - 1e-6 or not ok(i, j):
                continue
            common = len(sets[i] & sets[j])
            if common >= threshold * (a + b - common) - 1e-6:
                links[i] += copies[j]
                links[j] += copies[i]
                x, y = sorted((label[i], label[j]))
                if x != y:
                    label = [x if v == y else v for v in label]
    return links, label


def _verify(threshold: float):
    """Links and ties of groups of rows (root, lo, hi, side, node, copies, grams), which come one group after another; with bands and own, only of pairs that are the group's."""

    def flush(by_node: dict[int, tuple], out: list[list]) -> None:
        rows = [by_node[k] for k in sorted(by_node)]
        cut = rows[0][1] != rows[0][2]
        node, own = [r[4] for r in rows], rows[0][8] if len(rows[0]) > 7 and rows[0][7] is not None else None
        sets = [np.frombuffer(r[6], np.uint64) for r in rows]
        if len(rows) <= SMALL and own is None:
            links, label = _few([set(s.tolist()) for s in sets], [r[5] for r in rows], lambda i, j: not cut or rows[i][3] != rows[j][3], threshold)
        else:
            link = links_in(sets, np.array([r[3] for r in rows]) if cut else None, threshold)
            if own is not None:
                link &= first_shared(np.array([r[7] for r in rows]), int(own))
            links, label = (link.astype(np.int64) @ np.array([r[5] for r in rows])).tolist(), labels_of(link).tolist()
        out[0] += node
        out[1] += links
        out[2] += [node[k] for k in label]

    def run(frames):
        key, held = None, {}
        for p in frames:
            out: list[list] = [[], [], []]
            for r in zip(*(p[c].tolist() for c in p.columns), strict=True):
                if r[:3] != key:
                    if held:
                        flush(held, out)
                    key, held = r[:3], {}
                held.setdefault(r[4], r)  # repeated rows name a node again
            if out[0]:
                yield pd.DataFrame({"node": out[0], "links": out[1], "root": out[2]})
            trim()
        if held:
            out = [[], [], []]
            flush(held, out)
            yield pd.DataFrame({"node": out[0], "links": out[1], "root": out[2]})

    return run


def _groups(nodes: DataFrame, entries: DataFrame, member: DataFrame, block: int, block_grams: int) -> DataFrame:
    """(node, group, chunks, own): the groups that each node is verified in; own is null where every pair is."""
    chunks = lambda n, grams: F.greatest(F.ceil(F.col(n) / block), F.ceil(F.col(grams) / block_grams)).cast("int")
    weighed = member.join(nodes.select("node", "grams"), "node")
    sizes = weighed.groupBy("root").agg(F.count("*").alias("size"), F.sum("grams").alias("all")).withColumn("chunks", chunks("size", "all"))
    sizes = scratch.written(sizes, "component-sizes")
    large = sizes.where("chunks > 1").select("root", (F.col("size") * F.col("chunks")).alias("cost"))
    hot = sizes.where(F.col("size") > 1000).orderBy(F.desc("size"), "root").limit(1000).select("root")
    there = scratch.written(scratch.salted(weighed, large.select("root"), "root", hot, ["node"]), "large-components")
    inside = entries.join(there, "node")
    buckets = inside.groupBy("bucket", "root").agg(F.min("band").alias("band"), F.count("*").alias("size"), F.sum("grams").alias("all"), F.sum(F.xxhash64("node") % (1 << 40)).alias("of")).where("size > 1")
    # Buckets of the same nodes: one group, by the least of them. The shift is of a long, for up to 63 bands.
    bits = F.bit_or(F.expr("shiftleft(1L, band)"))
    merged = scratch.written(buckets.groupBy("root", "size", "of").agg(F.min("bucket").alias("group"), F.first("all").alias("all"), bits.alias("own")).withColumn("chunks", chunks("size", "all")), "bucket-groups")
    less = merged.groupBy("root").agg(F.sum(F.col("size") * F.col("chunks")).alias("cost_buckets")).join(large, "root").where("cost_buckets < cost").select("root")
    less = scratch.written(less, "by-buckets")
    whole = scratch.salted(member, sizes.join(less, "root", "left_anti").select("root", "chunks"), "root", hot, ["node"])
    whole = whole.select("node", F.col("root").alias("group"), "chunks", F.lit(None).cast("long").alias("own"))
    parts = merged.join(less, "root", "left_semi").select(F.col("group").alias("bucket"), "chunks", "own")
    hot_buckets = merged.where(F.col("size") > 1000).orderBy(F.desc("size"), "group").limit(1000).select(F.col("group").alias("bucket"))
    split = scratch.salted(inside.select("node", "bucket"), parts, "bucket", hot_buckets, ["node"])
    return whole.unionByName(split.select("node", F.col("bucket").alias("group"), "chunks", "own"))


def join(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.995, block: int = 512, block_grams: int = 4 << 20) -> DataFrame:
    count = shingles.tune(threshold, recall, ROWS)
    signed = scratch.written(signatures(docs, n, count), "signatures")
    nodes = signed.where("node is not null").groupBy("node").agg(F.min(F.struct("doc_id", "mark")).alias("first"), F.count("*").alias("copies"), F.first("grams").alias("grams"), F.first("bands").alias("bands"))
    entries = nodes.select("node", F.posexplode("bands").alias("band", "bucket"))
    least = entries.groupBy("bucket").agg(F.min("node").alias("b"), F.count("*").alias("m")).where("m > 1").drop("m")
    ties = scratch.joined(entries, least, "bucket").select(F.col("node").alias("a"), "b").where("a <> b").distinct()
    star = components(ties)
    member = scratch.written(star.union(star.select(F.col("root").alias("node"), "root").distinct()), "members")
    groups = _groups(nodes, entries, member, block, block_grams)
    groups = groups.groupBy("node").agg(F.collect_list(F.struct("group", "chunks", "own")).alias("groups"))
    kept = F.when(F.exists("groups", lambda g: g["own"].isNotNull()), F.col("bands")).alias("bands")
    wanted = nodes.join(groups, "node").select("first.*", "node", "copies", kept, "groups")

    def sets(frames):
        names = ["root", "lo", "hi", "side", "node", "copies", "grams", "bands", "own"]
        for p in frames:
            for at, texts in shingles.slices(pa.array(p["text"], pa.string())):
                starts, grams = shingles.shingles(texts, n)
                rows = []
                for i in range(len(texts)):
                    w = p.iloc[at + i]
                    packed = _node(grams[starts[i] : starts[i + 1]])[1].tobytes()
                    for g in w["groups"]:
                        own = g["own"]
                        mine = int(w["node"]) % g["chunks"]
                        rows += [(g["group"], min(mine, x), max(mine, x), mine, w["node"], w["copies"], packed, None if own is None else w["bands"], own) for x in range(g["chunks"])]
                    if len(rows) > 2000:
                        yield pd.DataFrame(rows, columns=names).astype({"own": "Int64"})
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=names).astype({"own": "Int64"})

    # Rows that are equal in id and text have the same set: a node may come twice, and counts once.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    grams = texts.join(wanted, ["doc_id", "mark"]).mapInPandas(sets, "root long, lo int, hi int, side int, node long, copies long, grams binary, bands array<long>, own long")
    grams = grams.withColumn("__own", F.col("own").isNotNull())
    parts = F.xxhash64("root", "lo", "hi", "__own")
    found = grams.repartition(parts).sortWithinPartitions("__own", "root", "lo", "hi").drop("__own").mapInPandas(_verify(threshold), "node long, links long, root long")
    found = scratch.written(found, "links")
    final = components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    linked = found.groupBy("node").agg(F.sum("links").alias("links")).join(final, "node", "left").withColumn("root", F.coalesce("root", "node"))
    each = nodes.select("node", "first", "copies").join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    each = scratch.written(each, "nodes")
    name = each.groupBy("root").agg(F.min("first").alias("class"))
    each = scratch.salted(each, name, "root", scratch.hot_keys(final, "root"), ["node"]).select("node", F.col("class.doc_id").alias("class_id"), F.col("class.mark").alias("class_hash"), "copies", F.coalesce("links", F.lit(0)).alias("links"))
    rows = signed.select("doc_id", F.col("mark").alias("text_hash"), "node")
    hot = nodes.where("copies > 1000").orderBy(F.desc("copies"), "node").limit(1000).select("node")
    out = scratch.salted(rows.where("node is not null").withColumn("__deal", F.monotonically_increasing_id()), each, "node", hot, ["__deal"])
    other = (F.col("copies") - 1).alias("copies")
    out = out.select("doc_id", "class_id", (F.col("links") + F.col("copies") - 1).alias("links"), other, "text_hash", "class_hash")
    zero = F.lit(0).cast("long")
    alone = rows.where("node is null").select("doc_id", F.col("doc_id").alias("class_id"), zero.alias("links"), zero.alias("copies"), "text_hash", F.col("text_hash").alias("class_hash"))
    return out.unionByName(alone)


def kept_rows(docs: DataFrame, **how) -> DataFrame:
    """One row of each class: of the rows with the least id and text hash, the first by the hash of all its columns. Rows without an id come after all others, rows without words are classes of equal texts. Columns stay as they are."""
    ident = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("doc_id")
    found = join(docs.select(ident, "text"), **how).where("doc_id = class_id and text_hash = class_hash")
    keys = scratch.written(found.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")), "kept-keys")
    rows = docs.select(F.struct("*").alias("row"), ident, F.xxhash64("text").alias("text_hash"))
    once = rows.join(keys.where("n = 1").drop("n"), ["doc_id", "text_hash"]).select("row")
    nth = F.row_number().over(Window.partitionBy("doc_id", "text_hash").orderBy(F.xxhash64(F.to_json("row"))))
    more = rows.join(keys.where("n > 1").drop("n"), ["doc_id", "text_hash"]).withColumn("nth", nth).where("nth = 1").select("row")
    return once.union(more).select("row.*")
