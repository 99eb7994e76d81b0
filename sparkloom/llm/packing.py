"""Conflict-constrained best-fit packing.

Items are taken longest first. Open bins stand in order of their residual room; the
search starts at the successor of the item's length and goes on, past bins whose
source or duplicate-cluster bitmap has the item's bit, to the tightest compatible
bin; without one a new bin opens. So no bin holds two items of one source or of one
cluster. Texts longer than a bin are cut: full pieces get bins of their own, the
rest is an item like any other.

Items are dealt to shards by a hash of their id, about `shard_items` to each, and
each shard is packed by itself; only ids, lengths, sources and clusters move. The
number of half-empty bins at the end of a shard doesn't depend on the input's size.

With `order`, a column of places, bins follow that order: shards are ranges of places,
so that the bins up to the end of a shard hold just the items up to that place, and in
a shard the bins are numbered by the place of their first item.

Null or empty texts have length 0 and are placed like others. A null source or
cluster conflicts with nothing. Equal lengths: the smaller id (with `order`, the smaller
place) first, equal bins: the one that came first to that residual. Repeated rows are items of their own.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PACKED = "doc_id long, source string, piece int, start long, length long, bin_id long, bin_offset long"


def _codes(values: pd.Series) -> np.ndarray:
    return pd.factorize(values)[0]  # -1 for null


def best_fit(lengths: np.ndarray, sources: np.ndarray, clusters: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, in the order given. sources and clusters: codes, -1 for none."""
    n = len(lengths)
    many = np.bincount(clusters[clusters >= 0], minlength=1) > 1
    bit_of = np.where(many, np.cumsum(many) - 1, -1)  # clusters of one item can't conflict
    cbit = np.where(clusters >= 0, bit_of[np.maximum(clusters, 0)], -1)
    src_map = np.zeros((n, max(1, math.ceil((sources.max(initial=-1) + 1) / 64))), np.uint64)
    clu_map = np.zeros((n, max(1, math.ceil((cbit.max(initial=-1) + 1) / 64))), np.uint64)
    room, order, bins = np.empty(n, np.int64), np.empty(n, np.int64), 0
    where, offset = np.empty(n, np.int64), np.empty(n, np.int64)
    one = np.uint64(1)
    for i in range(n):
        size, s, c = int(lengths[i]), int(sources[i]), int(cbit[i])
        sb = one << np.uint64(s & 63) if s >= 0 else None
        cb = one << np.uint64(c & 63) if c >= 0 else None
        at, step, found = int(np.searchsorted(room[:bins], size)), 64, -1
        while at < bins:
            look = order[at : min(at + step, bins)]
            ok = np.ones(len(look), bool)
            if sb is not None:
                ok &= src_map[look, s >> 6] & sb == 0
            if cb is not None:
                ok &= clu_map[look, c >> 6] & cb == 0
            j = int(ok.argmax())
            if ok[j]:
                found = at + j
                break
            at, step = at + step, step * 4
        if found < 0:
            b, left, found = bins, capacity - size, bins
            bins += 1
        else:
            b, left = int(order[found]), int(room[found]) - size
        k = int(np.searchsorted(room[:found], left, side="right"))
        room[k + 1 : found + 1], order[k + 1 : found + 1] = room[k:found].copy(), order[k:found].copy()
        room[k], order[k] = left, b
        where[i], offset[i] = b, capacity - left - size
        if sb is not None:
            src_map[b, s >> 6] |= sb
        if cb is not None:
            clu_map[b, c >> 6] |= cb
    return where, offset


def _pack_shard(capacity: int):
    def run(p: pd.DataFrame) -> pd.DataFrame:
        shard = int(p["shard"].iloc[0])
        full = (p["length"].to_numpy() - 1).clip(0) // capacity
        ordered = "at" in p.columns
        p = p.assign(full=full, rest=p["length"] - full * capacity).sort_values(["rest", "at" if ordered else "doc_id"], ascending=[False, True], kind="stable", ignore_index=True)
        where, offset = best_fit(p["rest"].to_numpy(), _codes(p["source"]), _codes(p["cluster"]), capacity)
        rest = pd.DataFrame({"doc_id": p["doc_id"], "source": p["source"], "piece": p["full"], "start": p["full"] * capacity, "length": p["rest"], "bin": where, "bin_offset": offset})
        n = p["full"].to_numpy()
        at = np.repeat(np.arange(len(p)), n)
        piece = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        used = int(where.max(initial=-1)) + 1
        whole = pd.DataFrame({"doc_id": p["doc_id"].to_numpy()[at], "source": p["source"].to_numpy()[at], "piece": piece, "start": piece * capacity, "length": capacity, "bin": used + np.arange(len(at)), "bin_offset": 0})
        out = pd.concat([rest, whole], ignore_index=True) if len(at) else rest
        if ordered:
            place, first = p["at"].to_numpy(np.int64), np.full(used + len(at), np.iinfo(np.int64).max)
            np.minimum.at(first, out["bin"].to_numpy(), np.concatenate([place, place[at]]))
            number = np.empty(len(first), np.int64)
            number[np.argsort(first, kind="stable")] = np.arange(len(first))
            out["bin"] = number[out["bin"].to_numpy()]
        return out.assign(bin_id=(np.int64(shard) << 32) + out["bin"].to_numpy(np.int64), piece=out["piece"].astype(np.int32))[["doc_id", "source", "piece", "start", "length", "bin_id", "bin_offset"]]

    return run


def pack(docs: DataFrame, capacity: int = 16384, shard_items: int = 8192, cluster: str | None = None, order: str | None = None) -> DataFrame:
    """Places of all texts (see PACKED); lengths are characters. `cluster` names a column of duplicate clusters; without one, equal texts are a cluster. `order` names a column of whole numbers from 0, without nulls, that bins are to follow."""
    c = F.col(cluster).cast("string") if cluster else F.when(F.length("text") > 0, F.xxhash64("text").cast("string"))
    at = [F.col(order).cast("long").alias("at")] if order else []
    items = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("length"), c.alias("cluster"), *at)
    n = items.agg(F.coalesce(F.max("at") + 1, F.lit(0))).first()[0] if order else docs.count()
    shards = max(1, math.ceil(n / shard_items))
    items = items.withColumn("shard", F.expr(f"at * {shards} div {max(1, n)}") if order else F.pmod(F.xxhash64("doc_id", F.lit("shard")), F.lit(shards)))
    return items.groupBy("shard").applyInPandas(_pack_shard(capacity), PACKED)
