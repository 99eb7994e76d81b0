"""Language-model scoring with a sharded Elias-Fano n-gram trie.

Training tokens of all documents outside the held-out fold are counted into n-grams
of every order up to `order`. P(w|h) = (c(hw) + T(h) P(w|h')) / (c(h) + T(h)), with
T(h) the number of distinct words after h (Witten and Bell); below the lowest order,
whose only context is the empty one, stands 1/(V+1). Each level's
(c(hw) / (c(h) + T(h)), T(h) / (c(h) + T(h))) are the quantised values of its tries.

Texts are tokenised once into blocks, rows of a table in the shared folder. Blocks and
replies are dealt to buckets by the block when they are written, so that neither is
shuffled again where they meet. A block
sends its distinct n-grams to shards by a hash of the context, as Elias-Fano sequences;
a shard adds them up, builds its trie level, looks every n-gram up in it by successor
search within its context and returns codes to the blocks, which sum them over their
texts. No executor needs more than its shards, whose number grows with the tokens.

A block has at most `fan` messages an order, each for a range of shards. Where a range
is more than one shard, messages of some blocks are merged in a unit and sent on, and
their replies come back the same way: messages follow the entries, one pass for each
power of `fan` in the number of shards.

Contexts that begin with words of over 1/256 of a block's tokens may follow a third of
all tokens: their successors are dealt by the word as well, as those of the empty
context are, and their c(h) and T(h) are summed over shards (at most 257 to the power
of the context's length, if as many exist; each is a few bytes on the driver). A hot
n-gram is one row of a block.

Tokens: lower-cased (A-Z only) runs of other than ASCII white space, then one end
token; null text is empty and has the end token only. Known are tokens with a
training count. Words are 48-bit hashes; inside a shard a longer n-gram is some bits of
its context's hash and of the word's (NAMES), so that of a shard's million contexts
one in 4,000 shares a name with another. Rows with a null id are scored but not learned from.
Repeated rows count as they stand; a very long text is a block of its own. An empty
table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import math
import pickle
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard as zstd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labelled, route, scratch, shingles
from .eliasfano import EliasFano, TrieLevel, log10_of, mapped, quantised
from .memory import trim
from .shingles import mixed

END, BEGIN, ROOT = np.uint64(0x6E1D_0000_0000_0001), np.uint64(0xBE61_0000_0000_0001), np.uint64(0x0007_0000_0000_0001)
BLOCK_BYTES = 6 << 20
HOT = 256
#: Bits of the context's and of the word's hash by order; higher orders are as the last.
NAMES = {1: (0, 48), 2: (28, 24), 3: (32, 18)}
UNIT = 16 << 20
_MUL = np.uint64(0x9E3779B97F4A7C15)
_HASH = ~np.uint64(0xFFFF)


def _bits(k: int) -> tuple[int, int]:
    return NAMES[min(k, max(NAMES))]


def _halves(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Low and high bytes apart, for the compressor."""
    return (codes & 0xFF).astype(np.uint8), (codes >> 8).astype(np.uint8)


def _packed(x) -> bytes:
    return zstd.ZstdCompressor(level=1).compress(pickle.dumps(x, 5))


def _unpacked(x):
    return pickle.loads(zstd.ZstdDecompressor().decompress(x))


def tokenised(docs: DataFrame, parts: int, held: int) -> DataFrame:
    """Blocks: block, tokens (of training texts), hot (words and their numbers), payload (ids, held-out flags, learned flags, starts, codes, word hashes)."""

    def run(batches):
        task, k = TaskContext.get().partitionId(), 0
        for b in batches:
            for at, texts in shingles.slices(b.column(1), BLOCK_BYTES):
                starts, codes, distinct = shingles.words(texts, lower=False)
                h = shingles.hashes(distinct) & _HASH
                ids = b.column(0).slice(at, len(texts)).to_pylist()
                out, learn = (np.array(b.column(c).slice(at, len(texts)).to_pylist(), bool) for c in (2, 3))
                n = np.bincount(codes, np.repeat(learn, np.diff(starts)), minlength=len(h)).astype(np.int64)
                tokens = int(n.sum() + learn.sum())
                hot = np.flatnonzero(n * HOT > tokens)
                payload = _packed((ids, out, learn, np.diff(starts), *_halves(codes & 0xFFFF), (codes >> 16).astype(np.uint16), np.ascontiguousarray(h.view(np.uint8).reshape(-1, 8)[:, 2:])))
                yield pa.RecordBatch.from_pylist([{"block": f"{task}-{k}", "tokens": tokens, "hot": [{"h": int(x), "n": int(y)} for x, y in zip(h[hot].view(np.int64), n[hot], strict=True)], "payload": payload}], schema=pa.schema([("block", pa.string()), ("tokens", pa.int64()), ("hot", pa.list_(pa.struct([("h", pa.int64()), ("n", pa.int64())]))), ("payload", pa.binary())]))
                k += 1

    fold = labelled.fold("doc_id", parts) == held
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(fold, F.lit(False)).alias("o"), F.coalesce(~fold, F.lit(False)).alias("l"))
    return scratch.dealt([x.mapInArrow(run, "block string, tokens long, hot array<struct<h: long, n: long>>, payload binary")], "lm-blocks", "block")


def _runs(x: np.ndarray, shard: np.ndarray | None = None) -> np.ndarray:
    """Where a new value begins."""
    if not len(x):
        return np.zeros(0, np.int64)
    new = x[1:] != x[:-1]
    return np.flatnonzero(np.concatenate([[True], new if shard is None else new | (shard[1:] != shard[:-1])]))


class Entries:
    """Distinct n-grams of one order, in order of shard and key, with the flag of split contexts and training counts."""

    def __init__(self, k: int, shard: np.ndarray, key: np.ndarray, split: np.ndarray, count: np.ndarray):
        self.k, self.shard, self.key, self.split, self.count = k, shard, key, split, count

    def names(self) -> np.ndarray:
        """The context of each entry."""
        return self.key >> np.uint64(_bits(self.k)[1])

    def contexts(self) -> np.ndarray:
        """Where a new context begins."""
        return _runs(self.names(), self.shard)

    def cut(self, width: int, order: int):
        """(lane, the entries' positions) of each range of so many shards."""
        first = _runs(self.shard // width)
        for a, b in zip(first, np.append(first[1:], len(self.key)), strict=True):
            yield int(self.shard[a]) // width * order + self.k - 1, slice(int(a), int(b))

    def message(self, part: slice, width: int) -> bytes:
        count = self.count[part]
        count = count.astype(np.uint8) if count.max(initial=0) < 256 else count.astype(np.uint32) if count.max() < 1 << 32 else count
        bits, shard = sum(_bits(self.k)), self.shard[part]
        if width << bits <= 1 << 64:
            keys = EliasFano.build((shard % width).astype(np.uint64) << np.uint64(bits) | self.key[part], width << bits).tobytes()
        else:
            keys = _packed((shard.astype(np.uint32), self.key[part]))
        return pickle.dumps((keys, _packed((np.packbits(self.split[part]), count))), 5)

    @classmethod
    def read(cls, message: bytes, lane: int, width: int, order: int) -> Entries:
        keys, rest = pickle.loads(message)
        split, count = _unpacked(rest)
        if width << (bits := sum(_bits(lane % order + 1))) <= 1 << 64:
            key = EliasFano.frombuffer(keys, 0)[0].all()
            shard = lane // order * width + (key >> np.uint64(bits)).astype(np.int64)
            key &= np.uint64((1 << bits) - 1)
        else:
            shard, key = _unpacked(keys)
            shard = shard.astype(np.int64)
        return cls(lane % order + 1, shard, key, np.unpackbits(split, count=len(key)).astype(bool), count.astype(np.int64))

    @classmethod
    def merged(cls, parts: list[Entries]) -> tuple[Entries, np.ndarray]:
        """All entries of some messages, and the place of each in turn."""
        shard, key, split, count = (np.concatenate([getattr(p, x) for p in parts]) for x in ("shard", "key", "split", "count"))
        order = np.lexsort((key, shard))
        first = _runs(key[order], shard[order])
        place = np.empty(len(key), np.int64)
        place[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(key))))
        pick = order[first]
        total = np.add.reduceat(count[order], first) if len(first) else count
        return cls(parts[0].k, shard[pick], key[pick], split[pick], total), place


def reply(e: Entries, code: np.ndarray, other: np.ndarray) -> bytes:
    """Value codes, and counts (order 1) or backoff codes of the contexts."""
    if e.k > 1:
        return _packed((*_halves(code), *_halves(other[e.contexts()])))
    return _packed((*_halves(code), other.astype(np.uint32) if other.max(initial=0) < 1 << 32 else other))


def read_reply(e: Entries, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    low, high, *other = _unpacked(data)
    code = high.astype(np.uint16) << 8 | low
    if e.k == 1:
        return code, other[0]
    first = e.contexts()
    return code, np.repeat(other[1].astype(np.uint16) << 8 | other[0], np.diff(np.append(first, len(e.key))))


class Block:
    """The distinct n-grams of a block's texts, by order (all, or the highest alone); what they are only depends on the block."""

    def __init__(self, payload: bytes, order: int, hot: np.ndarray, shards: int, last: bool = False):
        self.ids, self.out, learn, n, low, high, top, tails = _unpacked(payload)
        m, starts = len(self.ids), np.concatenate([[0], np.cumsum(n)])
        codes = top.astype(np.int64) << 16 | high.astype(np.int64) << 8 | low
        h = np.zeros((len(tails), 8), np.uint8)
        h[:, 2:] = tails
        h = h.view(np.uint64).reshape(-1)
        words = np.concatenate([h, [END]]).astype(np.uint64)
        self.n = np.diff(starts) + 1
        ends = np.cumsum(self.n)
        self.begin = ends - self.n
        w = np.full(int(ends[-1]) if m else 0, len(h), np.int64)
        inner = np.ones(len(w), bool)
        inner[ends - 1] = False
        w[inner] = codes
        at = np.arange(len(w)) - np.repeat(self.begin, self.n)
        trained = np.repeat(learn, self.n)
        is_hot = np.isin(np.concatenate([words, [BEGIN]]), np.concatenate([hot, [BEGIN]]))
        #: For each order, the positions that have such an n-gram, the entry of each, and the entries.
        self.levels: list[tuple[np.ndarray, np.ndarray, Entries]] = []

        def level(k: int, where: np.ndarray, inverse: np.ndarray, key: np.ndarray, by: np.ndarray, split: np.ndarray) -> None:
            if last and k < order:
                return
            shard = (mixed(by + np.uint64(k)) % np.uint64(shards)).astype(np.int64)
            count = np.bincount(inverse, trained[where], minlength=len(key)).astype(np.int64)
            o = np.argsort(key)
            o = o[np.argsort(shard[o].astype(np.uint16) if shards < 1 << 16 else shard[o], kind="stable")]
            place = np.empty(len(o), np.int64)
            place[o] = np.arange(len(o))
            self.levels.append((where, place[inverse], Entries(k, shard[o], key[o], split[o], count[o])))

        level(1, np.arange(len(w)), w, words >> np.uint64(16), words * _MUL + ROOT, np.ones(len(words), bool))
        # A context is a number below `size`, with its hash and whether all its words are hot.
        context, c_hash, c_hot = np.where(at > 0, np.roll(w, 1), len(words)), mixed(np.concatenate([words, [BEGIN]]) * _MUL), is_hot
        for k in range(2, order + 1):
            where = np.flatnonzero(at >= k - 2)
            gram, inverse = np.unique(context[where] * len(words) + w[where], return_inverse=True)
            ctx, word = gram // len(words), gram % len(words)
            split, whole = c_hot[ctx], words[word]
            of_context, of_word = _bits(k)
            key = c_hash[ctx] >> np.uint64(64 - of_context) << np.uint64(of_word) | whole >> np.uint64(64 - of_word)
            level(k, where, inverse, key, np.where(split, mixed(c_hash[ctx] + whole), c_hash[ctx]), split)
            now = np.full(len(w), -1)
            now[where] = inverse
            context = np.roll(now, 1)
            c_hash, c_hot = mixed(c_hash[ctx] * _MUL + whole), split & is_hot[word]

    def sent(self, width: int, order: int):
        """(lane, message) of each range of shards, for the highest level."""
        e = self.levels[-1][2]
        for lane, part in e.cut(width, order):
            yield lane, e.message(part, width)


def build_level(e: Entries) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The trie level of a shard's entries with a training count; the contexts, which of them each entry has, and their c(h) and T(h)."""
    bits = _bits(e.k)[1]
    words = e.key & np.uint64((1 << bits) - 1)
    if e.k == 1:
        contexts, rank, split = np.array([0], np.uint64), np.zeros(len(e.key), np.int64), np.array([True])
    else:
        first = e.contexts()
        contexts, split = e.names()[first], e.split[first]
        rank = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(e.key))))
    seen = e.count > 0
    r, count = rank[seen], e.count[seen].astype(float)
    c, t = np.bincount(r, count, minlength=len(contexts)), np.bincount(r, minlength=len(contexts))
    live = t > 0
    value = np.log10(count) - np.where(split, 0.0, np.log10(np.maximum(c + t, 1)))[r]
    backoff = np.where(split[live], 1, quantised(np.log10(t[live] / (c[live] + t[live]))))
    start = np.concatenate([[0], np.cumsum(t[live])])
    return TrieLevel.build(contexts[live], start, words[seen], quantised(value), backoff.astype(np.uint16), bits), contexts, rank, c, t


def _answered(e: Entries) -> tuple[np.ndarray, np.ndarray, int, int, list[dict]]:
    """Of a shard's entries: value codes, counts or backoff codes, tokens and words (order 1), sums of split contexts."""
    data, contexts, rank, c, t = build_level(e)
    code, backoff = TrieLevel(mapped(data)).find(contexts, rank, e.key & np.uint64((1 << _bits(e.k)[1]) - 1))
    if e.k == 1:
        return code, e.count, int(c[0]), int(t[0]), []
    s = np.flatnonzero(e.split[e.contexts()])
    sums = [{"k": e.k, "h": int(h), "c": int(a), "t": int(b)} for h, a, b in zip(contexts[s].view(np.int64), c[s], t[s], strict=True)]
    return code, backoff[rank], 0, 0, sums


SENT = "lane long, src string, message binary"
REPLIES = "lane long, src string, answer binary, n long, v long, sums array<struct<k: int, h: long, c: long, t: long>>"


def _replies(lane, src, answers: list[bytes], n: int, v: int, sums: list) -> pd.DataFrame:
    """Rows of REPLIES; the first has the totals."""
    rest = len(answers) - 1
    return pd.DataFrame({"lane": lane, "src": src, "answer": answers, "n": [n] + [0] * rest, "v": [v] + [0] * rest, "sums": [sums] + [[]] * rest})


def _exchange(sent: DataFrame, widths: list[int], order: int, unit: int, used: list[DataFrame]) -> DataFrame:
    """Replies to messages, with totals: still to be written. used: gets the tables that they are read from."""
    width = widths[0]

    def answer(p: pd.DataFrame) -> pd.DataFrame:
        lane = int(p["lane"].iloc[0])
        parts = [Entries.read(m, lane, 1, order) for m in p["message"]]
        e, place = Entries.merged(parts)
        code, other, n, v, sums = _answered(e)
        out, at = [], 0
        for x in parts:
            mine = place[at : at + len(x.key)]
            at += len(mine)
            out.append(reply(x, code[mine], other[mine]))
        del parts, e, place
        trim()
        return _replies(lane, p["src"], out, n, v, sums)

    if width == 1:
        return sent.groupBy("lane").applyInPandas(answer, REPLIES)
    table = scratch.written(sent, "lm-messages", big=True)
    size, lanes = table.agg(F.sum(F.octet_length("message")), F.count_distinct("lane")).first()
    batches = max(1, math.ceil((size or 0) / max(1, lanes) / unit))
    sent = table.withColumn("unit", F.concat_ws(":", "lane", F.pmod(F.xxhash64("src"), F.lit(batches))))

    def united(p: pd.DataFrame) -> tuple[list[Entries], Entries, np.ndarray]:
        parts = [Entries.read(m, int(p["lane"].iloc[0]), width, order) for m in p["message"]]
        return parts, *Entries.merged(parts)

    def finer(p: pd.DataFrame) -> pd.DataFrame:
        e = united(p)[1]
        rows = [(lane, p["unit"].iloc[0], e.message(part, widths[1])) for lane, part in e.cut(widths[1], order)]
        return pd.DataFrame(rows, columns=["lane", "src", "message"])

    def back(p: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        parts, e, place = united(p)
        code, other = _gathered(e, dict(zip(r["lane"], r["answer"], strict=True)), widths[1], order)
        out, at = [], 0
        for x in parts:
            mine = place[at : at + len(x.key)]
            at += len(mine)
            out.append(reply(x, code[mine], other[mine]))
        trim()
        return _replies(p["lane"], p["src"], out, int(r["n"].sum()), int(r["v"].sum()), [x for s in r["sums"] for x in s])

    below: list[DataFrame] = []
    found = _exchange(sent.groupBy("unit").applyInPandas(finer, SENT), widths[1:], order, unit, below)
    with scratch.swept(table.sparkSession):
        replies = scratch.written(found, "lm-replies", big=True)
    for x in below:
        scratch.dropped(x)
    used += [table, replies]
    return sent.groupBy("unit").cogroup(replies.withColumnRenamed("src", "unit").groupBy("unit")).applyInPandas(back, REPLIES)


def _gathered(e: Entries, replies: dict[int, bytes], width: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Value codes, and counts or backoff codes, of all entries."""
    code, other = np.zeros(len(e.key), np.uint16), np.zeros(len(e.key), np.int64 if e.k == 1 else np.uint16)
    for lane, part in e.cut(width, order):
        code[part], other[part] = read_reply(Entries(e.k, e.shard[part], e.key[part], e.split[part], e.count[part]), replies[lane])
    return code, other


def _plan(docs: DataFrame, parts: int, held: int, shard_tokens: int, fan: int):
    """Blocks, hot words (HOT at most), number of shards, widths of the passes."""
    blocks = tokenised(docs, parts, held)
    tokens = blocks.agg(F.sum("tokens")).first()[0] or 0
    hot = blocks.select(F.inline("hot")).groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") * HOT > tokens)
    hot = np.array(sorted(r[0] for r in hot.collect()), np.int64).view(np.uint64)
    shards = max(1, math.ceil(tokens / shard_tokens))
    return blocks, hot, shards, route.hops(shards, fan)


def _sent(blocks: DataFrame, hot: np.ndarray, shards: int, width: int, order: int, k: int) -> DataFrame:
    """The messages of order k."""

    def send(batches):
        for b in batches:
            for name, payload in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows: list[tuple] = []
                size = 0
                for lane, message in Block(payload.as_buffer(), k, hot, shards, last=True).sent(width, order):
                    rows.append((lane, name, message))
                    size += len(message)
                    if size > 4 << 20:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    def _batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.string(), pa.binary()], strict=True)], names=["lane", "src", "message"])

    return blocks.select("block", "payload").mapInArrow(send, SENT)


def levels(docs: DataFrame, order: int = 3, parts: int = 7, held: int = 2, shard_tokens: int = 1_000_000) -> DataFrame:
    """The model itself: (lane, order, level), a trie level of each shard and order as bytes that `TrieLevel` reads from a memory map."""
    blocks, hot, shards, _ = _plan(docs, parts, held, shard_tokens, 1 << 30)

    def built(p: pd.DataFrame) -> pd.DataFrame:
        lane = int(p["lane"].iloc[0])
        e, _ = Entries.merged([Entries.read(m, lane, 1, order) for m in p["message"]])
        return pd.DataFrame({"lane": [lane], "order": [e.k], "level": [build_level(e)[0]]})

    sent = reduce(DataFrame.unionAll, [_sent(blocks, hot, shards, 1, order, k) for k in range(1, order + 1)])
    return scratch.written(sent.groupBy("lane").applyInPandas(built, "lane long, order int, level binary"), "lm-levels", big=True)


def score(docs: DataFrame, order: int = 3, parts: int = 7, held: int = 2, shard_tokens: int = 1_000_000, fan: int = route.FAN, unit: int = UNIT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    blocks, hot, shards, widths = _plan(docs, parts, held, shard_tokens, fan)

    def replies():
        # One order after another, so that the messages of one don't stand on disk beside those of the next; the longest first, while there are no other replies.
        for k in range(order, 0, -1):
            used: list[DataFrame] = []
            yield _exchange(_sent(blocks, hot, shards, widths[0], order, k), widths, order, unit, used)
            for x in used:
                scratch.dropped(x)

    answers = scratch.dealt(replies(), "lm-answers", "src")
    n_all, v_all = (x or 0 for x in answers.agg(F.sum("n"), F.sum("v")).first())
    found = answers.select(F.inline("sums")).groupBy("k", "h").agg(F.sum("c").alias("c"), F.sum("t").alias("t")).collect()
    split = {k: sorted((int(np.int64(r["h"]).view(np.uint64)), r["c"], r["t"]) for r in found if r["k"] == k) for k in range(2, order + 1)}
    split = {k: (np.array([x[0] for x in v], np.uint64), np.array([x[1] for x in v], float), np.array([x[2] for x in v], float)) for k, v in split.items()}
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        replies = dict(zip(right.column("lane").to_pylist(), right.column("answer").to_pylist(), strict=True))
        for payload in left.column("payload"):
            block = Block(payload.as_buffer(), order, hot, shards)
            count = p = np.zeros(0)
            for where, inverse, e in block.levels:
                code, other = _gathered(e, replies, widths[0], order)
                direct = np.where(code > 0, 10.0 ** log10_of(code.astype(float)), 0.0)
                if e.k == 1:
                    count = other[inverse]
                    p = (direct[inverse] + v_all / (v_all + 1)) / (n_all + v_all) if v_all else np.ones(len(count))
                    continue
                weight = np.where(other > 0, 10.0 ** log10_of(other.astype(float)), 1.0)
                s, (names, c, t) = np.flatnonzero(e.split), split[e.k]
                if len(s) and len(names):
                    name = e.names()[s]
                    j = np.minimum(np.searchsorted(names, name), len(names) - 1)
                    ok, whole = (names[j] == name) & (t[j] > 0), c[j] + t[j]
                    direct[s] = np.where(ok, direct[s] / np.maximum(whole, 1), 0.0)
                    weight[s] = np.where(ok, t[j] / np.maximum(whole, 1), 1.0)
                p[where] = direct[inverse] + weight[inverse] * p[where]
            sums = [np.add.reduceat(x, block.begin) if len(block.begin) else np.zeros(0) for x in (count > 0, np.log10((count + 1) / (n_all + v_all + 1)), np.log10(p))]
            out.append(pa.table([pa.array(block.ids, pa.int64()), pa.array(block.out), pa.array(block.n.astype(np.int64)), pa.array(sums[0].astype(np.int64)), pa.array(np.full(len(block.ids), n_all, np.int64)), pa.array(sums[1]), pa.array(sums[2])], schema=schema))
        trim()
        return pa.concat_tables(out) if out else schema.empty_table()

    return blocks.select("block", "payload").groupBy("block").cogroup(answers.select(F.col("src").alias("block"), "lane", "answer").groupBy("block")).applyInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
