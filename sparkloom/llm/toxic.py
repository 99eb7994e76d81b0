"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on windows of toxic text and one on windows
of ordinary text. A window is `WORDS` successive words of the running text. It is
compressed with either dictionary, between two copies of a lead that both hold; the
lead costs either side the same and pays for the sequence that a match needs. How many
bytes shorter the toxic dictionary makes the window is its distance.

Most windows of a toxic document are ordinary ones, so the toxic dictionary is trained
in rounds. Two thirds of the labelled documents train dictionaries of their own, at
first on all their windows. Then the windows of either third are judged with the
dictionaries of the other, which have not seen them; those of toxic documents beyond the
`quantile` of those of ordinary documents train the third's next toxic dictionary. The
last one is trained on what both thirds have kept.

The thresholds are calibrated on distances by dictionaries that have not seen the
document, the last ones for the remaining third: the share of ordinary windows at or
beyond each distance, and the weights of a logistic function of the numbers of windows
there, against what their shares let expect, in which toxic documents weigh `prior` of
the whole, however many there are.

Training reads whole texts where they lie: executors send back at most `samples`
windows a class (those of the least hash) for each dictionary, and a row of features
for each labelled document. Scoring reads every window of every text, each word once.

Null text counts as empty: no windows, all features 0. A very long text is one list of
words of one task. Ties, repeated rows and extra columns make no difference. Rows with
null labels are not learned from; if either class has no row, every score is the share
of toxic labels (0 without any). An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import labelled, scratch, shingles

LEAD = bytes(range(1, 25))
WORDS = 2
STEPS = np.arange(1, 8)  # distances at which windows are counted
MOST = 40


def windows(text: str | None, step: int) -> Iterator[bytes]:
    """WORDS words from every `step`-th word on; the last window may be shorter."""
    words = (text or "").lower().encode().split()
    return (b" ".join(words[a : a + WORDS]) for a in range(0, len(words), step))


class Distance:
    """Bytes by which the toxic dictionary makes a window shorter than the ordinary one does."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self._sides = []
        for d in (toxic, ordinary):
            p = zstd.ZstdCompressionParameters.from_level(12, source_size=128, dict_size=len(d), min_match=4, strategy=zstd.STRATEGY_GREEDY, format=zstd.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0)
            self._sides.append(zstd.ZstdCompressor(dict_data=zstd.ZstdCompressionDict(d + LEAD, dict_type=zstd.DICT_TYPE_RAWCONTENT), compression_params=p).compress)

    def __call__(self, window: bytes) -> int:
        x = LEAD + b" " + window + b" " + LEAD
        return len(self._sides[1](x)) - len(self._sides[0](x))

    def of(self, text: str | None, step: int) -> np.ndarray:
        return np.fromiter((self(w) for w in windows(text, step)), np.int64)


def features(d: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Of a text's distances: numbers of windows at or beyond each step, as they are and against what the shares let expect, the three largest, the mean."""
    if not len(d):
        return np.concatenate([[1.0], np.zeros(3 + 2 * len(STEPS))])
    n = (d[:, None] >= STEPS).sum(0)
    much = (n - len(d) * shares) / np.sqrt(len(d) * shares + 0.5)
    return np.concatenate([[1.0, np.sort(d)[-3:].sum() / 20, np.log1p(len(d)), d.mean()], np.log1p(n), np.sign(much) * np.log1p(np.abs(much))])


def logistic(x: np.ndarray, y: np.ndarray, prior: float, ridge: float = 0.1, steps: int = 40) -> np.ndarray:
    """Newton's method for ridge logistic regression; rows of y = 1 weigh `prior` of the whole."""
    w, each = np.zeros(x.shape[1]), len(y) * np.where(y == 1, prior / max(1, y.sum()), (1 - prior) / max(1, (1 - y).sum()))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (each * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w + np.linalg.solve(h, x.T @ (each * (y - p)) - ridge * w)
    return w


@dataclass(frozen=True)
class ToxicModel:
    toxic: bytes
    ordinary: bytes
    shares: tuple[float, ...]
    weights: tuple[float, ...]

    def scores(self, texts, distance: Distance) -> np.ndarray:
        shares = np.array(self.shares)
        x = np.array([features(distance.of(t, WORDS), shares) for t in texts]).reshape(-1, len(self.weights))
        return 1 / (1 + np.exp(-np.clip(x @ np.array(self.weights), -30, 30)))


def _dictionary(found: list[bytes], size: int) -> bytes:
    try:
        return zstd.train_dictionary(size, found, level=3, k=64, d=8).as_bytes()
    except zstd.ZstdError:  # too little to train on
        return b" ".join(found)[:size].ljust(8, b" ")


def _some(rows: DataFrame, n: int, dicts: list[tuple[bytes, bytes]] | None = None, beyond: list[int] | None = None) -> list[list[bytes]]:
    """For thirds 0 and 1, the n windows of least hash of the rows' texts; with dictionaries of both given, those that the other third's find beyond a distance."""

    def run(frames):
        measures = [Distance(*d) for d in dicts] if dicts else None
        for p in frames:
            out = []
            for k in (0, 1):
                best: dict[bytes, int] = {}
                for t in p["text"][p["third"] == k]:
                    found = set(windows(t, 1))
                    best |= {w: xxhash.xxh3_64_intdigest(w) >> 1 for w in found if measures is None or measures[1 - k](w) > beyond[k]}
                    if len(best) > 4 * n:
                        best = dict(sorted(best.items(), key=lambda x: (x[1], x[0]))[:n])
                out += [(k, h, w) for w, h in sorted(best.items(), key=lambda x: (x[1], x[0]))[:n]]
            yield pd.DataFrame(out, columns=["third", "h", "w"]).astype({"third": "int32", "h": "int64"})

    found = rows.select("third", "text").mapInPandas(run, "third int, h long, w binary").distinct()
    nth = F.row_number().over(Window.partitionBy("third").orderBy("h", "w"))
    out: list[list[bytes]] = [[], []]
    for k, w in found.withColumn("nth", nth).where(F.col("nth") <= n).orderBy("third", "nth").select("third", "w").collect():
        out[k].append(bytes(w))
    return out


def _histograms(rows: DataFrame, dicts: list[tuple[bytes, bytes]], step: int) -> list[np.ndarray]:
    """For each third, numbers of the rows' windows by distance, from -MOST to MOST; third k is judged with dicts[k]."""

    def run(frames):
        measures = [Distance(*d) for d in dicts]
        for p in frames:
            out = []
            for k, measure in enumerate(measures):
                n = np.zeros(2 * MOST + 1, np.int64)
                for t in p["text"][p["third"] == k]:
                    n += np.bincount(np.clip(measure.of(t, step), -MOST, MOST) + MOST, minlength=2 * MOST + 1)
                out.append(pd.DataFrame({"third": k, "d": np.arange(-MOST, MOST + 1), "n": n}))
            yield pd.concat(out)

    out = [np.zeros(2 * MOST + 1, np.int64) for _ in dicts]
    for k, d, n in rows.select("third", "text").mapInPandas(run, "third int, d int, n long").groupBy("third", "d").agg(F.sum("n")).collect():
        out[k][d + MOST] = n
    return out


def train(docs: DataFrame, labels: DataFrame, per_class: int = 3000, parts: int = 3, held: int = 1, dict_bytes: int = 112_640, samples: int = 12_000, quantile: float = 0.999, rounds: int = 2, prior: float = 0.25) -> ToxicModel | float:
    """Learns from at most `per_class` documents of either label, none of the held-out fold."""
    seen = labels.where((labelled.fold("doc_id", parts) != held) & F.col("toxic").isin(0, 1)).select("doc_id", "toxic").distinct()
    both = [labelled.sample(docs, seen.where(F.col("toxic") == y), per_class).withColumn("y", F.lit(y)) for y in (0, 1)]
    rows = both[0].unionByName(both[1]).withColumn("third", F.pmod(F.xxhash64("doc_id", F.lit("third")), F.lit(3)).cast("int"))
    rows = scratch.written(rows.repartition(8, "doc_id"), "toxic-sample")
    have = {r[0]: r[1] for r in rows.groupBy("y").count().collect()}
    if not have.get(0) or not have.get(1):
        return float(bool(have.get(1)))
    toxic, ordinary = rows.where("y = 1 and third < 2"), rows.where("y = 0 and third < 2")
    plain, kept = _some(ordinary, samples), _some(toxic, samples)
    plains = [_dictionary(x, dict_bytes) for x in plain]
    toxics = [_dictionary(x, dict_bytes) for x in kept]
    for _ in range(rounds):
        dicts = list(zip(toxics, plains, strict=True))
        beyond = [int(np.searchsorted(np.cumsum(n), quantile * n.sum())) - MOST for n in _histograms(ordinary, dicts[::-1], 1)]
        kept = _some(toxic, samples, dicts, beyond)
        toxics = [_dictionary(x, dict_bytes) if len(x) >= 20 else t for x, t in zip(kept, toxics, strict=True)]
    last = [_dictionary(list(dict.fromkeys([*x[0], *x[1]])), dict_bytes) for x in (kept, plain)]
    pair = last[0], last[1]
    # Every document is measured with dictionaries that have not seen it.
    judges = [*list(zip(toxics, plains, strict=True))[::-1], pair]
    shares = [np.array([n[MOST + s :].sum() for s in STEPS]) / max(1, n.sum()) for n in _histograms(rows.where("y = 0"), judges, WORDS)]

    def measured(frames):
        distances = [Distance(*d) for d in judges]
        for p in frames:
            yield pd.DataFrame({"doc_id": p["doc_id"], "y": p["y"], "x": [features(distances[k].of(t, WORDS), shares[k]) for k, t in zip(p["third"], p["text"], strict=True)]})

    kind = dict(rows.dtypes)["doc_id"]
    known = rows.select("doc_id", "y", "third", "text").mapInPandas(measured, f"doc_id {kind}, y int, x array<double>").orderBy("doc_id", "y", "x").select("y", "x").collect()
    if len({r[0] for r in known}) < 2:  # too few rows to calibrate on
        return have[1] / (have[0] + have[1])
    w = logistic(np.array([r[1] for r in known]), np.array([float(r[0]) for r in known]), prior)
    return ToxicModel(*pair, tuple(map(float, shares[2])), tuple(map(float, w)))


def score(docs: DataFrame, model: ToxicModel | float, threshold: float, parts: int, held: int) -> DataFrame:
    schema = "doc_id long, held_out boolean, score double, predicted int"

    def run(batches):
        distance = Distance(model.toxic, model.ordinary) if isinstance(model, ToxicModel) else None
        for b in batches:
            s = np.full(b.num_rows, 0.0 if distance else float(model))
            for at, texts in shingles.slices(b.column(1)) if distance else ():
                s[at : at + len(texts)] = model.scores(texts.to_pylist(), distance)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), "text", F.coalesce(labelled.fold("doc_id", parts) == held, F.lit(False)).alias("h")).mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, parts: int = 3, held: int = 1, **limits) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text."""
    return score(docs, train(docs, labels, parts=parts, held=held, **limits), threshold, parts, held)
