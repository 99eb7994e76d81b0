"""Quality by positive-unlabelled learning with the non-negative risk estimator.

Trusted positives are documents labelled 1; the unlabelled set is web text of any
kind, drawn without looking at labels. With class prior p and logistic loss l, the
risk p E+[l(f)] + max(0, EU[l(-f)] - p E+[l(-f)]) is minimised by full-batch Adam;
where the second part would turn negative, the step ascends on it instead. The model
is linear in surface features of the text: shares of character kinds and of odd
tokens, repetition and lengths, with squares.

The prior is estimated from data: on held-back rows, the least ratio of the share of
unlabelled to that of positive rows under thresholds of a first model, which is
trained with a prior of one half; labelled negatives play no part in training.

Training reads whole texts where they lie; a row of features for each of a bounded
number of documents comes back. Null text counts as empty; a very long text is one
value of one task. Ties, repeated rows and extra columns make no difference. Rows with
null labels are not learned from; without positives every score is 0, and the pipeline's
stage rejects nothing. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labelled, shingles
from .memory import trim

_PUNCT = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def features(text: str | None) -> np.ndarray:
    raw = (text or "").encode()
    n = max(1, len(raw))
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / n
    words = raw.split()
    m = max(1, len(words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    kinds = set(words)
    upper = sum(w.isupper() and len(w) > 1 for w in kinds) / max(1, len(kinds))
    same = sum(map(bytes.__eq__, words, words[1:])) / m
    odd = sum(not w[-1:].isalnum() and not w[-2:-1].isalnum() and len(w) > 2 and w[-1] < 128 and w[-2] < 128 for w in kinds) / max(1, len(kinds))
    alone = sum(len(w) == 1 and not w.isalnum() and w[0] < 128 for w in words) / m
    shapes = [hist[65:91].sum(), hist[97:123].sum(), hist[48:58].sum(), hist[128:].sum(), hist[32], hist[10]]
    rest = [len(words) / n * 4, len(kinds) / m, same, upper, odd, alone, len(set(lines)) / max(1, len(lines)), np.log1p(len(words)) / 10, float(not words)]
    x = np.concatenate([np.sqrt(hist[list(_PUNCT)]) * 3, shapes, rest])
    return np.concatenate([x, np.sqrt([same, upper, odd, alone]), [len(kinds) / m * np.log1p(len(words)) / 10, 1.0]])


def _loss(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, -z)


def nnpu(pos: np.ndarray, unl: np.ndarray, prior: float, steps: int = 600, rate: float = 0.05, ridge: float = 1e-4) -> np.ndarray:
    """Weights that minimise the non-negative unbiased risk."""
    w = np.zeros(pos.shape[1])
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        fp, fu = pos @ w, unl @ w
        sp, su = 1 / (1 + np.exp(-np.clip(fp, -30, 30))), 1 / (1 + np.exp(-np.clip(fu, -30, 30)))
        negative = _loss(-fu).mean() - prior * _loss(-fp).mean()
        g_neg = unl.T @ su / len(unl) - prior * (pos.T @ sp) / len(pos)
        g = prior * (pos.T @ (sp - 1)) / len(pos) + g_neg if negative >= 0 else -g_neg
        g = g + ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def prior_of(pos: np.ndarray, unl: np.ndarray, least: float = 0.05) -> float:
    """Least ratio of the unlabelled to the positive share above a threshold: only positives lie there at best. Thresholds that keep less than `least` of the positives are too noisy."""
    cuts = np.quantile(pos, np.linspace(0, 1 - least, 60))
    up, uu = np.array([(pos >= c).mean() for c in cuts]), np.array([(unl >= c).mean() for c in cuts])
    noise = np.sqrt(uu * (1 - uu) / len(unl) + up * (1 - up) / len(pos))
    return float(np.clip(np.min((uu + noise) / up), 0.02, 0.98))


def fit(p: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Centre, scale, weights, prior, from the features of positive and of unlabelled texts."""
    centre, scale = u.mean(0), u.std(0) + 1e-3
    centre[-1], scale[-1] = 0, 1
    p, u = np.clip((p - centre) / scale, -8, 8), np.clip((u - centre) / scale, -8, 8)
    first = nnpu(p[::2], u[::2], 0.5, steps=200)
    back = (p[1::2], u[1::2]) if len(p) > 1 and len(u) > 1 else (p, u)
    prior = prior_of(back[0] @ first, back[1] @ first)
    return centre, scale, nnpu(p, u, prior), prior


def scores_of(texts: list, model) -> np.ndarray:
    centre, scale, w, _ = model
    x = np.clip((np.array([features(t) for t in texts]) - centre) / scale, -8, 8)
    return 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))


def score(docs: DataFrame, model, threshold: float, keep_columns: bool = False, parts: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted; or, with keep_columns, the input's rows that are not rejected, unchanged."""
    if keep_columns:

        def keep(batches):
            for b in batches:
                if b.num_rows:
                    s, text = np.zeros(b.num_rows), b.column(b.schema.get_field_index("text"))
                    for at, texts in shingles.slices(text) if model is not None else ():
                        s[at : at + len(texts)] = scores_of(texts.to_pylist(), model)
                    yield b.filter(pa.array(s >= threshold))
                    del b, text
                    trim()

        return docs.mapInArrow(keep, docs.schema)

    def run(batches):
        for b in batches:
            if b.num_rows:
                s = np.zeros(b.num_rows)
                for at, texts in shingles.slices(b.column(1)) if model is not None else ():
                    s[at : at + len(texts)] = scores_of(texts.to_pylist(), model)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    flag = F.coalesce(labelled.fold("doc_id", parts) == held, F.lit(False)).alias("h")
    return docs.select(F.col("doc_id").cast("long"), "text", flag).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def _measured(rows: DataFrame) -> np.ndarray:
    """Features of the rows' whole texts, worked out where they lie; a bounded number of rows."""

    def run(batches):
        for b in batches:
            for at, texts in shingles.slices(b.column(1)):
                x = [features(t) for t in texts.to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])

    kind = dict(rows.dtypes)["doc_id"]
    found = rows.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, x array<double>").orderBy(F.xxhash64("doc_id"), "doc_id", "x").select("x").collect()
    return np.array([r[0] for r in found])


def train(docs: DataFrame, labels: DataFrame, positives: int = 4000, unlabelled: int = 8000, parts: int = 5, held: int = 0):
    """Learns from at most so many positive and unlabelled documents, none of the held-out fold. None if there are no positives."""
    pos = _measured(labelled.sample(docs, labels.where((labelled.fold("doc_id", parts) != held) & (F.col("quality") == 1)), positives))
    unl = _measured(labelled.sample(docs, docs.where(labelled.fold("doc_id", parts) != held), unlabelled, listed=False))
    return fit(pos, unl) if len(pos) and len(unl) else None


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **limits) -> DataFrame:
    return score(docs, train(docs, labels, **limits), threshold)
