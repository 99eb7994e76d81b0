"""Learned combiners in place of the weighted mean.

Any object with `predict(matrix) -> raw scores` can be registered; where none is
there, or it can't be loaded, the weighted mean stands in. `train_pointwise` fits
boosted regression trees to grades: a pointwise learner, not a listwise one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexicons import WEIGHTS
from .scoring import combined

_MODELS: dict[str, object] = {}


def register(name: str, load: Callable[[], object]) -> bool:
    """Whether the model could be loaded; never raises."""
    try:
        _MODELS[name] = load()
    except Exception:  # noqa: BLE001  the fallback is the defined outcome
        _MODELS.pop(name, None)
    return name in _MODELS


def available(name: str) -> bool:
    return name in _MODELS


def feature_vector() -> Column:
    """The composite features in order; a missing one is NaN."""
    return F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))) for f in WEIGHTS])


def predicted(name: str) -> Column:
    """Sigmoid of the model's raw score, or the weighted mean."""
    if name not in _MODELS:
        return combined()
    model = _MODELS[name]

    @F.pandas_udf("double")
    def run(v):
        import numpy as np
        import pandas as pd

        x = np.stack(v.to_numpy()) if len(v) else np.zeros((0, len(WEIGHTS)))
        return pd.Series(1 / (1 + np.exp(-np.clip(np.asarray(model.predict(x), float), -60, 60))))

    return run(feature_vector())


def training_set(cache: DataFrame, parts: DataFrame, anchors: DataFrame, ident: str = "candidate_id") -> DataFrame:
    """Graded train rows and, as grade 0, ungraded ones; validation rows and anchors are left out; in order of id."""
    gone = parts.where("part = 'val'").select(ident).union(anchors.select(ident)).distinct()
    x = cache.join(gone, ident, "left_anti").join(parts.where("part = 'train'").select(ident, "grade"), ident, "left")
    return x.withColumn("grade", F.coalesce("grade", F.lit(0.0))).orderBy(ident)


def train_pointwise(rows: DataFrame, rounds: int = 50, depth: int = 4):
    """A fitted pipeline model; apply it with `transform`. A missing feature is -1, below all that are there, so that the trees can tell it."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import SQLTransformer, VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    cols = list(WEIGHTS)
    x = rows.select("grade", *[F.col(c).cast("double").alias(c) for c in cols])
    return Pipeline(stages=[SQLTransformer(statement="SELECT *, " + ", ".join(f"coalesce(cast({c} AS double), -1.0D) AS {c}_" for c in cols) + " FROM __THIS__"), VectorAssembler(inputCols=[f"{c}_" for c in cols], outputCol="features"), GBTRegressor(labelCol="grade", maxIter=rounds, maxDepth=depth, seed=42)]).fit(x)


def adopt(model_val: float, baseline_val: float, least_gain: float = 0.0) -> bool:
    return model_val - baseline_val > least_gain
