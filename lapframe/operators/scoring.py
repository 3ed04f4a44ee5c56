"""Scores of fitted models: any object with ``predict``, over batches of rows in the workers.

A linear model with its scaler is fitted here from sums that Spark gathers in one pass;
models fitted elsewhere need no more than ``predict(X)``, and scalers ``transform(X)``.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a vehicle model is given, in this order.
MODEL_FEATURES = ("az_mps2", "ax_mps2", "v_mps", "beta_rad", "delta_f_rad")
MOST_MODEL_BYTES = 256 << 20


@dataclass(frozen=True)
class Scaler:
    """Columns less their means, over their standard deviations (a constant column stays at zero)."""

    means: tuple[float, ...]
    deviations: tuple[float, ...]

    def transform(self, x: np.ndarray) -> np.ndarray:
        spread = np.array(self.deviations)
        return (x - np.array(self.means)) / np.where(spread > 0, spread, 1.0)


@dataclass(frozen=True)
class LinearModel:
    weights: tuple[float, ...]
    intercept: float

    def predict(self, x: np.ndarray) -> np.ndarray:
        return x @ np.array(self.weights) + self.intercept


def fit_linear(df: DataFrame, features: Sequence[str], target: str) -> tuple[LinearModel, Scaler]:
    """Least squares of ``target`` over the scaled features, from the rows in which none of them is NULL.

    One aggregation gives means and covariances, so the driver sees (k + 1)² numbers. Features that depend on
    each other share their weight (the shortest solution).
    """
    names = [*features, target]
    known = df.select(*[F.col(f"`{c}`").cast("double").alias(f"x{k}") for k, c in enumerate(names)]).dropna()
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    got = known.agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"x{k}").alias(f"m{k}") for k in range(len(names))], *[F.covar_pop(f"x{i}", f"x{j}").alias(f"c{i}_{j}") for i, j in pairs]).first()
    if not got["n"]:
        raise ValueError("no rows with all features and the target")
    cov = np.array([[got[f"c{min(i, j)}_{max(i, j)}"] for j in range(len(names))] for i in range(len(names))])
    k = len(features)
    spread = np.sqrt(np.diag(cov)[:k])
    unit = np.where(spread > 0, spread, 1.0)
    weights = np.linalg.lstsq(cov[:k, :k] / np.outer(unit, unit), cov[:k, k] / unit, rcond=1e-12)[0]
    return LinearModel(tuple(weights.tolist()), got[f"m{k}"]), Scaler(tuple(got[f"m{i}"] for i in range(k)), tuple(spread.tolist()))


def score(df: DataFrame, model, scaler=None, features: Sequence[str] = MODEL_FEATURES, name: str = "score", most_bytes: int = MOST_MODEL_BYTES) -> DataFrame:
    """``df`` with what the model predicts as ``name``; NULL where a feature is NULL or not a finite number.

    Model and scaler are broadcast, so a worker loads them once; larger ones than ``most_bytes`` are refused.
    """
    size = len(pickle.dumps((model, scaler)))
    if size > most_bytes:
        raise ValueError(f"the model takes {size} bytes, more than {most_bytes}")
    held = df.sparkSession.sparkContext.broadcast((model, scaler))

    @F.pandas_udf("double")
    def predicted(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        fitted, scaled = held.value
        for columns in batches:
            x = np.column_stack([c.to_numpy(float, na_value=np.nan) for c in columns])
            whole, out = np.isfinite(x).all(axis=1), np.full(len(x), np.nan)
            if whole.any():
                rows = x[whole]
                out[whole] = np.asarray(fitted.predict(rows if scaled is None else scaled.transform(rows)), float).ravel()
            yield pd.Series(out)

    value = predicted(*[F.col(f"`{c}`").cast("double") for c in features])
    return df.withColumn(name, value).withColumn(name, F.when(~F.isnan(F.col(f"`{name}`")), F.col(f"`{name}`")))
