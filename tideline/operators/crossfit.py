"""Out-of-fold predictions of a weighted ridge, from moments of folds.

Components fall in folds by a hash, and whole. The model of a fold may see the other folds only; among those, a nested
hash sets components aside by which the penalty is chosen. All these fits need sums of products alone: of each fold,
and of what each fold's inner validation holds. They are made in one aggregation; a fit without a fold is the total
less that fold's sums, and a validation error is a quadratic form of the inner ones. Only matrices of the number of
predictors, per fold, reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.operators.running import fold_of


@dataclass
class Fit:
    fold: int
    rows: int
    inner_rows: int
    penalty: float
    inner_error: float
    coefficients: np.ndarray


def solve(m: np.ndarray, penalty: float) -> np.ndarray:
    """[intercept, slopes] of the ridge on standardised predictors; m has the weighted sums of products of (1, x, y)."""
    total = m[0, 0]
    mean = m[0, 1:-1] / total
    cov = m[1:-1, 1:-1] / total - np.outer(mean, mean)
    scale = np.maximum(np.sqrt(np.maximum(np.diag(cov), 0)), 1e-12)
    target = m[1:-1, -1] / total - mean * m[0, -1] / total
    slopes = np.linalg.solve(cov / np.outer(scale, scale) + penalty / total * np.eye(len(scale)), target / scale) / scale
    return np.concatenate([[m[0, -1] / total - slopes @ mean], slopes])


def squared_error(m: np.ndarray, beta: np.ndarray) -> float:
    """Weighted mean squared error of beta on the rows behind m."""
    v = np.append(beta, -1.0)
    return float(v @ m @ v / m[0, 0])


def fold_columns(component: Column | str, folds: int, inner_folds: int, seed: int) -> tuple[Column, Column]:
    """The fold of a component, and the folds whose inner validation it belongs to."""
    own = fold_of(component, seed, folds)
    inner = F.array(*(F.when((own != f) & (fold_of(component, seed ^ (f + 101), inner_folds) == 0), F.lit(f)) for f in range(folds)))
    return own, F.filter(inner, lambda f: f.isNotNull())


def fits(df: DataFrame, x: Sequence[str], y: str, w: str, folds: int, penalties: Sequence[float]) -> list[Fit]:
    """A fit per fold of df(fold, inner, x.., y, w): penalty by its inner validation, coefficients from all other folds."""
    if folds < 2:
        raise ValueError("out-of-fold fits need two folds at least")
    cols = [F.lit(1.0), *(F.col(c).cast("double") for c in x), F.col(y).cast("double")]
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    roles = F.concat(F.array(F.struct(F.lit(False).alias("inner"), F.col("fold").cast("int").alias("fold"))), F.transform("inner", lambda f: F.struct(F.lit(True).alias("inner"), f.cast("int").alias("fold"))))
    values = df.select(F.explode(roles).alias("r"), F.col(w).cast("double").alias("w"), *(c.alias(f"c{i}") for i, c in enumerate(cols)))
    sums = values.groupBy("r").agg(F.count("*").alias("n"), *(F.sum(F.col("w") * F.col(f"c{i}") * F.col(f"c{j}")).alias(f"m_{i}_{j}") for i, j in pairs)).collect()  # two rows a fold
    moments, rows = np.zeros((2, folds, len(cols), len(cols))), np.zeros((2, folds), int)
    for r in sums:
        at = int(r["r"]["inner"]), r["r"]["fold"]
        rows[at] = r["n"]
        for i, j in pairs:
            moments[at][i, j] = moments[at][j, i] = r[f"m_{i}_{j}"] or 0.0
    out = []
    for f in range(folds):
        pool, inner = moments[0].sum(0) - moments[0][f], moments[1][f]
        train = pool - inner
        if not (rows[0][f] and rows[1][f] and rows[0].sum() - rows[0][f] - rows[1][f]):
            raise ValueError(f"fold {f} is empty, or has no rows to fit or to validate by")
        errors = [squared_error(inner, solve(train, p)) for p in penalties]
        best = int(np.argmin(errors))
        out.append(Fit(f, int(rows[0].sum() - rows[0][f]), int(rows[1][f]), float(penalties[best]), errors[best], solve(pool, penalties[best])))
    return out


def out_of_fold(df: DataFrame, component: str, x: Sequence[str], y: str, w: str, folds: int = 5, inner_folds: int = 10, seed: int = 17, penalties: Sequence[float] = (0.0, 1.0, 100.0)) -> tuple[DataFrame, list[Fit]]:
    """df with fold and prediction (by the model that has not seen the row's component), and the fits.

    Every row gets exactly one prediction, by its fold: nothing is joined. A null component, predictor, target or weight
    is an error of the caller.
    """
    own, inner = fold_columns(component, folds, inner_folds, seed)
    placed = df.join(df.select(component).distinct().select(component, own.alias("fold"), inner.alias("inner")), component)
    models = fits(placed, x, y, w, folds, penalties)
    return predict(placed.drop("inner"), models, x), models


def predict(df: DataFrame, models: Sequence[Fit], x: Sequence[str], fold: str = "fold") -> DataFrame:
    """Adds prediction by the model of the row's fold."""

    def coefficient(i: int) -> Column:
        return F.get(F.array(*(F.lit(float(m.coefficients[i])) for m in models)), F.col(fold).cast("int"))

    total = coefficient(0)
    for i, c in enumerate(x, 1):
        total = total + coefficient(i) * F.col(c)
    return df.withColumn("prediction", total)
