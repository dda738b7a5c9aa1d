"""Ridge regression from sufficient statistics: one grouped scan gives every fold, and no row leaves Spark.

Per (cell, fold) the scan sums products of features and outcome. The training statistics of a fold are the total less
the fold. Standardisation, the p x p solve and the fold's residual sums all follow from these sums, in numpy, inside
``applyInPandas`` over cells: a group holds one row per fold, however many items there are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def grams(rows: DataFrame, y: str, features: tuple[str, ...], *cell: str) -> DataFrame:
    """Sums of products of (1, features, y) per cell and ``fold``, as the flattened upper triangle ``s``."""
    terms = [F.lit(1.0), *[F.col(c).cast("double") for c in (*features, y)]]
    sums = [F.sum(a * b).alias(f"s{i}_{j}") for i, a in enumerate(terms) for j, b in enumerate(terms) if i <= j]
    found = rows.groupBy(*cell, "fold").agg(*sums)
    return found.select(*cell, "fold", F.array(*[f"s{i}_{j}" for i in range(len(terms)) for j in range(len(terms)) if i <= j]).alias("s"))


def solve(gram: np.ndarray, alpha: float) -> np.ndarray:
    """Intercept and coefficients of a ridge on features standardised by the gram itself; flat features get 0."""
    n = gram[0, 0]
    mean = gram[0] / n
    cov = gram / n - np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(cov)[1:-1], 0))
    live = scale > 1e-12
    beta = np.zeros(len(scale))
    if live.any():
        z = cov[1:-1, 1:-1][np.ix_(live, live)] / np.outer(scale[live], scale[live])
        beta[live] = np.linalg.solve(z * n + alpha * np.eye(live.sum()), n * cov[1:-1, -1][live] / scale[live]) / scale[live]
    return np.concatenate([[mean[-1] - beta @ mean[1:-1]], beta])


def square(s: np.ndarray, size: int) -> np.ndarray:
    """The symmetric matrix of a flattened upper triangle."""
    whole = np.zeros((size, size))
    whole[np.triu_indices(size)] = s
    return whole + np.triu(whole, 1).T


def out_of_fold_r2(rows: DataFrame, y: str, features: tuple[str, ...], *cell: str, alpha: float = 1.0) -> DataFrame:
    """Out-of-fold R2 and RMSE per cell; ``rows`` has ``fold``. R2 is against the mean over all rows."""
    size = len(features) + 2

    def score(frame: pd.DataFrame) -> pd.DataFrame:
        parts = [square(np.asarray(s), size) for s in frame["s"]]
        total = sum(parts)
        wrong = 0.0
        for part in parts:
            w = np.concatenate([-solve(total - part, alpha), [1.0]]) if (total - part)[0, 0] > 0 else np.eye(size)[-1]
            wrong += w @ part @ w
        n, spread = total[0, 0], total[-1, -1] - total[0, -1] ** 2 / total[0, 0]
        return pd.DataFrame([[*frame.iloc[0][list(cell)], int(n), 1 - wrong / spread if spread > 0 else None, float(np.sqrt(max(wrong, 0) / n))]], columns=[*cell, "n", "r2", "rmse"])

    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in cell), "n long, r2 double, rmse double"])
    return grams(rows, y, features, *cell).groupBy(*cell).applyInPandas(score, schema)
