"""Out-of-fold ridge regressions on numbers and categories, many feature sets at once.

Missing numbers become the median of the training folds, numbers are scaled by the training folds, categories are columns
of 0 and 1 under one dictionary for all folds. One pass gives the sums of products of all columns per cell and fold held
out; every feature set is a part of these, solved from it. A second pass applies all solutions and adds up the errors,
which gives the mean absolute error too. Tasks return one matrix per cell and fold, whatever their rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewell.sources.files import cut

#: Different values that all categories together may have; they are columns of the models.
MOST_CATEGORIES = 500


def dictionary(rows: DataFrame, categorical: tuple[str, ...]) -> list[tuple[str, str]]:
    """(column, value) of every category, in order; null is the value "None". ValueError past :data:`MOST_CATEGORIES`."""
    if not categorical:
        return []
    each = F.array(*[F.struct(F.lit(c).alias("c"), F.coalesce(F.col(c).cast("string"), F.lit("None")).alias("v")) for c in categorical])
    found = rows.select(F.inline(each)).distinct().limit(MOST_CATEGORIES + 1).collect()
    if len(found) > MOST_CATEGORIES:
        raise ValueError(f"more than {MOST_CATEGORIES} categories in {categorical}")
    return sorted((r.c, r.v) for r in found)


def solve(gram: np.ndarray, columns: list[int], scaled: int, alpha: float) -> np.ndarray:
    """Weights of all columns (1, features; those not in ``columns`` get 0) for the outcome, which is the last of ``gram``.

    Features before column ``scaled`` are standardised; the constant is not penalised.
    """
    n, mean = gram[0, 0], gram[0] / gram[0, 0]
    cov = gram / n - np.outer(mean, mean)
    scale = np.where(np.arange(len(gram)) < scaled, np.sqrt(np.maximum(np.diag(cov), 0)), 1.0)
    live = [c for c in columns if cov[c, c] > 1e-12]
    w = np.zeros(len(gram) - 1)
    if live:
        s = scale[live]
        w[live] = np.linalg.solve(n * cov[np.ix_(live, live)] / np.outer(s, s) + alpha * np.eye(len(live)), n * cov[live, -1] / s) / s
    w[0] = mean[-1] - w[1:] @ mean[1:-1]
    return w


def out_of_fold(rows: DataFrame, y: str, numeric: tuple[str, ...], categorical: tuple[str, ...], sets: dict[str, tuple[str, ...]], *cell: str, alpha: float = 1.0, folds: int = 5) -> DataFrame:
    """Per cell and set of ``sets`` (its numeric features; all have the categories): ``spec``, ``n``, ``r2``, ``rmse``, ``mae``.

    ``rows`` has ``fold`` from 0 to ``folds`` - 1. Rows without an outcome are left out; R2 is against the mean of all rows,
    null where the outcome does not vary.
    """
    rows = cut(rows.where(F.col(y).isNotNull()).select(*cell, "fold", F.col(y).cast("double").alias("_y"), *[F.col(c).cast("double").alias(c) for c in numeric], *[F.col(c).cast("string").alias(c) for c in categorical]))
    levels = dictionary(rows, categorical)
    others = F.explode(F.filter(F.array(*[F.lit(k) for k in range(folds)]), lambda k: k != F.col("fold"))).alias("_k")
    medians = rows.select("*", others).groupBy(*cell, "_k").agg(*[F.coalesce(F.percentile(c, F.lit(0.5)), F.lit(0.0)).alias(f"_m{i}") for i, c in enumerate(numeric)])
    filled = [F.coalesce(c, f"_m{i}").alias(c) for i, c in enumerate(numeric)]
    held = rows.select("*", F.explode(F.array(*[F.lit(k) for k in range(folds)])).alias("_k")).join(F.broadcast(cut(medians)), [*cell, "_k"])  # a row per cell and fold
    held = held.select(*cell, "_k", "fold", "_y", *filled, *categorical)
    size, kinds = 2 + len(numeric) + len(levels), dict(rows.dtypes)
    fields = ", ".join(f"{c} {kinds[c]}" for c in cell)
    keys = [*cell, "_k"]

    def matrix(frame: pd.DataFrame) -> np.ndarray:
        texts = {c: frame[c].fillna("None") for c in categorical}
        ones = [(texts[c] == v).to_numpy(float) for c, v in levels]
        return np.column_stack([np.ones(len(frame)), frame[list(numeric)].to_numpy(float), *ones, frame["_y"].to_numpy(float)])

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        for frame in frames:
            for name, part in frame.groupby(keys, sort=True):
                x = matrix(part)
                sums[name] = sums.get(name, 0) + x.T @ x
        for name, total in sums.items():
            yield pd.DataFrame([[*name, total.ravel()]], columns=[*keys, "gram"])

    chosen = {name: [1 + numeric.index(c) for c in features] + list(range(1 + len(numeric), size - 1)) for name, features in sets.items()}

    def fitted(frame: pd.DataFrame) -> pd.DataFrame:
        gram = np.sum(np.stack(frame["gram"].to_list()), axis=0).reshape(size, size)
        weights = [solve(gram, columns, 1 + len(numeric), alpha) for columns in chosen.values()]
        return pd.DataFrame([[*frame.iloc[0][keys], np.concatenate(weights)]], columns=[*keys, "weights"])

    grams = held.where("fold <> _k").mapInPandas(partial, f"{fields}, _k int, gram array<double>")
    models = cut(grams.groupBy(*keys).applyInPandas(fitted, f"{fields}, _k int, weights array<double>"))

    def errors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, part in frame.groupby(list(cell), sort=True):
                x = matrix(part)
                w = np.stack(part["weights"].to_list()).reshape(len(part), len(chosen), size - 1)
                off = x[:, -1:] - np.einsum("ij,isj->is", x[:, :-1], w)
                yield pd.DataFrame([[*name, spec, len(part), float((off[:, i] ** 2).sum()), float(np.abs(off[:, i]).sum())] for i, spec in enumerate(chosen)], columns=[*cell, "spec", "n", "squares", "off"])

    tested = held.where("fold = _k").join(F.broadcast(models), keys)  # a row per cell and fold
    sums = tested.mapInPandas(errors, f"{fields}, spec string, n long, squares double, off double").groupBy(*cell, "spec").agg(F.sum("n").alias("n"), F.sum("squares").alias("squares"), F.sum("off").alias("off"))
    spread = rows.groupBy(*cell).agg((F.var_pop("_y") * F.count(F.lit(1))).alias("spread"))
    r2 = F.when(F.col("spread") > 0, 1 - F.col("squares") / F.col("spread"))
    return sums.join(spread, list(cell)).select(*cell, "spec", "n", r2.alias("r2"), F.sqrt(F.col("squares") / F.col("n")).alias("rmse"), (F.col("off") / F.col("n")).alias("mae"))


def increments(found: DataFrame, base: str, *cell: str) -> DataFrame:
    """``found`` of :func:`out_of_fold` with the gain of each set over ``base`` in R2, RMSE and MAE."""
    own = found.where(F.col("spec") == base).select(*cell, *[F.col(c).alias(f"_{c}") for c in ("r2", "rmse", "mae")])
    return found.join(own, list(cell)).select(*found.columns, *[(F.col(c) - F.col(f"_{c}")).alias(f"delta_{c}") for c in ("r2", "rmse", "mae")])
