"""Isotonic regression of any number of points per cell, by pooling adjacent violators in two steps.

Pooled blocks can be pooled again: what a range of the values pools to, merged with what its neighbours pool to, is what
the whole pools to. So each range of a cell, bounded by buckets of the values, is pooled in a task of its own, and the
blocks that are left, a small share of noisy data, are pooled once more per cell.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewell.operators.ranking import bucket_of
from gaugewell.sources.files import cut

#: Groups that the points of a cell are dealt into when they are given their fitted values.
SALTS = 16


def pool(low: np.ndarray, high: np.ndarray, weight: np.ndarray, total: np.ndarray) -> list[tuple[float, float, float, float]]:
    """Blocks (first value, last value, weight, sum) of non-decreasing means out of blocks in the order of their values."""
    kept: list[tuple[float, float, float, float]] = []
    for block in zip(low.tolist(), high.tolist(), weight.tolist(), total.tolist(), strict=True):
        while kept and kept[-1][3] * block[2] >= block[3] * kept[-1][2]:
            last = kept.pop()
            block = (last[0], block[1], last[2] + block[2], last[3] + block[3])
        kept.append(block)
    return kept


def fit_isotonic(points: DataFrame, *cell: str) -> DataFrame:
    """``low``, ``high``, ``weight`` and ``level`` of the blocks of each cell of ``points`` (cell, ``x``, ``weight``, ``total``: the sum of y).

    Levels rise with x, and are the weighted means of their blocks. Each x stands once in a cell.
    """
    kinds = dict(points.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in cell), "low double, high double, weight double, total double"])

    def pooled(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("low")
        found = pd.DataFrame(pool(*[frame[c].to_numpy(float) for c in ("low", "high", "weight", "total")]), columns=["low", "high", "weight", "total"])
        for c in reversed(cell):
            found.insert(0, c, frame[c].iloc[0])
        return found

    ranges = bucket_of(cut(points), "x").select(*cell, "_bucket", F.col("x").cast("double").alias("low"), F.col("x").cast("double").alias("high"), F.col("weight").cast("double").alias("weight"), F.col("total").cast("double").alias("total"))
    first = ranges.groupBy(*cell, "_bucket").applyInPandas(pooled, schema)
    return first.groupBy(*cell).applyInPandas(pooled, schema).select(*cell, "low", "high", "weight", (F.col("total") / F.col("weight")).alias("level"))


def predict_isotonic(rows: DataFrame, blocks: DataFrame, x: str, *cell: str, name: str = "fitted") -> DataFrame:
    """``rows`` with ``name``, what the blocks of their cell give for ``x``: the level inside a block, a line between two, and the
    nearest level outside. Null where the cell has no blocks. Rows of a cell are dealt into :data:`SALTS` groups."""
    near = blocks.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    schema = ", ".join([*(f"{n} {t}" for n, t in rows.dtypes), f"{name} double"])

    def fill(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("low")
        at = right[["low", "high"]].to_numpy(float).ravel()
        values = np.interp(left[x].to_numpy(float), at, np.repeat(right["level"].to_numpy(float), 2)) if len(at) else np.full(len(left), np.nan)
        return left.drop(columns="_salt").assign(**{name: values})

    keys = [*cell, "_salt"]
    found = dealt.groupBy(*keys).cogroup(near.groupBy(*keys)).applyInPandas(fill, schema)
    return found.withColumn(name, F.when(~F.isnan(name), F.col(name)))
