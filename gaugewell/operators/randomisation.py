"""Randomisation tests of paired gaps: signs by hash bits, a block of items times all replicates at once.

No row per item and replicate is made: a task multiplies the gaps of a batch of items with their matrix of signs and adds
up one vector of sums per cell, in blocks of replicates; blocks of all tasks are added in a second, short step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REPLICATES = 100_000
#: Replicates of a row of partial sums, and items that are multiplied at once.
BLOCK, ITEMS = 4096, 128
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def sign_bits(keys: np.ndarray, replicates: int) -> np.ndarray:
    """0 or 1 for each key (64-bit hashes) and replicate: the bits of a mixed counter."""
    x = keys.astype(np.uint64)[:, None] + (np.arange(-(-replicates // 64), dtype=np.uint64) * _A)[None]
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    x = x ^ (x >> np.uint64(31))
    return np.unpackbits(x.view(np.uint8), axis=1)[:, :replicates]


def sign_test(gaps: DataFrame, key: str, gap: str, *cell: str, replicates: int = REPLICATES) -> DataFrame:
    """Per cell: ``n``, the ``mean`` gap, ``extreme``, how many of ``replicates`` random choices of signs give a sum at least as far
    from 0, ``p`` = (1 + extreme) / (1 + replicates), and ``se``, the Monte-Carlo standard error of p.

    Signs are hashes of cell and key, which a cell has once. Null gaps are left out.
    """
    rows = gaps.where(F.col(gap).isNotNull()).select(*cell, F.xxhash64(*cell, key).alias("_key"), F.col(gap).cast("double").alias("_gap"))
    kinds = dict(rows.dtypes)
    fields = ", ".join(f"{c} {kinds[c]}" for c in cell)

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        for frame in frames:
            for name, part in frame.groupby(list(cell), sort=True):
                total = sums.setdefault(name, np.zeros(replicates))
                keys, values = part["_key"].to_numpy(np.int64), part["_gap"].to_numpy(float)
                for i in range(0, len(keys), ITEMS):
                    some = values[i : i + ITEMS]
                    # A swapped item counts twice against the plain sum.
                    total += some.sum() - 2.0 * (some @ sign_bits(keys[i : i + ITEMS], replicates))
        for name, total in sums.items():
            for first in range(0, replicates, BLOCK):
                yield pd.DataFrame([[*name, first // BLOCK, total[first : first + BLOCK]]], columns=[*cell, "block", "sums"])

    parts = rows.mapInPandas(partial, f"{fields}, block int, sums array<double>")
    seen = rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), F.sum("_gap").alias("_seen"), F.sum(F.abs("_gap")).alias("_size"))

    def counted(frame: pd.DataFrame) -> pd.DataFrame:
        first = frame.iloc[0]
        total = np.sum(np.stack(frame["sums"].to_list()), axis=0)
        extreme = int((np.abs(total) >= abs(first["_seen"]) - 1e-12 * first["_size"]).sum())
        return pd.DataFrame([[*first[list(cell)], extreme]], columns=[*cell, "extreme"])

    each = parts.join(seen.drop("n"), list(cell)).groupBy(*cell, "block").applyInPandas(counted, f"{fields}, extreme long")
    found = each.groupBy(*cell).agg(F.sum("extreme").alias("extreme")).join(seen, list(cell))
    p = (1 + F.col("extreme")) / F.lit(replicates + 1.0)
    return found.select(*cell, "n", (F.col("_seen") / F.col("n")).alias("mean"), "extreme", p.alias("p"), F.sqrt(p * (1 - p) / replicates).alias("se"))
