"""Many logistic regressions at once: every cell of exposure, condition and seed by Newton steps over one scan each.

A task turns a batch of rows into the gradients and Hessians of all cells that the rows belong to, in numpy; no row is
repeated per cell. What leaves a task is one small array per cell, and what reaches the driver their sums: as many numbers
as the grid has cells times the square of a model's features, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PENALTY = 0.001
STEPS = 30
CHANGE = 1e-8


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    return np.vstack(column.to_numpy()).astype(float) if len(column) else np.empty((0, width))


def _probability(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _solved(hessian: np.ndarray, gradient: np.ndarray) -> np.ndarray:
    return np.linalg.lstsq(hessian, gradient, rcond=None)[0]


class Grid:
    """Coefficients of logistic models: the intercept, the shared ``features`` and, in every condition but the first, one scalar.

    Rows hold ``exposure``, 0/1 ``y``, ``x`` (array of the shared features), ``s`` (array of one scalar per condition after the
    first) and, for fitting, ``w`` (array of one weight per seed). The penalty is ``penalty`` / 2 times the squared coefficients but
    the intercept, per unit of weight. A cell without rows of weight keeps coefficients 0, so that its probability is 0.5.
    """

    def __init__(self, exposures: tuple[str, ...], conditions: tuple[str, ...], seeds: int, features: int, penalty: float = PENALTY) -> None:
        self.exposures, self.conditions, self.seeds, self.features, self.penalty = exposures, conditions, seeds, features, penalty
        width = features + 2
        #: By exposure, condition, seed and coefficient; the last coefficient is the scalar's, 0 in the first condition.
        self.beta = np.zeros((len(exposures), len(conditions), seeds, width))
        self.steps = 0

    def _design(self, frame: pd.DataFrame, condition: int) -> np.ndarray:
        x, s = _matrix(frame["x"], self.features), _matrix(frame["s"], len(self.conditions) - 1)
        scalar = s[:, condition - 1] if condition else np.zeros(len(x))
        return np.column_stack([np.ones(len(x)), x, scalar])

    def _sums(self, rows: DataFrame) -> np.ndarray:
        """Per cell the gradient, the Hessian and the weight, summed over all rows."""
        beta, width = self.beta, self.features + 2
        size = width + width * width + 1

        def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((*beta.shape[:3], size))
            for frame in frames:
                for exposure, part in frame.groupby("exposure", sort=True):
                    e = self.exposures.index(exposure)
                    y, w = part["y"].to_numpy(float), _matrix(part["w"], self.seeds)
                    for c in range(len(self.conditions)):
                        z = self._design(part, c)
                        p = _probability(z @ beta[e, c].T)
                        gradient, h = z.T @ (w * (y[:, None] - p)), w * p * (1 - p)
                        for k in range(self.seeds):
                            total[e, c, k, :width] += gradient[:, k]
                            total[e, c, k, width:-1] += (z.T @ (h[:, k : k + 1] * z)).ravel()
                            total[e, c, k, -1] += w[:, k].sum()
            flat = total.reshape(-1, size)
            yield pd.DataFrame({"cell": np.arange(len(flat)), "v": list(flat)})

        sums = rows.select("exposure", "y", "x", "s", "w").mapInPandas(partial, "cell long, v array<double>")
        added = sums.select("cell", F.posexplode("v").alias("at", "v")).groupBy("cell", "at").agg(F.sum("v").alias("v")).collect()  # the grid's numbers
        found = np.zeros((self.beta[..., 0].size, size))
        for row in added:
            found[row["cell"], row["at"]] = row["v"]
        return found.reshape(*self.beta.shape[:3], size)

    def fit(self, rows: DataFrame, steps: int = STEPS, change: float = CHANGE) -> Grid:
        """Newton steps until no coefficient moves by more than ``change``. ``rows`` is read once a step: hand in a checkpoint."""
        width = self.features + 2
        penalised = np.diag([0.0] + [1.0] * (width - 1))
        for self.steps in range(1, steps + 1):
            sums, moved = self._sums(rows), 0.0
            for cell in np.ndindex(self.beta.shape[:3]):
                weight = sums[*cell, -1]
                if weight > 0:
                    penalty = self.penalty * weight * penalised
                    step = _solved(sums[*cell, width:-1].reshape(width, width) + penalty, sums[*cell, :width] - penalty @ self.beta[cell])
                    # A long step can overshoot where probabilities saturate.
                    step *= min(1.0, 5.0 / max(np.abs(step).max(), 1e-300))
                    self.beta[cell] += step
                    moved = max(moved, float(np.abs(step).max()))
            if moved <= change:
                break
        return self

    def histograms(self, rows: DataFrame, *keys: str, digits: int = 6) -> DataFrame:
        """How often each probability, rounded, meets y = 0 and y = 1: keys (text), exposure, condition, seed (from 1), p, zeros, ones.

        At most 10**digits rows a cell and value of the keys; a batch is counted before anything is shuffled.
        """
        beta, conditions = self.beta, self.conditions
        fields = "".join(f"{k} string, " for k in keys)

        def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                parts = []
                for names, part in frame.groupby([*keys, "exposure"], sort=True):
                    e = self.exposures.index(names[-1])
                    y = part["y"].to_numpy(int)
                    for c, condition in enumerate(conditions):
                        p = _probability(self._design(part, c) @ beta[e, c].T)
                        for k in range(self.seeds):
                            values, at = np.unique(np.round(p[:, k], digits), return_inverse=True)
                            ones = np.bincount(at, weights=y, minlength=len(values)).astype(int)
                            named = {**dict(zip(keys, names[:-1], strict=True)), "exposure": names[-1], "condition": condition, "seed": k + 1}
                            parts.append(pd.DataFrame({**named, "p": values, "zeros": np.bincount(at, minlength=len(values)) - ones, "ones": ones}))
                if parts:
                    yield pd.concat(parts, ignore_index=True)

        whole = rows.select(*keys, "exposure", "y", "x", "s").mapInPandas(counted, fields + "exposure string, condition string, seed int, p double, zeros long, ones long")
        return whole.groupBy(*keys, "exposure", "condition", "seed", "p").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"))
