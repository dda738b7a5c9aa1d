"""Rank correlation, agreement and multiplicity correction per cell."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from gaugewell.operators.ranking import average_rank, centred_rank, joint, running

__all__ = ["average_rank", "holm", "incomplete_beta", "kendall", "p_df4", "pearson", "spearman", "spearman_of", "t_two_sided_p", "weighted_pearson", "with_rank_p"]


def pearson(rows: DataFrame, x: str, y: str, *cell: str, least: int = 5) -> DataFrame:
    """n and r per cell; r is null with fewer than ``least`` rows or a constant side."""
    found = rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), F.covar_pop(x, y).alias("_c"), F.stddev_pop(x).alias("_x"), F.stddev_pop(y).alias("_y"))
    usable = (F.col("n") >= least) & (F.col("_x") > 0) & (F.col("_y") > 0)
    return found.select(*cell, "n", F.when(usable, F.col("_c") / (F.col("_x") * F.col("_y"))).alias("r"))


def weighted_pearson(rows: DataFrame, x: str, y: str, weight: str, *cell: str, least: float = 5, name: str = "r") -> DataFrame:
    """n, the sum of weights, and the correlation of rows that count ``weight`` times; null as in :func:`pearson`."""
    w, both = F.col(weight), rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    total = lambda *f: F.sum(reduce(Column.__mul__, f, w.cast("double")))
    sums = both.groupBy(*cell).agg(F.sum(w).alias("n"), total(F.col(x)).alias("_x"), total(F.col(y)).alias("_y"), total(F.col(x), F.col(y)).alias("_xy"), total(F.col(x), F.col(x)).alias("_xx"), total(F.col(y), F.col(y)).alias("_yy"))
    return pearson_of(sums, *cell, least=least, name=name)


def pearson_of(sums: DataFrame, *cell: str, least: float = 5, name: str = "r") -> DataFrame:
    """:func:`weighted_pearson` from the sums of weights (``n``) and of weighted x, y, xy, xx and yy (``_x`` to ``_yy``)."""
    spread = lambda a, b, ab: F.col(ab) - F.col(a) * F.col(b) / F.col("n")
    # What cancels to nothing but rounding is no spread.
    vx, vy = spread("_x", "_x", "_xx"), spread("_y", "_y", "_yy")
    usable = (F.col("n") >= least) & (vx > 1e-12 * F.col("_xx")) & (vy > 1e-12 * F.col("_yy"))
    return sums.select(*cell, "n", F.when(usable, spread("_x", "_y", "_xy") / F.sqrt(vx * vy)).alias(name))


def spearman(rows: DataFrame, x: str, y: str, *cell: str, least: float = 5, weight: str | None = None) -> DataFrame:
    """n and rank correlation per cell, with average ranks for ties, from the table of pairs of values.

    With ``weight`` a row counts so many times. Rows that lack x or y are left out; rho is null with fewer than
    ``least`` rows or a constant side.
    """
    return spearman_of(joint(rows, x, y, *cell, weight=weight), *cell, least=least)


def spearman_of(table: DataFrame, *cell: str, least: float = 5) -> DataFrame:
    """:func:`spearman` from the table of pairs of values (:func:`joint`)."""
    ranked = centred_rank(centred_rank(table, "_x", "_w", *cell, name="_rx"), "_y", "_w", *cell, name="_ry")
    w, rx, ry = F.col("_w"), F.col("_rx"), F.col("_ry")
    sums = ranked.groupBy(*cell).agg(F.sum(w).alias("n"), F.sum(w * rx * ry).alias("_c"), F.sum(w * rx * rx).alias("_vx"), F.sum(w * ry * ry).alias("_vy"))
    usable = (F.col("n") >= least) & (F.col("_vx") > 0) & (F.col("_vy") > 0)
    return sums.select(*cell, "n", F.when(usable, F.col("_c") / F.sqrt(F.col("_vx") * F.col("_vy"))).alias("rho"))


def kendall(rows: DataFrame, x: str, y: str, *cell: str) -> DataFrame:
    """n and tau-b per cell. Pairs are not formed: two ranks of y first differ in one binary digit, and for each digit
    a running sum along x counts, among the ranks alike above it, those with a 0 there below and above each with a 1.
    """
    table = joint(rows, x, y, *cell)
    values = table.select(*cell, "_y", F.lit(1).alias("_one")).distinct()
    ranked = running(values, "_y", ("_one",), *cell).select(*cell, "_y", (F.col("_one_below") + 1).cast("long").alias("_r"), F.length(F.bin("_one_all")).alias("_top"))
    digits = table.join(ranked, [*cell, "_y"]).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_top") - 1)))
    one = F.expr("shiftright(_r, _k) & 1") == 1
    same = [*cell, "_k", "_above"]
    sums = digits.withColumn("_above", F.expr("shiftright(_r, _k + 1)")).groupBy(*same, "_x").agg(F.sum(F.when(one, F.col("_w")).otherwise(0)).alias("_ones"), F.sum(F.when(one, 0).otherwise(F.col("_w"))).alias("_zeros"))
    gap = F.col("_zeros_below") - (F.col("_zeros_all") - F.col("_zeros_below") - F.col("_zeros"))
    score = running(sums, "_x", ("_zeros",), *same).groupBy(*cell).agg(F.sum(F.col("_ones") * gap).alias("s"))
    tied = lambda col: table.groupBy(*cell, col).agg(F.sum("_w").alias("t")).groupBy(*cell).agg(F.sum(F.col("t") * (F.col("t") - 1) / 2).alias(f"tie{col}"))
    total = table.groupBy(*cell).agg(F.sum("_w").alias("n"))
    join = (lambda a, b: a.join(b, list(cell))) if cell else (lambda a, b: a.crossJoin(b))  # a row each without cells
    both = join(join(join(score, tied("_x")), tied("_y")), total)
    pairs = F.col("n") * (F.col("n") - 1) / 2
    scale = F.sqrt((pairs - F.col("tie_x")) * (pairs - F.col("tie_y")))
    return both.select(*cell, "n", F.when(scale > 0, F.col("s") / scale).alias("tau"))


def holm(rows: DataFrame, p: str, *family: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with ``p_holm``: the running maximum of min(1, (m - r) * p) in each family, p ascending; a null p is no test."""
    whole = Window.partitionBy(*family, F.col(p).isNull())
    order = whole.orderBy(p, *ties)
    step = F.least(F.lit(1.0), (F.count(F.lit(1)).over(whole) - F.row_number().over(order) + 1) * F.col(p))
    upto = F.max("_step").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_step", step).withColumn("p_holm", F.when(F.col(p).isNotNull(), upto)).drop("_step")


def p_df4(t: Column) -> Column:
    """Two-sided p of Student's t with four degrees of freedom, in closed form."""
    a = F.abs(t)
    q = 1 + a * a / 4
    return 2 * (1 - (F.lit(0.5) + F.lit(0.375) * a / F.sqrt(q) * (1 - a * a / (12 * q))))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + top * d, 1 + top / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            total *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return total


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


@F.pandas_udf(DoubleType())
def t_two_sided_p(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p of Student's t; for summary rows, not for fact tables."""
    return pd.Series([None if t_ is None or df_ is None or not np.isfinite(t_) or df_ <= 0 else incomplete_beta(df_ / 2, 0.5, df_ / (df_ + t_ * t_)) for t_, df_ in zip(t, df, strict=True)], dtype="float64")


def with_rank_p(found: DataFrame, rho: str = "rho") -> DataFrame:
    """``found`` with the two-sided p of a rank correlation by the t approximation with n - 2 degrees of freedom."""
    t = F.col(rho) * F.sqrt((F.col("n") - 2) / F.greatest(1 - F.col(rho) * F.col(rho), F.lit(1e-300)))
    return found.withColumn("p", t_two_sided_p(t, (F.col("n") - 2).cast("double")))
