"""Item error rates, priors and response views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugewell.operators.association import spearman

THRESHOLDS = (5, 10, 20, 50, 100)


def error_rates(rows: DataFrame, *keys: str) -> DataFrame:
    """Per key: n, n_correct, n_incorrect, learners, raw error of 0/1 ``correct``."""
    found = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("correct").alias("n_correct"), F.countDistinct("learner").alias("learners"))
    return found.withColumn("n_incorrect", F.col("n") - F.col("n_correct")).withColumn("error", F.col("n_incorrect") / F.col("n"))


def beta_smoothed(successes: Column | str, n: Column | str, alpha: float = 1.0, beta: float = 1.0) -> Column:
    """(k + alpha) / (n + alpha + beta)."""
    k, total = (F.col(x) if isinstance(x, str) else x for x in (successes, n))
    return (k + alpha) / (total + alpha + beta)


def empirical_prior(rates: DataFrame, *keys: str, error: str = "error") -> DataFrame:
    """Method-of-moments beta prior of item rates per key: ``alpha``, ``beta``.

    Rates are clipped to [1e-6, 1 - 1e-6]; (1, 1) with fewer than two items, without variance, or with more
    variance than a beta law can have; either at least 0.1.
    """
    clipped = F.least(F.greatest(F.col(error), F.lit(1e-6)), F.lit(1 - 1e-6))
    moments = rates.groupBy(*keys).agg(F.avg(clipped).alias("m"), F.var_samp(clipped).alias("v"), F.count(F.lit(1)).alias("items"))
    scale = F.col("m") * (1 - F.col("m")) / F.col("v") - 1
    usable = (F.col("items") >= 2) & (F.col("v") > 0) & (scale > 0)
    alpha = F.when(usable, F.greatest(F.col("m") * scale, F.lit(0.1))).otherwise(1.0)
    beta = F.when(usable, F.greatest((1 - F.col("m")) * scale, F.lit(0.1))).otherwise(1.0)
    return moments.select(*keys, alpha.alias("alpha"), beta.alias("beta"))


def first_observed(rows: DataFrame, *order: str) -> DataFrame:
    """The earliest row of each learner and item by ``order``, which must end in a unique column."""
    place = F.row_number().over(Window.partitionBy("learner", "item").orderBy(*order))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")


def learner_weighted(rows: DataFrame, *keys: str) -> DataFrame:
    """Mean error per (key, learner), then over learners; smoothed by the number of learners."""
    each = rows.groupBy(*keys, "learner").agg(F.avg(1 - F.col("correct")).alias("own"))
    found = each.groupBy(*keys).agg(F.count(F.lit(1)).alias("learners"), F.avg("own").alias("error"))
    return found.withColumn("smoothed", (F.col("error") * F.col("learners") + 1) / (F.col("learners") + 2))


def threshold_table(rates: DataFrame, *keys: str, thresholds: tuple[int, ...] = THRESHOLDS) -> DataFrame:
    """Items with at least t responses, and the others, per key and threshold t."""
    limits = F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold")
    eligible = F.count_if(F.col("n") >= F.col("threshold"))
    return rates.select(*keys, "n", limits).groupBy(*keys, "threshold").agg(eligible.alias("eligible"), (F.count(F.lit(1)) - eligible).alias("excluded"))


def compare_errors(one: DataFrame, other: DataFrame, least: int, key: str = "item") -> DataFrame:
    """One row on two error tables (key, ``n``, ``error``) whose items are those of ``one``: agreement where both have ``least`` responses.

    ``items`` compared, ``r``, ``rho``, median, 95 % and largest absolute gap, how many are ``eligible_one`` and ``eligible_other``, ``flips``
    (eligible in one table alone), their share of those eligible in any, and ``lost`` (eligible in ``one`` alone).
    """
    both = one.join(other.select(key, F.col("n").alias("_n"), F.col("error").alias("_error")), key, "left")
    a, b = F.col("n") >= least, F.coalesce(F.col("_n") >= least, F.lit(False))
    common = both.where(a & b).select(F.lit("x").alias("_cell"), "error", "_error")
    rho = spearman(common, "error", "_error", "_cell").select("_cell", "rho")
    x, y = F.when(a & b, F.col("error")), F.when(a & b, F.col("_error"))
    gap = F.abs(x - y)
    at = lambda q: F.percentile(gap, F.lit(q))
    flips, either = F.count_if(a != b), F.count_if(a | b)
    found = both.agg(F.count_if(a & b).alias("items"), F.corr(x, y).alias("r"), at(0.5).alias("median_gap"), at(0.95).alias("p95_gap"), F.max(gap).alias("max_gap"), F.count_if(a).alias("eligible_one"), F.count_if(b).alias("eligible_other"), flips.alias("flips"), (flips / F.greatest(either, F.lit(1))).alias("flip_share"), F.count_if(a & ~b).alias("lost"))
    return found.withColumn("_cell", F.lit("x")).join(rho, "_cell", "left").drop("_cell")


def attach_split(rows: DataFrame, splits: DataFrame, key: str = "learner") -> DataFrame:
    """``rows`` with the ``split`` of their key; computing a row whose key has none, or a null one, raises an error."""
    found = rows.join(splits.select(key, F.col("split").alias("_split")), key, "left")
    wrong = F.concat(F.lit("no split for "), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    return found.withColumn("split", F.coalesce("_split", F.raise_error(wrong).cast("string"))).drop("_split")
