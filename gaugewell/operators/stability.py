"""Agreement of replicates: how far a value moves within an item, and how alike replicates order the items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugewell.operators.ranking import average_rank


def _mean(values: list[Column]) -> Column:
    total = values[0]
    for v in values[1:]:
        total = total + v
    return total / len(values)


def _correlation(a: Column, b: Column) -> Column:
    """Their correlation, null where one is flat; the built-in one fails on that."""
    varied = (F.min(a) < F.max(a)) & (F.min(b) < F.max(b))
    return F.when(varied, F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def replicate_stability(rows: DataFrame, value: str, replicate: str, replicates: tuple, item: str, cell: str) -> DataFrame:
    """Per cell: items, max_range, mean_range, share_over_10, share_over_20, mean_abs_dev, median_abs_dev, mean_spearman, matrix_mean.

    ``rows`` has one row per cell, item and replicate; null values are left out. Ranges are of an item over replicates, and the
    shares of those above 0.1 and 0.2 at six digits; deviations are from the item's mean or median, the median over six-digit
    deviations, so that its counts stay bounded. Correlations are over items that have every replicate, ranked among
    all items of their replicate: the mean of all pairs' rank correlations, and the mean of the correlation matrix with its
    diagonal. Null where a replicate is flat. One row per item carries all replicates, so that every pair is one aggregate of the
    same scan.
    """
    rows = rows.where(F.col(value).isNotNull())
    ranked = average_rank(rows.select(cell, item, replicate, value), value, cell, replicate, name="_r")
    at = {k: F.col(replicate) == F.lit(k) for k in replicates}
    columns = [F.max(F.when(at[k], F.col(name))).alias(f"{name}_{n}") for n, k in enumerate(replicates) for name in (value, "_r")]
    wide = ranked.groupBy(cell, item).agg(F.collect_list(value).alias("_all"), F.round(F.max(value) - F.min(value), 6).alias("_gap"), *columns)
    by_size = F.array_sort("_all")
    size = F.size("_all")
    middle = (F.element_at(by_size, F.floor((size + 1) / 2).cast("int")) + F.element_at(by_size, F.floor(size / 2 + 1).cast("int"))) / 2
    mean = F.aggregate("_all", F.lit(0.0), lambda a, b: a + b) / size
    away = lambda centre: F.transform("_all", lambda v: F.abs(v - F.col(centre)))
    wide = wide.withColumn("_mean", mean).withColumn("_middle", middle)
    names = range(len(replicates))
    whole = F.lit(True)
    for n in names:
        whole = whole & F.col(f"_r_{n}").isNotNull()
    pair = lambda name, i, j: _correlation(F.when(whole, F.col(f"{name}_{i}")), F.when(whole, F.col(f"{name}_{j}")))
    pairs = [(i, j) for i in names for j in names if i < j]
    k = len(replicates)
    sums = wide.groupBy(cell).agg(
        F.count(F.lit(1)).alias("items"), F.max("_gap").alias("max_range"), F.avg("_gap").alias("mean_range"), F.avg((F.col("_gap") > 0.1).cast("int")).alias("share_over_10"), F.avg((F.col("_gap") > 0.2).cast("int")).alias("share_over_20"),
        (F.sum(F.aggregate(away("_mean"), F.lit(0.0), lambda a, b: a + b)) / F.sum(size)).alias("mean_abs_dev"), _mean([pair("_r", i, j) for i, j in pairs]).alias("mean_spearman"),
        ((k + 2 * len(pairs) * _mean([pair(value, i, j) for i, j in pairs])) / (k * k)).alias("matrix_mean"),
    )
    moved = wide.select(cell, F.explode(away("_middle")).alias("_d")).groupBy(cell).agg(F.percentile(F.round("_d", 6), F.lit(0.5)).alias("median_abs_dev"))
    return sums.join(moved, cell)
