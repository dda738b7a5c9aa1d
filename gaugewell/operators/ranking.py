"""Running totals along an ordered value, in cells of any size: ranks, ROC areas and concordance are built on them.

A window over a whole cell is one task. Here values are cut into buckets at quantiles of all distinct values, so that
a group (cell, bucket) has a bounded share of them however they lie; totals of buckets, a few rows per cell, give each
bucket what comes before it, and a window inside the bucket the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugewell.sources.files import cut

#: Buckets that the distinct values of all cells are cut into.
BUCKETS = 64
#: Accuracy of the quantiles: buckets differ by at most one in so many of all values.
ACCURACY = 2000


def bucket_of(values: DataFrame, value: str, buckets: int | None = None) -> DataFrame:
    """``values`` with ``_bucket``, which ascends with ``value``; only one row, of the quantiles, is broadcast."""
    count = buckets or BUCKETS
    cuts = values.agg(F.percentile_approx(F.col(value).cast("double"), F.array(*[F.lit(i / count) for i in range(1, count)]), F.lit(ACCURACY)).alias("_cuts"))
    edges = F.filter(F.array_distinct("_cuts"), lambda c: c < F.col(value).cast("double"))
    return values.crossJoin(F.broadcast(cuts)).withColumn("_bucket", F.coalesce(F.size(edges), F.lit(0))).drop("_cuts")


def running(values: DataFrame, value: str, amounts: tuple[str, ...], *cell: str, buckets: int | None = None) -> DataFrame:
    """``values``, one row per cell and ``value`` and checkpointed, with ``<amount>_below``, the sum over smaller values of the cell, and
    ``<amount>_all``, the sum over the cell. Cells must not be null."""
    values = cut(values)  # read for the quantiles, the totals and the windows
    keyed = bucket_of(values, value, buckets)
    inside = Window.partitionBy(*cell, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    totals = keyed.groupBy(*cell, "_bucket").agg(*[F.sum(a).alias(f"_{a}") for a in amounts])
    whole = Window.partitionBy(*cell)
    upto = whole.orderBy("_bucket")
    before = [(F.sum(f"_{a}").over(upto) - F.col(f"_{a}")).alias(f"_{a}_before") for a in amounts]
    totals = totals.select(*cell, "_bucket", *before, *[F.sum(f"_{a}").over(whole).alias(f"{a}_all") for a in amounts])
    rows = keyed.select("*", *[F.coalesce(F.sum(a).over(inside), F.lit(0)).alias(f"_{a}_inside") for a in amounts])
    below = [(F.col(f"_{a}_before") + F.col(f"_{a}_inside")).alias(f"{a}_below") for a in amounts]
    return rows.join(totals, [*cell, "_bucket"]).select(*values.columns, *below, *[f"{a}_all" for a in amounts])


def centred_rank(rows: DataFrame, value: str, weight: str, *cell: str, name: str) -> DataFrame:
    """``rows`` with the average rank of ``value`` in its cell less the cell's mean rank; a row counts ``weight`` times."""
    counts = rows.groupBy(*cell, value).agg(F.sum(weight).alias("_ties"))
    ranks = running(counts, value, ("_ties",), *cell)
    return rows.join(ranks.select(*cell, value, (F.col("_ties_below") + (F.col("_ties") - F.col("_ties_all")) / 2).alias(name)), [*cell, value])


def average_rank(rows: DataFrame, value: str, *cell: str, name: str) -> DataFrame:
    """``rows`` with the average rank of ``value`` in its cell, ties sharing the mean of their ranks; nulls are left out."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*cell, value).agg(F.count(F.lit(1)).alias("_ties"))
    ranks = running(counts, value, ("_ties",), *cell)
    return rows.join(ranks.select(*cell, value, (F.col("_ties_below") + (F.col("_ties") + 1) / 2).alias(name)), [*cell, value])


def joint(rows: DataFrame, x: str, y: str, *cell: str, weight: str | None = None) -> DataFrame:
    """How often, or with what weight ``_w``, each pair of values occurs in each cell, checkpointed; pairs with a null are left out."""
    amount: Column = F.sum(weight) if weight else F.count(F.lit(1))
    return cut(rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*cell, F.col(x).alias("_x"), F.col(y).alias("_y")).agg(amount.alias("_w")))
