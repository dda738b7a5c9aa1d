"""Evaluation of prediction tables: log loss, Brier score, accuracy, AUC, calibration error."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewell.operators.ranking import running

CLIP = 1e-6
BINS = 10


def binary_metrics(rows: DataFrame, *cell: str, clip: float = CLIP) -> DataFrame:
    """n, log_loss, brier and accuracy of ``p`` against 0/1 ``y`` per cell."""
    p = F.greatest(F.least("p", F.lit(1 - clip)), F.lit(clip))
    loss = -(F.col("y") * F.log(p) + (1 - F.col("y")) * F.log(1 - p))
    hit = ((F.col("p") >= 0.5).cast("int") == F.col("y")).cast("int")
    return rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), F.avg(loss).alias("log_loss"), F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier"), F.avg(hit).alias("accuracy"))


def roc_auc(rows: DataFrame, *cell: str) -> DataFrame:
    """Area under the ROC curve per cell, ties counted half; null with one class. From the histogram of ``p``."""
    return auc_of_counts(rows.groupBy(*cell, "p").agg(F.sum("y").alias("ones"), F.sum(1 - F.col("y")).alias("zeros")), *cell)


def auc_of_counts(counts: DataFrame, *cell: str) -> DataFrame:
    """:func:`roc_auc` from how often each ``p`` of a cell meets y = 0 (``zeros``) and y = 1 (``ones``)."""
    won = F.col("ones") * (F.col("zeros_below") + F.col("zeros") / 2)
    sums = running(counts, "p", ("zeros",), *cell).groupBy(*cell).agg(F.sum(won).alias("won"), F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))
    return sums.select(*cell, F.when((F.col("ones") > 0) & (F.col("zeros") > 0), F.col("won") / (F.col("ones") * F.col("zeros"))).alias("auc"))


def calibration_error(rows: DataFrame, *cell: str, bins: int = BINS) -> DataFrame:
    """Expected calibration error over equal bins [low, high), their edges the doubles i / bins; the last holds 1."""
    edges = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    binned = rows.withColumn("_bin", F.size(F.filter(edges, lambda e: e <= F.col("p"))))
    each = binned.groupBy(*cell, "_bin").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("p"), F.avg("y").alias("y"))
    return each.groupBy(*cell).agg((F.sum(F.col("n") * F.abs(F.col("p") - F.col("y"))) / F.sum("n")).alias("ece"))


def histogram_metrics(counts: DataFrame, *cell: str, clip: float = CLIP, bins: int = BINS) -> DataFrame:
    """n, log_loss, brier, accuracy, ece and auc per cell, from one row per cell and ``p`` with its ``zeros`` and ``ones``."""
    p, n = F.greatest(F.least("p", F.lit(1 - clip)), F.lit(clip)), F.col("zeros") + F.col("ones")
    loss = -(F.col("ones") * F.log(p) + F.col("zeros") * F.log(1 - p))
    squares = F.col("ones") * F.pow(F.col("p") - 1, 2) + F.col("zeros") * F.pow("p", F.lit(2))
    hits = F.when(F.col("p") >= 0.5, F.col("ones")).otherwise(F.col("zeros"))
    edges = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    binned = counts.withColumn("_bin", F.size(F.filter(edges, lambda e: e <= F.col("p"))))
    each = binned.groupBy(*cell, "_bin").agg(F.sum(n).alias("n"), F.sum(loss).alias("loss"), F.sum(squares).alias("squares"), F.sum(hits).alias("hits"), F.abs(F.sum(n * F.col("p")) - F.sum("ones")).alias("gap"))
    sums = each.groupBy(*cell).agg(F.sum("n").alias("n"), *[(F.sum(a) / F.sum("n")).alias(b) for a, b in (("loss", "log_loss"), ("squares", "brier"), ("hits", "accuracy"), ("gap", "ece"))])
    return sums.join(auc_of_counts(counts, *cell), list(cell))
