"""Streams of interactions: running item counts and first responses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def item_counts(stream: DataFrame) -> DataFrame:
    """Running n, n_correct and smoothed error per item; for update or complete output."""
    found = stream.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.sum("correct").alias("n_correct"))
    return found.withColumn("smoothed", (F.col("n") - F.col("n_correct") + 1) / (F.col("n") + 2))


def windowed_counts(stream: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """n and n_correct per item and event-time window; rows later than ``late`` are dropped."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width).alias("span"), "item").agg(F.count(F.lit(1)).alias("n"), F.sum("correct").alias("n_correct"))


def earliest_responses(stream: DataFrame) -> DataFrame:
    """The earliest response per learner and item by event time, of equal times that with the least event_id: ts, event_id, correct.

    For update output (a pair comes again when an earlier response of it arrives, whatever arrived before; upsert by
    learner and item) or complete output. State is one row per pair and never ends: a pair that is forgotten could not be told from a
    new one. Partial aggregates keep a pair's rows of a batch to one before the shuffle.
    """
    kept = F.min_by(F.struct("ts", "event_id", "correct"), F.struct("ts", "event_id")).alias("_first")
    return stream.groupBy("learner", "item").agg(kept).select("learner", "item", "_first.*")


def first_responses(stream: DataFrame, late: str = "3650 days") -> DataFrame:
    """The first arriving response per learner and item within the watermark.

    Equal to the earliest by event time only if arrival follows event time; a response of a pair that comes back
    after ``late`` counts as new.
    """
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["learner", "item"])
