"""Checks as tables: one row per named check, with the number of rows that violate it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(checks: dict[str, DataFrame]) -> DataFrame:
    """``check``, ``violations``, ``passed`` for named one-row frames with the column ``violations``."""
    parts = [frame.select(F.lit(name).alias("check"), F.coalesce("violations", F.lit(0)).cast("long").alias("violations")) for name, frame in checks.items()]
    return reduce(DataFrame.unionByName, parts).withColumn("passed", F.col("violations") == 0)


def counted(rows: DataFrame, condition: Column) -> DataFrame:
    """One row: how many rows of ``rows`` meet ``condition``."""
    return rows.agg(F.count_if(condition).alias("violations"))


# Columns that a shared table must not have, sources of concept edges and the splits that each may use.
RAW_IDS = ("user_id", "uid", "student_id", "exercise", "question_id", "item_id")
PERMITTED = {"training_response_cooccurrence": "train", "official_metadata": "all"}


def schema_checks(interactions: DataFrame, items: DataFrame, splits: DataFrame, prompts: DataFrame, edges: DataFrame, expected: int | Column, allowed: tuple[str, ...]) -> DataFrame:
    """Nine named checks of a unified dataset as ``check``, ``violations``, ``passed``, and the row ``status`` over all of them.

    ``interactions`` have learner, item, split and position, ``items`` item and content_hash, ``splits`` learner and split, ``edges`` source
    and permitted. ``expected`` is the number of items declared; ``prompts`` must have just the columns ``allowed``. Empty tables
    violate nothing but the count. Violations are columns (no_raw_ids, prompt_safe), learners (split_disjoint, sequence_monotonic),
    items (eligible_count: the difference, stable_content_hash), rows (interaction_split_match, interaction_item_join), else edges.
    """
    fixed = lambda n: interactions.sparkSession.range(1).select(F.lit(n).alias("violations"))
    own = splits.groupBy("learner").agg(F.count_distinct("split").alias("_k"), F.min("split").alias("_split"))
    matched = interactions.join(own, "learner", "left")
    sequences = interactions.groupBy("learner").agg(F.min("position").alias("first"), F.max("position").alias("last"), F.count_distinct("position").alias("places"), F.count(F.lit(1)).alias("n"))
    right = F.coalesce(F.create_map(*[F.lit(x) for pair in PERMITTED.items() for x in pair])[F.col("source")] == F.col("permitted"), ~F.coalesce(F.col("source").isin(*PERMITTED), F.lit(False)))
    found = violations({
        "no_raw_ids": fixed(len(set(RAW_IDS) & set(interactions.columns))),
        "split_disjoint": counted(own, F.col("_k") > 1),
        "interaction_split_match": counted(matched, ~F.coalesce((F.col("_k") == 1) & (F.col("_split") == F.col("split")), F.lit(False))),
        "prompt_safe": fixed(len(set(prompts.columns) ^ set(allowed))),
        "eligible_count": items.agg(F.abs(F.count(F.lit(1)) - expected).alias("violations")),
        "interaction_item_join": interactions.join(items.select("item").distinct(), "item", "left_anti").agg(F.count(F.lit(1)).alias("violations")),
        "stable_content_hash": counted(items, F.col("content_hash").isNull()),
        "sequence_monotonic": counted(sequences, ~F.coalesce((F.col("first") == 0) & (F.col("last") + 1 == F.col("n")) & (F.col("places") == F.col("n")), F.lit(False))),
        "edge_provenance": counted(edges, ~right),
    })
    whole = found.rollup("check").agg(F.sum("violations").alias("violations"), F.bool_and("passed").alias("passed"))
    return whole.select(F.coalesce("check", F.lit("status")).alias("check"), "violations", "passed")


def graded(value: Column, good: float, fair: float) -> Column:
    """PASS from ``good`` on, BORDERLINE from ``fair`` on, else FAIL."""
    return F.when(value >= good, "PASS").when(value >= fair, "BORDERLINE").otherwise("FAIL")


def worst(*grades: Column) -> Column:
    """The worst of several grades."""
    every = F.array(*grades)
    return F.when(F.array_contains(every, "FAIL"), "FAIL").when(F.array_contains(every, "BORDERLINE"), "BORDERLINE").otherwise("PASS")
