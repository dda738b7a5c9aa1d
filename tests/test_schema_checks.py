"""The nine schema checks on tables that violate each of them once."""

from __future__ import annotations

from gaugewell.operators import gates


def checked(spark, change: str = "") -> dict[str, int]:
    """Violations by check, after one change of clean tables."""
    rows = [("a", 1, "train", 0), ("a", 2, "train", 1), ("b", 2, "test", 0)]
    items, splits = [(1, "h"), (2, "h")], [("a", "train"), ("b", "test"), ("c", "val")]
    edges = [("training_response_cooccurrence", "train"), ("official_metadata", "all"), ("other", None)]
    {"sequence_monotonic": lambda: rows.__setitem__(1, ("a", 2, "train", 2)), "interaction_item_join": lambda: rows.__setitem__(0, ("a", 9, "train", 0)),
     "interaction_split_match": lambda: rows.__setitem__(2, ("b", 2, None, 0)), "stable_content_hash": lambda: items.__setitem__(0, (1, None)),
     "eligible_count": lambda: items.append((3, "h")), "split_disjoint": lambda: splits.append(("c", "test")),
     "edge_provenance": lambda: edges.__setitem__(0, ("training_response_cooccurrence", "all"))}.get(change, lambda: None)()
    interactions = spark.createDataFrame(rows, "learner string, item int, split string, position int")
    if change == "no_raw_ids":
        interactions = interactions.selectExpr("*", "1 AS uid")
    table = spark.createDataFrame(items, "item int, content_hash string")
    prompts = table if change == "prompt_safe" else table.select("item")
    found = gates.schema_checks(interactions, table, spark.createDataFrame(splits, "learner string, split string"), prompts, spark.createDataFrame(edges, "source string, permitted string"), 2, ("item",)).collect()
    assert len(found) == 10 and all(r.passed == (r.violations == 0) for r in found)
    return {r.check: r.violations for r in found}


def test_each_check_fails_alone(spark):
    clean = checked(spark)
    assert set(clean.values()) == {0}
    for name in clean.keys() - {"status"}:
        assert {k for k, v in checked(spark, name).items() if v == 1} == {name, "status"}
