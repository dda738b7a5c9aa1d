"""Replicate stability against numpy, nested item JSON, and earliest responses of a stream out of order."""

from __future__ import annotations

import json
import tempfile
import warnings

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugewell.functions import text as T
from gaugewell.operators.stability import replicate_stability
from gaugewell.sources.files import nested_items
from gaugewell.streaming.interactions import earliest_responses


def test_replicate_stability_equals_numpy(spark):
    rng = np.random.default_rng(4)
    base = rng.random(60)
    table = np.round(np.clip(base[:, None] + rng.normal(0, 0.08, (60, 4)), 0, 1), 2)
    rows = [("m", i, r, float(table[i, r])) for i in range(60) for r in range(4)] + [("flat", i, r, 0.5) for i in range(6) for r in range(4)]
    found = {r.cell: r for r in replicate_stability(spark.createDataFrame(rows, "cell string, item int, run int, v double"), "v", "run", (0, 1, 2, 3), "item", "cell").collect()}
    got, gaps = found["m"], np.round(table.max(1) - table.min(1), 6)
    assert got["items"] == 60 and got.max_range == pytest.approx(gaps.max()) and got.mean_range == pytest.approx(gaps.mean())
    assert got.share_over_10 == pytest.approx((gaps > 0.1).mean()) and got.share_over_20 == pytest.approx((gaps > 0.2).mean())
    assert got.mean_abs_dev == pytest.approx(np.abs(table - table.mean(1, keepdims=True)).mean())
    assert got.median_abs_dev == pytest.approx(np.median(np.abs(table - np.median(table, 1, keepdims=True))))
    assert got.matrix_mean == pytest.approx(np.corrcoef(table.T).mean())
    ranks = pd.DataFrame(table).rank().corr().to_numpy()
    assert got.mean_spearman == pytest.approx(ranks[np.triu_indices(4, 1)].mean())
    assert found["flat"].mean_spearman is None and found["flat"].matrix_mean is None and found["flat"].median_abs_dev == 0


def test_an_item_without_a_replicate(spark):
    rows = [("m", i, r, float((i * 7 + r) % 11)) for i in range(20) for r in range(2) if (i, r) != (3, 1)] + [("m", 50, 0, None)]
    got = replicate_stability(spark.createDataFrame(rows, "cell string, item int, run int, v double"), "v", "run", (0, 1), "item", "cell").first()
    assert got["items"] == 20 and got.mean_spearman is not None


def test_nested_items(spark):
    whole = {
        "1": {"content": "  a \n", "type": 1, "options": {"A": "x"}, "kc_routes": ["p", "q"], "answer": "A"},
        "2": {"type": "1", "options": {}, "kc_routes": []},
        "3": {"content": None, "type": "multiple_choice", "kc_routes": None},
        "4": {"content": "é", "type": 0, "extra": [1, {"z": 2}]},
        "5": {},
    }
    rows = spark.createDataFrame([(json.dumps(whole),), ("not json",), (None,), ("{}",)], "text string")
    got = {r["item"]: tuple(r)[1:] for r in nested_items(rows, "text").collect()}
    assert got == {
        1: ("a", "multiple_choice", '{"A":"x"}', "A", "p|q", "q"),
        2: ("", "multiple_choice", None, "", "", ""),
        3: ("", "multiple_choice", None, "", "", ""),
        4: ("é", "fill_in", None, "", "", ""),
        5: ("", "fill_in", None, "", "", ""),
    }


def test_an_earlier_response_that_arrives_later(spark):
    at, kind = tempfile.mkdtemp(), "learner long, item long, event_id long, ts timestamp, correct int"
    batches = [[(1, 1, 10, 300, 1), (1, 2, 11, 50, 0)], [(1, 1, 12, 100, 0), (1, 2, 13, 60, 1)], [(1, 1, 9, 100, 1), (2, 1, 14, 5, 1), (1, 2, 15, 50, 1)]]
    for rows in batches:
        one = spark.createDataFrame(rows, "learner long, item long, event_id long, s long, correct int")
        one.select("learner", "item", "event_id", F.timestamp_seconds("s").alias("ts"), "correct").coalesce(1).write.mode("append").parquet(f"{at}/in")
    seen: list[list] = []
    source = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    query = earliest_responses(source).writeStream.outputMode("update").option("checkpointLocation", f"{at}/state")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        query.foreachBatch(lambda frame, number: seen.append(frame.collect())).trigger(availableNow=True).start().awaitTermination()
    last = {(r.learner, r["item"]): (int(r.ts.timestamp()), r.event_id, r.correct) for batch in seen for r in batch}
    assert len(seen) >= 3 and last == {(1, 1): (100, 9, 1), (1, 2): (50, 11, 0), (2, 1): (5, 14, 1)}


def test_lists_of_numbers(spark):
    rows = spark.createDataFrame([("1,22,3",), (" 7_3 ,x_1,,9",), ("",), (None,), ("1.5,99999999999999999999",)], "t string")
    got = [(r.a, r.z) for r in rows.select(T.int_list("t", "_").alias("a"), T.zero_failures(T.int_list("t")).alias("z")).collect()]
    assert got == [([1, 22, 3], [1, 22, 3]), ([7, None, None, 9], [0, 0, 0, 9]), ([None], [0]), (None, None), ([None, None], [0, 0])]
