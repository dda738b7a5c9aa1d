"""Request logs, comparisons of error tables and checked splits on small tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugewell.operators import rates, requests

PAIR, ORDER = ("item", "model"), ("at",)
ATTEMPTS = "item long, model string, at int, valid boolean, value double, pilot boolean, cached boolean"


def test_attempts_become_records(spark):
    rows = [
        (1, "m", 1, True, 0.5, False, False),
        (2, "m", 1, False, None, False, False), (2, "m", 2, None, None, False, False), (2, "m", 3, True, 1.5, True, False),
        (3, "m", 1, True, 0.1, True, True), (3, "m", 2, True, 0.2, False, None),
        (4, "m", 1, False, None, None, False),
    ]
    found = requests.records(spark.createDataFrame(rows, ATTEMPTS), PAIR, ORDER)
    got = {(r.item, r.record): (r.retries, r.valid, r.value, r.pilot, r.cached, r.kind, r.calls) for r in found.collect()}
    assert got == {
        (1, 0): (0, True, 0.5, False, False, requests.FIRST_PASS, 1), (2, 0): (2, True, 1.5, False, False, requests.RETRIED, 3), (3, 0): (0, True, 0.1, True, True, requests.PILOT, 0),
        (3, 1): (0, True, 0.2, False, False, requests.FIRST_PASS, 1), (4, 0): (0, False, None, False, False, requests.FIRST_PASS, 1),
    }
    plan = spark.createDataFrame([(i, m) for i in range(1, 6) for m in ("m", "n")], "item long, model string")
    gate = {r.model: r.asDict() for r in requests.parse_gate(plan, found, "model").collect()}
    assert gate["m"] == {"model": "m", "expected": 5, "completed": 5, "valid_first_pass": 3, "valid_after_retry": 4, "failed": 1, "missing_value": 1, "out_of_range": 1, "cache_hits": 1, "pilot_imports": 1, "paid": 3, "status": requests.BLOCKED}
    assert gate["n"]["completed"] == 0 and gate["n"]["status"] == requests.BLOCKED


def one_record(item: int, kind: str = requests.FIRST_PASS, retries: int = 0) -> tuple:
    return (item, "m", 0, retries, True, 0.5, False, kind == requests.PILOT, kind, 0 if kind == requests.PILOT else retries + 1)


@pytest.mark.parametrize(
    ("log", "calls", "reason", "passed"),
    [
        ([one_record(1), one_record(2), one_record(3, requests.PILOT)], 2, "none", True),
        ([one_record(1), one_record(2, requests.RETRIED, 1), one_record(3)], 4, "format_retry", True),
        ([one_record(1), one_record(2), one_record(3), one_record(3)], 5, "accidental_duplicate", False),
        ([one_record(1), one_record(2, requests.RETRIED, 2), one_record(3)], 5, "accounting_error", False),
        ([one_record(1), one_record(2)], 2, "none", False),
        ([], 0, "none", False),
    ],
)
def test_reconciliation_names_the_reason(spark, log, calls, reason, passed):
    plan = spark.createDataFrame([(i, "m") for i in (1, 2, 3)], "item long, model string")
    found = spark.createDataFrame(log, "item long, model string, record int, retries int, valid boolean, value double, cached boolean, pilot boolean, kind string, calls int")
    (row,) = requests.reconcile(plan, found, spark.range(calls).select(F.lit("m").alias("model")), PAIR, "model").collect()
    assert (row.reason, row.passed, row.missing, row.duplicates) == (reason, passed, max(0, 3 - len(log)), len(log) - len({r[0] for r in log}))


def test_compared_errors_equal_pandas(spark):
    r = np.random.default_rng(4)
    one = pd.DataFrame({"item": np.arange(80), "n": r.integers(1, 30, 80), "error": np.round(r.random(80), 2)})
    other = one[one.item % 5 != 0].assign(n=lambda f: f.n - r.integers(0, 4, len(f)), error=lambda f: np.round(np.clip(f.error + r.normal(0, 0.1, len(f)), 0, 1), 2))
    both = one.merge(other, on="item", how="left", suffixes=("", "_o"))
    a, b = both.n >= 10, both.n_o >= 10
    common = both[a & b]
    gap = (common.error - common.error_o).abs()
    got = rates.compare_errors(spark.createDataFrame(one), spark.createDataFrame(other), 10).first()
    assert (got["items"], got.eligible_one, got.eligible_other, got.flips, got.lost) == (len(common), a.sum(), b.sum(), (a != b).sum(), (a & ~b).sum())
    rho = common.error.rank().corr(common.error_o.rank())
    assert np.allclose([got.r, got.rho, got.median_gap, got.p95_gap, got.max_gap, got.flip_share], [common.error.corr(common.error_o), rho, gap.median(), gap.quantile(0.95), gap.max(), (a != b).sum() / (a | b).sum()])
    empty = rates.compare_errors(spark.createDataFrame(one).where("false"), spark.createDataFrame(other), 10).first()
    assert (empty["items"], empty.rho, empty.median_gap, empty.flip_share) == (0, None, None, 0.0)


def test_a_row_without_a_split_raises(spark):
    splits = spark.createDataFrame([("a", "train"), ("b", None)], "learner string, split string")
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), (None, 4)], "learner string, x int")
    assert [tuple(r) for r in rates.attach_split(rows.where("x = 1"), splits).collect()] == [("a", 1, "train")]
    for x, name in ((2, "b"), (3, "c"), (4, "null")):
        with pytest.raises(Exception, match=f"no split for {name}"):
            rates.attach_split(rows.where(f"x = {x}"), splits).collect()
