"""Seed tests, increments and the evidence matrix against numpy and by hand."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import pytest

from gaugewell.operators import evidence

LIMITED, UNSEEN, BACKBONES = ("base", "random"), ("base", "random", "length"), ("u", "v")
COLUMNS = "family string, dataset string, model string, backbone string, comparator string, effect double, low double, high double, p_holm double, supported boolean"


def flag_rows(dataset: str, a: bool, b: bool, c: tuple[bool, ...], d: dict[tuple[str, str], bool]) -> list[tuple]:
    """Every flag of one cell; supported ones have the effect 0.1 and p 0.01, others -0.1 and 0.02."""
    row = lambda family, backbone, comparator, ok: (family, dataset, "m", backbone, comparator, 0.1 if ok else -0.1, 0.0, 0.2, 0.01 if ok else 0.02, ok)
    found = [row("A", "-", "-", a), row("B", "-", "-", b)] + [row("C", "u", n, ok) for n, ok in zip(LIMITED, c, strict=True)]
    return found + [row("D", k, n, d.get((k, n), False)) for k in BACKBONES for n in UNSEEN]


def test_labels_of_every_combination(spark):
    whole = {("v", n): True for n in UNSEEN}
    torn = {("u", "base"): True, ("u", "random"): True, ("v", "length"): True}
    cells = list(itertools.product((True, False), (True, False), ((True, True), (True, False)), (whole, torn, {})))
    rows = [r for i, cell in enumerate(cells) for r in flag_rows(str(i), *cell)]
    got = {int(r.dataset): r for r in evidence.matrix(spark.createDataFrame(rows, COLUMNS), LIMITED, UNSEEN, BACKBONES).collect()}
    for i, (a, b, c, d) in enumerate(cells):
        deployed = all(c) or d is whole
        expected = {(True, True, True): evidence.DISTINCTIVE, (True, True, False): evidence.MEASUREMENT, (True, False, True): evidence.PARTIAL}.get((a, b, deployed), evidence.DEPLOYMENT if deployed and not a else evidence.NONE)
        assert (got[i].label, got[i].c_ok, got[i].d_ok, got[i].complete) == (expected, all(c), d is whole, True)
    assert {r.label for r in got.values()} == {evidence.DISTINCTIVE, evidence.PARTIAL, evidence.MEASUREMENT, evidence.DEPLOYMENT, evidence.NONE}


@pytest.mark.parametrize("change", ["missing", "null", "twice"])
def test_a_row_with_a_hole_fails(spark, change):
    rows = flag_rows("x", True, True, (True, True), {})
    if change == "missing":
        rows = rows[:-1]
    elif change == "null":
        rows[3] = (*rows[3][:8], None, False)
    else:
        rows.append(rows[0])
    frame = spark.createDataFrame(rows, COLUMNS)
    with pytest.raises(Exception, match="missing or stands twice: x, m"):
        evidence.matrix(frame, LIMITED, UNSEEN, BACKBONES).collect()
    (row,) = evidence.matrix(frame, LIMITED, UNSEEN, BACKBONES, strict=False).collect()
    assert row.complete == (change == "twice")


def test_audit_and_verdict(spark):
    rows = flag_rows("x", True, True, (False, False), {("u", n): True for n in UNSEEN}) + flag_rows("y", True, False, (False, False), {("v", "base"): True})
    long = spark.createDataFrame(rows, COLUMNS)
    got = evidence.audit(long, UNSEEN).collect()
    assert len(got) == 12 and {(r.dataset, r.backbone) for r in got if r.full_triplet} == {("x", "u")}
    assert {(r.dataset, r.backbone, r.comparator) for r in got if r.direction == "better"} == {("x", "u", n) for n in UNSEEN} | {("y", "v", "base")}
    cells = evidence.matrix(long, LIMITED, UNSEEN, BACKBONES)
    assert evidence.verdict(cells).first().asDict() == {"cells": 2, "distinctive": 1, "partial": 0, "measurement_only": 0, "deployment_only": 0, "none": 1, "verdict": evidence.MIXED}
    assert evidence.verdict(cells.where("dataset = 'x'")).first().verdict == evidence.DISTINCTIVE
    assert evidence.verdict(cells.where("dataset = 'z'")).first().verdict == evidence.NONE


def test_seed_tests_pool_folds_and_average_exposures(spark):
    r = np.random.default_rng(3)
    keys = [(e, c, s, f) for e in ("1", "all") for c in ("base", "m") for s in range(1, 6) for f in range(3)]
    frame = pd.DataFrame([("C", "u", e, "x", c, s, f, int(r.random() < 0.7), float(r.uniform(0.3, 0.99))) for e, c, s, f in keys for _ in range(4 + f)], columns=["family", "backbone", "exposure", "dataset", "condition", "seed", "fold", "y", "p"])
    frame["loss"] = -np.log(np.where(frame.y == 1, frame.p, 1 - frame.p))
    means = frame.groupby(["exposure", "condition", "seed"]).loss.mean().unstack("condition")
    d = (means["base"] - means["m"]).groupby("seed").mean().to_numpy()
    rows = spark.createDataFrame(frame.drop(columns="loss"))
    losses = evidence.pooled_losses(rows, "family", "backbone", "exposure", "dataset", "condition", "seed")
    (got,) = evidence.seed_tests(evidence.comparator_deltas(losses, ("m",), ("base",))).collect()
    se = d.std(ddof=1) / math.sqrt(5)
    assert (got.seeds, got.exposures, got.paired) == (5, 2, True)
    assert np.allclose([got.effect, got.sd, got.low, got.high, got.t], [d.mean(), d.std(ddof=1), d.mean() - evidence.T_DF4 * se, d.mean() + evidence.T_DF4 * se, d.mean() / se])
    # A lost seed leaves no test; a lost fold of one side leaves a test that is not paired.
    few = losses.where("seed < 5")
    (got,) = evidence.seed_tests(evidence.comparator_deltas(few, ("m",), ("base",))).collect()
    assert (got.seeds, got.p, got.p_holm, got.low) == (4, None, None, None) and got.effect is not None
    torn = evidence.pooled_losses(rows.where("NOT (condition = 'base' AND fold = 2 AND seed = 1)"), "family", "backbone", "exposure", "dataset", "condition", "seed")
    (got,) = evidence.seed_tests(evidence.comparator_deltas(torn, ("m",), ("base",))).collect()
    assert got.paired is False and got.p is not None
    assert evidence.seed_tests(evidence.comparator_deltas(losses.where("false"), ("m",), ("base",))).collect() == []


def test_increments_equal_least_squares(spark):
    r = np.random.default_rng(8)
    n = 60
    known, score = r.normal(0, 1, n), r.normal(0, 1, n)
    y = 0.4 * known + 0.5 * score + r.normal(0, 1, n)
    frame = pd.DataFrame({"cell": "a", "item": np.arange(n), "y": y, "k": known, "s": score})
    flat = pd.DataFrame({"cell": "b", "item": np.arange(8), "y": r.normal(0, 1, 8), "k": 1.0, "s": r.normal(0, 1, 8)})
    few = pd.DataFrame({"cell": "c", "item": np.arange(3), "y": [0.0, 1.0, 3.0], "k": [1.0, 2.0, 4.0], "s": [2.0, 1.0, 1.0]})
    rows = spark.createDataFrame(pd.concat([frame, flat, few], ignore_index=True))
    got = {x.cell: x for x in evidence.increments(rows, "y", "k", "s", "item", "cell", replicates=40).collect()}

    def r2(*columns):
        x = np.column_stack([np.ones(n), *columns])
        return 1 - ((y - x @ np.linalg.lstsq(x, y, rcond=None)[0]) ** 2).sum() / ((y - y.mean()) ** 2).sum()

    one, both = r2(known), r2(known, score)
    gain = (1 - (1 - both) * (n - 1) / (n - 3)) - (1 - (1 - one) * (n - 1) / (n - 2))
    a = got["a"]
    assert np.allclose([a.r2_known, a.r2_both, a.gain], [one, both, gain]) and a.low < gain < a.high and a.p == a.p_holm
    # p: twice the upper tail of Student's t at the coefficient's t, by Simpson's rule.
    x = np.column_stack([np.ones(n), known, score])
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    t = abs(beta[2]) / math.sqrt(((y - x @ beta) ** 2).sum() / (n - 3) * np.linalg.inv(x.T @ x)[2, 2])
    at = np.linspace(0, t, 2001)
    density = math.exp(math.lgamma((n - 2) / 2) - math.lgamma((n - 3) / 2)) / math.sqrt((n - 3) * math.pi) * (1 + at**2 / (n - 3)) ** (-(n - 2) / 2)
    assert math.isclose(a.p, 1 - 2 * t / 6000 * (density[0] + density[-1] + 4 * density[1::2].sum() + 2 * density[2:-1:2].sum()), rel_tol=1e-6)
    for cell in "bc":
        assert (got[cell].gain, got[cell].p, got[cell].p_holm) == (None, None, None)
