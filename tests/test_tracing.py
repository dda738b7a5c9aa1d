"""Knowledge-tracing views against a plain Python build, the logistic grid against a numpy fit."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugewell.operators import evaluation, tracing
from gaugewell.operators.logistic_grid import Grid

FOLDS, LONG, SHARE = 3, 4, 0.4
ROWS = "learner long, item long, event_id long, ts long, correct int, split string"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def log_rows() -> list[tuple]:
    """Twelve learners over nine items with repeats and equal times; learner 0 holds a third of all rows."""
    rng = np.random.default_rng(5)
    split = {n: ("train", "train", "val", "test")[n % 4] for n in range(12)}
    who = [0] * 60 + [int(n) for n in rng.integers(1, 12, 120)]
    return [(n, int(rng.integers(0, 9)), e, int(rng.integers(0, 30)), int(rng.random() < 0.7), split[n]) for e, n in enumerate(who)]


@pytest.fixture(scope="module")
def tables(spark):
    rows = spark.createDataFrame(log_rows(), ROWS)
    # Item 8 is in no fold: its rows are left out. Item 20 has no rows.
    folds = spark.createDataFrame([(i, i % FOLDS) for i in (*range(8), 20)], "item long, fold int")
    return rows, folds


def by_learner(rows: list[tuple]) -> dict[tuple, list[tuple]]:
    found: dict[tuple, list[tuple]] = {}
    for row in sorted(rows, key=lambda r: (r[3], r[2])):
        found.setdefault((row[5], row[0]), []).append(row)
    return found


def plain_cold_start(rows: list[tuple], items: list[int]) -> set[tuple]:
    out = set()
    rows = [r for r in rows if r[1] in items]
    for fold in range(FOLDS):
        seen = sorted((i for i in items if i % FOLDS != fold), key=lambda i: sha(str(i)))
        index = {i: n + 2 for n, i in enumerate(seen)}
        for (split, learner), history in by_learner(rows).items():
            if split == "test":
                cut, before = history[:LONG], set()
                if any(r[1] % FOLDS == fold for r in cut):
                    for position, r in enumerate(cut):
                        target = r[1] % FOLDS == fold
                        out.add((fold, split, learner, position, r[2], r[1], index.get(r[1], 1), r[4], target and r[1] not in before, target))
                        before.add(r[1])
            else:
                for position, r in enumerate([r for r in history if r[1] % FOLDS != fold][:LONG]):
                    draw = int(sha(f"{learner}|{position}|{index[r[1]]}|7|dropout")[:12], 16) % 10000 / 10000
                    out.add((fold, split, learner, position, r[2], r[1], 1 if draw < SHARE else index[r[1]], r[4], True, True))
    return out


def test_cold_start_view_and_proof(spark, tables):
    rows, folds = tables
    view = tracing.cold_start_view(rows, folds, FOLDS, max_len=LONG, dropout=SHARE, seed=7)
    expected = plain_cold_start(log_rows(), [*range(8), 20])
    got = [tuple(r) for r in view.collect()]
    assert len(got) == len(set(got)) and set(got) == expected
    proof = {r.fold: r for r in tracing.cold_start_proof(rows, folds, view, FOLDS).collect()}
    for fold in range(FOLDS):
        assert proof[fold].clean and proof[fold].target_items == 3 and proof[fold].seen_items == 6 and proof[fold].target_fit_rows == 0
        assert proof[fold].removed_rows == sum(r[5] != "test" and r[1] < 8 and r[1] % FOLDS == fold for r in log_rows())
        assert proof[fold].all_rows == sum(r[0] == fold and r[1] == "test" and r[9] for r in expected)
    leaked = view.unionByName(view.where("split = 'test' AND eval_all").withColumn("split", F.lit("train")).withColumn("item_index", F.lit(5).cast("long")))
    assert not any(r.clean for r in tracing.cold_start_proof(rows, folds, leaked, FOLDS).collect())


def test_response_limited_view(spark, tables):
    rows, folds = tables
    exposures = (0, 1, 3, "warm")
    got = {tuple(r) for r in tracing.response_limited_view(rows, folds, exposures, max_len=LONG, seed=7).collect()}
    items, plain = [*range(8), 20], set()
    index = {i: n + 1 for n, i in enumerate(sorted(items, key=lambda i: sha(str(i))))}
    known = [r for r in log_rows() if r[1] in items]
    for exposure in (*exposures, "any"):
        pairs = set()
        for i in items:
            ranked = sorted((r for r in known if r[1] == i and r[5] == "train"), key=lambda r: (sha(f"{r[0]}|{r[2]}|7"), r[2]))
            pairs |= {(r[0], i) for r in ranked[: exposure if isinstance(exposure, int) else None]}
        kept = [r for r in known if (r[5] != "train" if exposure == "any" else r[5] == "train" and (r[0], r[1]) in pairs)]
        for (split, learner), history in by_learner(kept).items():
            plain |= {(str(exposure), split, learner, n, r[2], r[1], index[r[1]], r[4]) for n, r in enumerate(history[:LONG])}
    assert got == plain and not any(r[0] == "0" for r in got)


def test_views_of_no_rows(spark, tables):
    rows, folds = tables
    empty = rows.limit(0)
    assert tracing.cold_start_view(empty, folds, FOLDS).count() == 0
    assert tracing.response_limited_view(empty, folds).count() == 0
    assert {r.value for r in tracing.train_errors(empty, folds).collect()} == {None}


def test_sequences_are_cut_before_the_shuffle(tables):
    rows, folds = tables
    plan = tracing.cold_start_view(rows, folds, FOLDS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 4 and "Partial" in plan


def numpy_fit(z: np.ndarray, y: np.ndarray, w: np.ndarray, penalty: float) -> np.ndarray:
    """Plain gradient descent, long enough."""
    beta, kept = np.zeros(z.shape[1]), np.array([0.0] + [1.0] * (z.shape[1] - 1))
    for _ in range(60_000):
        p = 1 / (1 + np.exp(-z @ beta))
        beta += 0.5 * (z.T @ (w * (y - p)) / w.sum() - penalty * kept * beta)
    return beta


def test_grid_equals_plain_fits(spark):
    rng = np.random.default_rng(3)
    n = 400
    x, s, w = rng.normal(size=(n, 2)), rng.random((n, 1)), rng.poisson(1, (n, 2))
    y = (rng.random(n) < 1 / (1 + np.exp(-(0.5 + x[:, 0] - 2 * s[:, 0])))).astype(int)
    level = np.where(np.arange(n) % 3 == 0, "1", "warm")
    rows = spark.createDataFrame([(str(level[i]), int(y[i]), x[i].tolist(), s[i].tolist(), w[i].tolist()) for i in range(n)], "exposure string, y int, x array<double>, s array<double>, w array<int>")
    grid = Grid(("0", "1", "warm"), ("base", "score"), 2, 2, penalty=0.01).fit(rows.repartition(5))
    assert grid.steps < 12 and not grid.beta[0].any()
    for e, name in ((1, "1"), (2, "warm")):
        at = level == name
        for k in range(2):
            base = np.column_stack([np.ones(at.sum()), x[at]])
            assert grid.beta[e, 0, k, :3] == pytest.approx(numpy_fit(base, y[at], w[at, k], 0.01), abs=1e-5) and grid.beta[e, 0, k, 3] == 0
            assert grid.beta[e, 1, k] == pytest.approx(numpy_fit(np.column_stack([base, s[at]]), y[at], w[at, k], 0.01), abs=1e-5)
    counts = grid.histograms(rows)
    whole = counts.where("exposure = 'warm' AND condition = 'score' AND seed = 2").agg(F.sum("zeros").alias("a"), F.sum("ones").alias("b")).first()
    assert (whole.a, whole.b) == (int((y[level == "warm"] == 0).sum()), int(y[level == "warm"].sum()))


def test_grid_with_separable_or_no_rows(spark):
    kind = "exposure string, y int, x array<double>, s array<double>, w array<int>"
    apart = spark.createDataFrame([("warm", int(i >= 20), [float(i)], [0.0], [1]) for i in range(40)], kind)
    assert np.isfinite(Grid(("warm",), ("base", "score"), 1, 1).fit(apart).beta).all()
    assert not Grid(("warm",), ("base", "score"), 1, 1).fit(apart.limit(0)).beta.any()
    assert Grid(("warm",), ("base", "score"), 1, 1).histograms(apart.limit(0)).count() == 0


def test_metrics_from_a_histogram(spark):
    rng = np.random.default_rng(8)
    rows = spark.createDataFrame([("c" if i % 3 else "d", float(round(p, 2)), int(rng.random() < p)) for i, p in enumerate(rng.random(600))] + [("one", 1.0, 1), ("one", 0.0, 1)], "cell string, p double, y int")
    counts = rows.groupBy("cell", "p").agg(F.sum(1 - F.col("y")).alias("zeros"), F.sum("y").alias("ones"))
    got = {r.cell: r for r in evaluation.histogram_metrics(counts, "cell").collect()}
    plain = evaluation.binary_metrics(rows, "cell").join(evaluation.roc_auc(rows, "cell"), "cell").join(evaluation.calibration_error(rows, "cell"), "cell")
    for row in plain.collect():
        for name in ("n", "log_loss", "brier", "accuracy", "auc", "ece"):
            assert getattr(got[row.cell], name) == (None if row[name] is None else pytest.approx(row[name]))


def test_tables_of_all_items_are_never_broadcast(spark):
    rows = spark.createDataFrame([(1, 3, 1, 1, "train", 5), (2, 4, 2, 0, "test", 6)], ROWS.replace("ts long, correct int, split string", "correct int, split string, ts int"))
    folds = spark.range(20).select(F.col("id").alias("item"), F.pmod("id", F.lit(5)).cast("int").alias("fold"))
    view = tracing.cold_start_view(rows, folds, 5)
    for frame in (view, tracing.cold_start_proof(rows, folds, view, 5), tracing.response_limited_view(rows, folds)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin [item#" in plan and "BroadcastHashJoin [item#" not in plan
