"""Ranks in buckets, Poisson resamples and isotonic fits against plain numpy."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugewell.operators import association as A
from gaugewell.operators import evaluation, isotonic, mixed_ridge, randomisation, ranking, replicates, resampling


def test_running_totals_do_not_depend_on_buckets(spark):
    r = np.random.default_rng(1)
    frame = pd.DataFrame({"c": r.integers(0, 3, 900), "v": np.round(r.normal(0, 1, 900) ** 3, 2), "n": r.integers(1, 9, 900)}).groupby(["c", "v"], as_index=False).n.sum()
    expected = {(c, v): (int(g.n[g.v < v].sum()), int(g.n.sum())) for c, g in frame.groupby("c") for v in g.v}
    for buckets in (1, 2, 7, 500):
        rows = ranking.running(spark.createDataFrame(frame), "v", ("n",), "c", buckets=buckets).collect()
        assert {(x.c, x.v): (x.n_below, x.n_all) for x in rows} == expected


def test_a_cell_is_spread_over_buckets(spark):
    rows = spark.range(20_000).select(F.lit("one").alias("c"), (F.col("id") * F.col("id")).alias("v"), F.lit(1).alias("n"))
    counts = [x["count"] for x in ranking.bucket_of(rows, "v").groupBy("_bucket").count().collect()]
    assert len(counts) == ranking.BUCKETS and max(counts) < 2 * 20_000 / ranking.BUCKETS
    ranked = ranking.average_rank(rows, "v", "c", name="r")
    assert ranked.where(F.col("r") != F.sqrt(F.col("v").cast("double")) + 1).count() == 0


def test_weighted_rank_correlation_is_that_of_repeated_rows(spark):
    r = np.random.default_rng(2)
    frame = pd.DataFrame({"c": "a", "x": r.integers(0, 12, 200).astype(float), "y": r.integers(0, 9, 200).astype(float), "w": r.integers(0, 4, 200)})
    frame.loc[3, "x"] = None
    rows = spark.createDataFrame(frame).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    more = frame.loc[frame.index.repeat(frame.w)].dropna()
    rho = more.x.rank().corr(more.y.rank())
    found = A.spearman(rows, "x", "y", "c", weight="w").first()
    assert (found.n, found.rho) == (len(more), pytest.approx(rho))
    assert A.weighted_pearson(rows, "x", "y", "w", "c").first().r == pytest.approx(more.x.corr(more.y))


def test_intervals_are_those_of_the_same_counts(spark):
    r = np.random.default_rng(3)
    x = r.normal(0, 1, 60)
    frame = pd.DataFrame({"c": "a", "k": np.arange(60), "x": np.round(x, 1), "y": np.round(x + r.normal(0, 1, 60), 1)})
    edges = np.array(resampling.EDGES)

    def times(k, b):
        digest = hashlib.sha256(f"boot|{k}|{b // 8}".encode()).hexdigest()
        return int((edges <= int(digest[8 * (b % 8) : 8 * (b % 8) + 8], 16)).sum())

    counts = np.array([[times(k, b) for k in range(60)] for b in range(500)])
    assert abs(counts.mean() - 1) < 0.02 and abs(counts.var() - 1) < 0.05
    boots = []
    for row in counts:
        drawn = frame.loc[frame.index.repeat(row)]
        boots.append((drawn.x.corr(drawn.y), drawn.x.rank().corr(drawn.y.rank())))
    low, high = np.percentile(np.array(boots), [2.5, 97.5], axis=0)
    found = resampling.intervals(spark.createDataFrame(frame), "x", "y", "k", "c").first()
    assert [found.r_low, found.rho_low, found.r_high, found.rho_high] == pytest.approx([*low, *high])
    table = resampling.correlation_table(spark.createDataFrame(frame), "x", "y", "k", "c", tau=True, replicates=40).first()
    assert table.rho_low < table.rho < table.rho_high and table.p == pytest.approx(table.p_holm) and table.tau < table.rho


def test_few_rows_and_none(spark):
    rows = spark.createDataFrame([("a", 1, 1.0, 2.0), ("a", 2, 2.0, None)], "c string, k long, x double, y double")
    found = resampling.correlation_table(rows, "x", "y", "k", "c", replicates=20).first()
    assert (found.n, found.rho, found.p, found.p_holm, found.rho_low) == (1, None, None, None, None)
    assert resampling.correlation_table(rows.limit(0), "x", "y", "k", "c", replicates=20).count() == 0
    assert evaluation.roc_auc(spark.createDataFrame([(1, 0.5)], "y int, p double")).first().auc is None


def pooled(x, y, w):
    """Means of max-min over all runs, for distinct sorted x."""
    n = len(x)
    cw, cs = np.concatenate([[0], np.cumsum(w)]), np.concatenate([[0], np.cumsum(w * y)])
    return np.array([max(min((cs[t + 1] - cs[s]) / (cw[t + 1] - cw[s]) for t in range(i, n)) for s in range(i + 1)) for i in range(n)])


def test_isotonic_against_max_min(spark):
    r = np.random.default_rng(4)
    points = []
    for cell in range(3):
        x = np.unique(np.round(r.random(90), 3))
        points += [(cell, float(a), float(n), float(n * (a + s))) for a, n, s in zip(x, r.integers(1, 5, len(x)), r.normal(0, 0.4, len(x)), strict=True)]
    frame = spark.createDataFrame(points, "cell int, x double, weight double, total double")
    blocks = isotonic.fit_isotonic(frame, "cell")
    asked = spark.createDataFrame([(c, float(v)) for c in (0, 1, 2, 9) for v in [-1, 2, *r.random(40)]] + [p[:2] for p in points], "cell int, x double")
    found = isotonic.predict_isotonic(asked, blocks, "x", "cell").collect()
    assert len(found) == 4 * 42 + len(points)
    for cell in range(3):
        own = np.array([p[1:] for p in points if p[0] == cell])
        level = pooled(own[:, 0], own[:, 2] / own[:, 1], own[:, 1])
        for row in (q for q in found if q.cell == cell):
            assert row.fitted == pytest.approx(np.interp(row.x, own[:, 0], level))
    assert all(row.fitted is None for row in found if row.cell == 9)
    assert math.isclose(sum(b.weight for b in blocks.collect()), sum(p[2] for p in points))


def test_sign_test_against_all_sign_choices(spark):
    r = np.random.default_rng(5)
    rows = [("a", k, float(v)) for k, v in enumerate(r.normal(0.4, 1, 12))] + [("b", k, float(v)) for k, v in enumerate(r.normal(0, 1, 9))] + [("b", 99, None), ("c", 1, 0.5)]
    found = {x.c: x for x in randomisation.sign_test(spark.createDataFrame(rows, "c string, k long, d double").repartition(5), "k", "d", "c").collect()}
    for c, n in (("a", 12), ("b", 9), ("c", 1)):
        d = np.array([v for cell, _, v in rows if cell == c and v is not None])
        signs = 1 - 2 * ((np.arange(1 << n)[:, None] >> np.arange(n)) & 1)
        exact = (np.abs(signs @ d) >= abs(d.sum()) - 1e-12).mean()
        assert found[c].n == n and found[c].mean == pytest.approx(d.mean()) and abs(found[c].p - exact) < 5 * max(found[c].se, 1e-5)
        assert found[c].se == pytest.approx(math.sqrt(found[c].p * (1 - found[c].p) / randomisation.REPLICATES))


def test_sign_bits_are_even_and_independent():
    bits = randomisation.sign_bits(np.arange(40), 50_000).astype(float)
    assert np.abs(bits.mean(1) - 0.5).max() < 0.012 and np.abs(np.corrcoef(bits) - np.eye(40)).max() < 0.03


def test_mixed_ridge_against_numpy(spark):
    r = np.random.default_rng(6)
    n = 240
    frame = pd.DataFrame({"c": r.choice(["u", "v"], n), "fold": r.integers(0, 5, n), "a": r.normal(3, 2, n), "b": r.normal(0, 9, n), "k": r.choice(["x", "y", "z"], n), "l": r.choice(["p", "q"], n)})
    frame["t"] = frame.a * 0.5 + (frame.k == "x") + r.normal(0, 1, n)
    frame.loc[r.random(n) < 0.2, "b"] = np.nan
    frame.loc[::17, "k"] = None
    frame.loc[5, "t"] = np.nan
    none = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    given = spark.createDataFrame(frame.astype({"k": object}).where(frame.k.notna() | True)).select("c", "fold", "a", none("b"), "k", "l", none("t"))
    sets = {"one": ("a",), "two": ("a", "b")}
    found = {(x.c, x.spec): x for x in mixed_ridge.increments(mixed_ridge.out_of_fold(given, "t", ("a", "b"), ("k", "l"), sets, "c"), "one", "c").collect()}
    for c, part in frame.dropna(subset=["t"]).groupby("c"):
        scores = {}
        for spec, numbers in sets.items():
            dummies = np.column_stack([(part[q].fillna("None") == v) for q in ("k", "l") for v in sorted(frame[q].fillna("None").unique())]).astype(float)
            off = np.zeros(len(part))
            for fold in range(5):
                train = (part.fold != fold).to_numpy()
                x = part[list(numbers)].to_numpy()
                x = np.where(np.isnan(x), np.nanmedian(x[train], axis=0), x)
                x = np.column_stack([(x - x[train].mean(0)) / x[train].std(0), dummies])
                y, mean = part.t.to_numpy(), x[train].mean(0)
                w = np.linalg.solve((x[train] - mean).T @ (x[train] - mean) + np.eye(x.shape[1]), (x[train] - mean).T @ (y[train] - y[train].mean()))
                off[~train] = (y - y[train].mean() - (x - mean) @ w)[~train]
            scores[spec] = (1 - (off**2).sum() / ((y - y.mean()) ** 2).sum(), math.sqrt((off**2).mean()), np.abs(off).mean())
            row = found[c, spec]
            assert [row.r2, row.rmse, row.mae] == pytest.approx(scores[spec]) and row.n == len(part)
        assert found[c, "two"].delta_mae == pytest.approx(scores["two"][2] - scores["one"][2])
    with pytest.raises(ValueError, match="categories"):
        mixed_ridge.dictionary(spark.range(mixed_ridge.MOST_CATEGORIES + 1), ("id",))


def test_rasch_at_convergence_against_numpy(spark):
    from gaugewell.operators.rasch import fit_rasch, item_flags

    r = np.random.default_rng(7)
    theta, b = r.normal(0, 1, 60), np.linspace(-1.2, 1.2, 9)
    rows = [(i, j, int(r.random() < 1 / (1 + np.exp(b[j] - theta[i])))) for i in range(60) for j in range(9)] + [(i, 50, 1) for i in range(8)] + [(i, 51, 0) for i in range(7)] + [(1, 52, 1)]
    frame = spark.createDataFrame(rows, "learner int, item int, correct int")
    found = {x["item"]: x for x in fit_rasch(frame).collect()}
    # The same likelihood's equations: what each learner and item got is what it should get.
    y = np.full((60, 9), np.nan)
    for i, j, k in rows:
        if j < 9:
            y[i, j] = k
    y = y[(np.nansum(y, 1) > 0) & (np.nansum(y, 1) < 9)]
    t, d = np.zeros(len(y)), np.zeros(9)
    for _ in range(400):
        p = 1 / (1 + np.exp(d - t[:, None]))
        t += (y - p).sum(1) / (p * (1 - p)).sum(1)
        p = 1 / (1 + np.exp(d - t[:, None]))
        d -= (y - p).sum(0) / (p * (1 - p)).sum(0)
        d -= d.mean()
    assert sorted(found) == list(range(9)) and np.abs(np.array([found[j].difficulty for j in range(9)]) - d).max() < 2e-3
    flags = {x["item"]: (x.n, x.perfect, x.zero) for x in item_flags(frame).collect()}
    assert flags[50] == (8, True, False) and flags[51] == (7, False, True) and flags[52] == (1, False, False) and flags[0] == (60, False, False)


def test_replicates_in_arrays_equal_replicates_in_rows(spark):
    # Item k and k + 3000 are copies: 3000 profiles, more values than one batch and one bucket hold, ties, a null and a cell of constant y.
    cells = "inline(array(struct('a' AS c, hash(v) % 2000 / 7D AS x, double(v % 50) AS y), struct('b' AS c, double(v % 4) AS x, 3D AS y), struct('c' AS c, if(v = 5, null, v / 3D) AS x, double(v % 1100) AS y)))"
    rows = spark.range(6000).selectExpr("id AS k", "id % 3000 AS v").selectExpr("k", cells)
    pairs = replicates.counted_pairs(rows, "x", "y", "k", "c", replicates=12)
    assert pairs.count() == 3 * 3000 - 1
    found = resampling.replicated(rows, "x", "y", "k", "c", replicates=12)
    drawn = resampling.poisson_counts(rows, "k", 12)
    for kind, expected in {"rho": A.spearman(drawn, "x", "y", "c", "b", weight="w"), "r": A.weighted_pearson(drawn, "x", "y", "w", "c", "b")}.items():
        got = {(r.c, r.b): r[kind] for r in found[kind].collect()}
        assert len(got) == 36 and got == {(r.c, r.b): pytest.approx(r[kind]) if r.c != "b" else None for r in expected.collect()}


def test_rasch_steps_move_no_row_per_response(spark, monkeypatch):
    from gaugewell.operators import rasch

    sizes = []

    def counted(rows, cut=rasch.cut):
        sizes.append((found := cut(rows)).count())
        return found

    monkeypatch.setattr(rasch, "cut", counted)
    rows = spark.range(2000 * 10).selectExpr("concat('l', id % 2000) AS learner", "id div 2000 AS item", "int(abs(hash(id)) % 12 > id div 2000) AS correct")
    found = [r["item"] for r in rasch.fit_rasch(rows).orderBy("difficulty").collect()]
    assert found == list(range(10)) and max(sizes) <= 2000 + 10 * rasch.RANGES * 4


def test_feature_model_deals_features_anew_and_broadcasts_no_table_of_items(spark, tmp_path):
    from gaugewell.operators import ridge
    from gaugewell.plans.q_models import folded
    from gaugewell.plans.q_more import m13

    r = np.random.default_rng(5)
    part = [(i, "n" * int(r.integers(3, 30)), "b", "t", int(r.integers(1, 50)), float(r.integers(900, 2000))) for i in range(80)]
    spark.createDataFrame(part, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(o, o % 7) for o in range(40)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(x % 40, x % 80, "RNA"[x % 3]) for x in range(400)], "l_orderkey long, l_partkey long, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    plan = lambda frame: frame._jdf.queryExecution().executedPlan().toString()
    found = m13(spark, str(tmp_path))
    assert "SortMergeJoin [item#" in (read := plan(folded(spark, str(tmp_path)))) and "BroadcastHashJoin [item#" not in read
    assert "SortMergeJoin [rank#" in (read := plan(found)) and "BroadcastHashJoin [rank#" not in read and "lineitem" not in read

    order = lambda *name: sorted(range(80), key=lambda i: hashlib.sha256("|".join([*name, str(i)]).encode()).hexdigest())
    low, high = min(p[5] for p in part), max(p[5] for p in part)
    folds = [int(hashlib.sha256(f"2024|{i}".encode()).hexdigest()[:8], 16) % 5 for i in range(80)]
    columns, r2 = {"chars": [len(p[1]) for p in part], "price": [p[5] for p in part], "size": [p[4] for p in part]}, {}
    for cell in ("whole", *columns):
        new = {name: list(values) for name, values in columns.items()}
        if cell != "whole":
            for i, j in zip(order(), order(cell), strict=True):
                new[cell][i] = columns[cell][j]
        rows = [(folds[i], (part[i][5] - low) / (high - low), *(float(new[name][i]) for name in columns), "c") for i in range(80)]
        r2[cell] = ridge.out_of_fold_r2(spark.createDataFrame(rows, "fold int, y double, chars double, price double, size double, cell string"), "y", tuple(columns), "cell").first().r2
    assert {x.feature: (x.r2_whole, x.drop) for x in found.collect()} == {name: (pytest.approx(r2["whole"], abs=2e-6), pytest.approx(r2["whole"] - r2[name], abs=2e-6)) for name in columns}


def test_rasch_keeps_estimates_only_where_ranges_share_few_items(spark, monkeypatch):
    from gaugewell.operators import rasch

    sizes = []

    def counted(rows, cut=rasch.cut):
        sizes.append((found := cut(rows)).count())
        return found

    monkeypatch.setattr(rasch, "cut", counted)
    r = np.random.default_rng(11)
    rows = [(f"l{x // 8}", f"i{r.integers(0, 700)}", int(r.random() < 0.6)) for x in range(16_000)]
    rows += rows[:500] + [(None, f"i{x}", 1) for x in range(30)] + [(f"l{x}", None, x % 2) for x in range(40)] + [(None, None, 0)]
    rows += [(f"l{x}", "all", 1) for x in range(9)] + [(f"l{x}", "none", 0) for x in range(9)] + [("l1", "few", 1)]
    found = {x["item"]: x for x in rasch.fit_items(spark.createDataFrame(rows, "learner string, item string, correct int")).collect()}
    assert max(sizes) <= len(found)  # neither a row per response nor one per item and range of learners

    all_of = pd.DataFrame(rows, columns=["learner", "item", "y"])
    counts = all_of.groupby("item", dropna=False).y.agg(["size", "sum"])
    assert {(None if isinstance(i, float) else i): tuple(x) for i, x in zip(counts.index, counts.to_numpy().tolist(), strict=True)} == {i: (x.n, x.k) for i, x in found.items()}
    kept = all_of.dropna()
    for key in ("item", "learner", "item"):
        n, k = (kept.groupby(key).y.transform(what) for what in ("size", "sum"))
        kept = kept[(n >= 5) & (k > 0) & (k < n)]
    (i, items), (j, learners) = (pd.factorize(kept[c]) for c in ("item", "learner"))
    y, b, t, moved = kept.y.to_numpy(), np.zeros(len(items)), np.zeros(len(learners)), 1
    while moved >= 1e-4:
        p = 1 / (1 + np.exp(b[i] - t[j]))
        t = np.clip(t + np.clip(np.bincount(j, y - p) / np.bincount(j, p * (1 - p)), -1, 1), -6, 6)
        p = 1 / (1 + np.exp(b[i] - t[j]))
        h = np.bincount(i, p * (1 - p))
        new = np.clip(b - np.clip(np.bincount(i, y - p) / h, -1, 1), -6, 6)
        new -= new.mean()
        moved, b = np.abs(new - b).max(), new
    assert {x for x, row in found.items() if row.difficulty is not None} == set(items) and {"all", "none", "few", None}.isdisjoint(items)
    n = np.bincount(i)
    for x, name in enumerate(items):
        row = found[name]
        assert [row.fitted, row.difficulty, row.h] == [n[x], pytest.approx(b[x], abs=1e-9), pytest.approx(h[x], abs=1e-9)]
