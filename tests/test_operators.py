"""Edge cases of the operators on hand-made frames."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from gaugewell.functions import text as T
from gaugewell.functions.hashing import hash_rank, hashed, table_fingerprint
from gaugewell.operators import association as A
from gaugewell.operators import evaluation, gates, rates, ridge
from gaugewell.operators.rasch import fit_rasch
from gaugewell.sources import files
from gaugewell.plans import q_gates, q_more
from gaugewell.sources.views import learner_split

X = [1.0, 1.0, 2.0, 2.0, 2.0, 3.0]
Y = [3.0, 3.0, 1.0, 2.0, 2.0, 1.0]


def pairs(spark, x=X, y=Y):
    return spark.createDataFrame([("c", a, b) for a, b in zip(x, y, strict=True)], "cell string, x double, y double")


def test_average_rank_shares_ties(spark):
    rows = A.average_rank(pairs(spark), "x", "cell", name="r").orderBy("x").collect()
    assert sorted(row.r for row in rows) == [1.5, 1.5, 4.0, 4.0, 4.0, 6.0]


def test_spearman_and_kendall_with_ties(spark):
    n, s = len(X), lambda v: (v > 0) - (v < 0)
    score = sum(s(X[j] - X[i]) * s(Y[j] - Y[i]) for i in range(n) for j in range(i + 1, n))
    ties = lambda v: sum(v.count(k) * (v.count(k) - 1) / 2 for k in set(v))
    tau = score / math.sqrt((n * (n - 1) / 2 - ties(X)) * (n * (n - 1) / 2 - ties(Y)))
    assert A.kendall(pairs(spark), "x", "y", "cell").first().tau == pytest.approx(tau)
    assert A.spearman(pairs(spark), "x", "y", "cell").first().rho < 0


def test_flat_or_few_gives_no_correlation(spark):
    assert A.pearson(pairs(spark, [1.0] * 6, Y), "x", "y", "cell").first().r is None
    assert A.pearson(pairs(spark, X[:4], Y[:4]), "x", "y", "cell").first().r is None


def test_complement_flips_the_sign(spark):
    one = A.spearman(pairs(spark), "x", "y", "cell").first().rho
    other = A.spearman(pairs(spark).withColumn("y", -F.col("y")), "x", "y", "cell").first().rho
    assert one == pytest.approx(-other)


def test_holm(spark):
    rows = spark.createDataFrame([("f", p) for p in (0.01, 0.04, 0.03, 0.005)], "family string, p double")
    found = {round(r.p, 3): round(r.p_holm, 4) for r in A.holm(rows, "p", "family").collect()}
    assert found == {0.01: 0.03, 0.04: 0.06, 0.03: 0.06, 0.005: 0.02}


def test_t_tail(spark):
    rows = spark.createDataFrame([(2.7764451052, 4.0), (2.2281388520, 10.0), (None, 3.0)], "t double, df double")
    found = [r.p for r in rows.select(A.t_two_sided_p("t", "df").alias("p")).collect()]
    assert found[0] == pytest.approx(0.05, abs=1e-8) and found[1] == pytest.approx(0.05, abs=1e-8) and found[2] is None
    assert rows.limit(1).select(A.p_df4(F.col("t")).alias("p")).first().p == pytest.approx(0.05, abs=1e-7)


def predictions(spark, rows):
    return spark.createDataFrame([("c", y, p) for y, p in rows], "cell string, y int, p double")


def test_one_class_has_no_auc_but_a_loss(spark):
    rows = predictions(spark, [(1, 0.5), (1, 1.0)])
    assert evaluation.roc_auc(rows, "cell").first().auc is None
    assert math.isfinite(evaluation.binary_metrics(rows, "cell").first().log_loss)


def test_auc_counts_ties_half(spark):
    assert evaluation.roc_auc(predictions(spark, [(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)]), "cell").first().auc == pytest.approx(0.875)


def test_calibration_bins_use_double_edges(spark):
    rows = predictions(spark, [(1, 0.3), (0, 0.6), (1, 0.7), (1, 1.0)])
    expected = sum(abs(p - y) for y, p in [(1, 0.3), (0, 0.6), (1, 0.7), (1, 1.0)]) / 4
    assert evaluation.calibration_error(rows, "cell").first().ece == pytest.approx(expected)


def test_first_observed_needs_an_order(spark):
    rows = spark.createDataFrame([(1, 1, 2, 0), (1, 1, 1, 1), (1, 2, 3, 0)], "learner int, item int, t int, correct int")
    assert {(r.item, r.t) for r in rates.first_observed(rows, "t").collect()} == {(1, 1), (2, 3)}


def test_prior_falls_back(spark):
    rows = spark.createDataFrame([("a", 0.5)], "item string, error double")
    assert tuple(rates.empirical_prior(rows).first()) == (1.0, 1.0)


@pytest.mark.parametrize("width", ["1", "4", "16"])
def test_split_is_the_same_for_any_width(spark, width):
    spark.conf.set("spark.sql.shuffle.partitions", width)
    try:
        learners = spark.range(100).select(F.col("id").alias("learner"))
        found = {r.split: r["count"] for r in learner_split(learners).groupBy("split").count().collect()}
        assert found == {"train": 70, "val": 10, "test": 20}
        ranks = sorted(r["rank"] for r in hash_rank(learners, hashed("learner"), "learner").collect())
        assert ranks == list(range(100))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_fingerprint_ignores_order_and_sees_change(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "a int, b string")
    assert table_fingerprint(a).first() == table_fingerprint(a.orderBy(F.desc("a"))).first()
    assert table_fingerprint(a).first() != table_fingerprint(a.withColumn("a", F.col("a") + 1)).first()


def test_unequal_lists_are_cut_to_the_shortest(spark):
    rows = spark.createDataFrame([("l", "1,2,3", "0,1")], "learner string, q string, r string")
    assert [(r.pos, r.item, r.correct) for r in files.explode_wide(rows, "learner", {"item": "q", "correct": "r"}).collect()] == [(0, "1", "0"), (1, "2", "1")]


def test_projection_checks(spark):
    rows = spark.createDataFrame([(1, 2)], "a int, answer int")
    with pytest.raises(ValueError):
        files.allowed(rows, ("a",), denied=("answer",))
    with pytest.raises(ValueError):
        files.crosswalk(rows, {"b": ("none",)})


def test_latest_row_of_a_run_wins(spark):
    rows = spark.createDataFrame([("r", 1, 0.1)], "run string, batch int, m double")
    assert files.upsert(rows, rows.withColumn("batch", F.lit(2)).withColumn("m", F.lit(0.2)), "run", "batch").first().m == 0.2


def test_score_strings(spark):
    cases = {"0.42": 0.42, ".5": 0.5, "1.0": 1.0, "10": 1.0, "0": 0.0, "none": None, "score 0.7 of 1": 0.7, None: None}
    rows = spark.createDataFrame([(k,) for k in cases], "text string").select("text", T.parse_score(F.col("text")).alias("s"))
    assert {r.text: r.s for r in rows.collect()} == cases


def test_html_cleaning(spark):
    page = "<script>var a='</p>';</script><p>a &lt; b</p>\n<style>x</style> c"
    assert spark.createDataFrame([(page,)], "h string").select(T.html_to_text(F.col("h")).alias("t")).first().t == "a < b c"


def test_grades(spark):
    rows = spark.createDataFrame([(0.9, 0.4)], "a double, b double")
    assert rows.select(gates.worst(gates.graded(F.col("a"), 0.8, 0.5), gates.graded(F.col("b"), 0.8, 0.5)).alias("w")).first().w == "FAIL"


def test_ridge_finds_a_line_and_survives_a_flat_feature(spark):
    rows = spark.range(200).select(F.lit("c").alias("cell"), (F.col("id") % 5).cast("int").alias("fold"), (F.col("id") * 1.0).alias("x"), F.lit(1.0).alias("flat"), (F.col("id") * 2.0 + 1).alias("y"))
    assert ridge.out_of_fold_r2(rows, "y", ("x", "flat"), "cell", alpha=0.001).first().r2 > 0.999


def test_rasch_orders_items_and_drops_extremes(spark):
    rows = [(f"l{i}", item, int((i * 7 + k * 3) % 20 < cut)) for i in range(30) for item, cut in (("easy", 17), ("hard", 4)) for k in range(4)] + [(f"l{i}", "always", 1) for i in range(30)]
    found = {r["item"]: r.difficulty for r in fit_rasch(spark.createDataFrame(rows, "learner string, item string, correct int")).collect()}
    assert set(found) == {"easy", "hard"} and found["hard"] > found["easy"]


@pytest.mark.parametrize("values", [3, 40, 1000])
def test_kendall_equals_all_pairs(spark, values):
    import random

    draw = random.Random(values)
    rows = [(f"c{i % 2}", draw.randrange(values), draw.randrange(values) / 7) for i in range(300)]
    found = {r.cell: (r.n, r.tau) for r in A.kendall(spark.createDataFrame(rows, "cell string, x int, y double"), "x", "y", "cell").collect()}
    sign = lambda a: (a > 0) - (a < 0)
    for cell in ("c0", "c1"):
        own = [(x, y) for c, x, y in rows if c == cell]
        pairs = [(sign(a[0] - b[0]), sign(a[1] - b[1])) for i, a in enumerate(own) for b in own[:i]]
        scale = (sum(x != 0 for x, _ in pairs) * sum(y != 0 for _, y in pairs)) ** 0.5
        assert found[cell] == (len(own), pytest.approx(sum(x * y for x, y in pairs) / scale))


def test_split_sizes_are_exact_where_doubles_are_not(spark):
    for n, sizes in ((90, {"train": 63, "val": 9, "test": 18}), (170, {"train": 119, "val": 17, "test": 34})):
        found = {r.split: r["count"] for r in learner_split(spark.range(n).withColumnRenamed("id", "learner")).groupBy("split").count().collect()}
        assert found == sizes


SMALL = "/root/testdata/sf0.001"


def test_admission_gates_expand_no_rows_and_broadcast_no_items(spark):
    plan = q_gates.g6(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and "BroadcastHashJoin [item#" not in plan


def test_condition_models_are_scored_on_rows_that_are_cut(spark):
    assert "learner#" not in q_more.k12(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
