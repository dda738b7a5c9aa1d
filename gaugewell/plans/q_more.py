"""Bootstrap, permutation, nested selection and condition models."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugewell.functions.hashing import hash_number, hash_rank, hashed
from gaugewell.operators import association as A
from gaugewell.operators import evaluation, randomisation, rates, resampling, ridge
from gaugewell.operators.tracing import per_item
from gaugewell.plans.q_models import DELTAS, P_DF4, SEEDED, VIEWS, correlated, folded, rounded, seed_deltas
from gaugewell.plans.q_rates import FIRST, LEAST, count_rows, r6
from gaugewell.plans.q_tables import FRAME_PARTS, analysis_frame
from gaugewell.plans.registry import Catalog
from gaugewell.sources import views as V
from gaugewell.sources.files import cut

CATALOG = Catalog()
query = CATALOG.query
ALPHAS = (0.01, 0.1, 1.0, 10.0, 100.0)


@query("a26_html_coverage_summary", V.sql("SELECT count(*) AS interacted, count(*) FILTER (WHERE h) AS with_html, round(avg(h::INT), 6) AS item_coverage, round(sum(n) FILTER (WHERE h) / sum(n), 6) AS response_coverage FROM (SELECT i.item, n, page_id IS NOT NULL AS h FROM (SELECT item, count(*) AS n FROM ix_big GROUP BY item) i LEFT JOIN pages ON page_id = i.item)", "ix_big"))
def a26(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interacted items with a page, by item and by response."""
    n = V.ix_big(spark, sf_dir).groupBy("item").agg(count_rows().alias("n"))
    p = V.table(spark, sf_dir, "pages").select(F.col("page_id").alias("item"), F.lit(1).alias("page"))
    h = F.coalesce("page", F.lit(0))
    return n.join(p, "item", "left").agg(count_rows().alias("interacted"), F.sum(h).alias("with_html"), r6(F.avg(h)).alias("item_coverage"), r6(F.sum(h * F.col("n")) / F.sum("n")).alias("response_coverage"))


@query("m7_ridge_standardised_coef")
def m7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge coefficients of all rows, scaled by each feature's standard deviation."""
    import numpy as np
    import pandas as pd

    features = ("chars", "price", "model_a", "model_b")
    grams = ridge.grams(folded(spark, sf_dir).withColumn("cell", F.lit("all")), "y", features, "cell")

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        total = sum(ridge.square(np.asarray(s), len(features) + 2) for s in frame["s"])
        mean = total[0] / total[0, 0]
        spread = np.sqrt(np.maximum(np.diag(total / total[0, 0] - np.outer(mean, mean))[1:-1], 0))
        return pd.DataFrame({"feature": features, "coefficient": ridge.solve(total, 1.0)[1:] * spread})

    return rounded(grams.groupBy("cell").applyInPandas(solve, "feature string, coefficient double"))


@query("m8_ridge_nested_alpha")
def m8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold R2 with the penalty of each outer fold chosen on the other folds."""
    import numpy as np
    import pandas as pd

    features = ("chars", "price", "model_a")
    size = len(features) + 2
    grams = ridge.grams(folded(spark, sf_dir).withColumn("cell", F.lit("all")), "y", features, "cell")

    def error(train: np.ndarray, test: np.ndarray, alpha: float) -> float:
        w = np.concatenate([-ridge.solve(train, alpha), [1.0]])
        return float(w @ test @ w)

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        parts = [ridge.square(np.asarray(s), size) for s in frame["s"]]
        total, rows = sum(parts), []
        for fold, part in zip(frame["fold"], parts, strict=True):
            inner = [p for p in parts if p is not part]
            best = min(ALPHAS, key=lambda a: sum(error(total - part - p, p, a) for p in inner))
            mean = (total - part)[0, -1] / (total - part)[0, 0]
            spread = part[-1, -1] - 2 * mean * part[0, -1] + mean * mean * part[0, 0]
            rows.append((int(fold), best, 1 - error(total - part, part, best) / spread))
        return pd.DataFrame(rows, columns=["fold", "alpha", "r2"])

    return rounded(grams.groupBy("cell").applyInPandas(choose, "fold int, alpha double, r2 double"))


@query("m10_bootstrap_delta_r2")
def m10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentile interval of the R2 increment of a score over hash-weighted item resamples."""
    rows = folded(spark, sf_dir).select("*", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("b"))
    u = hash_number(hashed(F.lit("poisson"), "item", "b")) % 100000 / 100000.0
    # Poisson(1) counts by inversion of the distribution function.
    times = sum(((u >= edge).cast("int") for edge in (0.36788, 0.73576, 0.91970, 0.98101, 0.99634, 0.99941)), F.lit(0))
    drawn = rows.withColumn("times", times).where("times > 0").select("*", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy"))
    base = ridge.out_of_fold_r2(drawn, "y", ("chars", "price"), "b").select("b", F.col("r2").alias("r"))
    more = ridge.out_of_fold_r2(drawn, "y", ("chars", "price", "model_a"), "b").select("b", F.col("r2").alias("s"))
    gap = F.col("s") - F.col("r")
    return rounded(base.join(more, "b").agg(count_rows().alias("replicates"), F.percentile(gap, F.lit(0.025)).alias("low"), F.percentile(gap, F.lit(0.975)).alias("high")))


SIGNS = "SELECT b, abs(avg(CASE WHEN CAST('0x' || substr(sha256('sign|' || b || '|' || item), 1, 8) AS BIGINT) % 2 = 0 THEN d ELSE -d END)) AS s FROM gaps, (SELECT unnest(range(0, 200)) AS b) GROUP BY b"
GAPS = "SELECT item, avg(CASE WHEN condition = 'base' THEN (p - y) * (p - y) ELSE -(p - y) * (p - y) END) AS d FROM pred WHERE condition IN ('base', 'score') GROUP BY item"


@query("m11_label_randomisation_test", V.sql("SELECT round((1 + count(*) FILTER (WHERE s >= o - 1e-12)) / (count(*) + 1.0), 6) AS p, count(*) AS permutations FROM signs, (SELECT abs(avg(d)) AS o FROM gaps)", "pred", gaps=GAPS, signs=SIGNS))
def m11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of label swaps between two conditions, item by item, that reach the observed gap."""
    loss = F.pow(F.col("p") - F.col("y"), 2)
    gaps = V.pred(spark, sf_dir).where("condition IN ('base', 'score')").groupBy("item").agg(F.avg(F.when(F.col("condition") == "base", loss).otherwise(-loss)).alias("d"))
    seen = gaps.agg(F.abs(F.avg("d")).alias("o"))
    swaps = gaps.select("item", "d", F.explode(F.sequence(F.lit(0), F.lit(199))).alias("b"))
    signed = F.when(hash_number(hashed(F.lit("sign"), "b", "item")) % 2 == 0, F.col("d")).otherwise(-F.col("d"))
    each = swaps.groupBy("b").agg(F.abs(F.avg(signed)).alias("s")).crossJoin(F.broadcast(seen))  # one row
    return each.agg(r6((1 + F.count_if(F.col("s") >= F.col("o") - 1e-12)) / (count_rows() + 1.0)).alias("p"), count_rows().alias("permutations"))


@query("m11_randomisation_100k")
def m11_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label swap test at B = 100,000 for six hypotheses, three conditions by two losses against base, with Holm's p."""
    clipped = F.least(F.greatest("p", F.lit(evaluation.CLIP)), F.lit(1 - evaluation.CLIP))
    losses = {"brier": F.pow(F.col("p") - F.col("y"), 2), "log_loss": -(F.col("y") * F.log(clipped) + (1 - F.col("y")) * F.log(1 - clipped))}
    each = F.array(*[F.struct(F.lit(name).alias("loss"), value.alias("v")) for name, value in losses.items()])
    means = V.pred(spark, sf_dir).select("condition", "item", F.inline(each)).groupBy("loss", "item", "condition").agg(F.avg("v").alias("v"))
    base = means.where("condition = 'base'").select("loss", "item", F.col("v").alias("base"))
    gaps = means.where("condition <> 'base'").join(base, ["loss", "item"]).withColumn("d", F.col("base") - F.col("v"))
    found = randomisation.sign_test(gaps, "item", "d", "condition", "loss")
    return rounded(A.holm(found.withColumn("family", F.lit("f")), "p", "family", ties=("condition", "loss")).drop("family"))


@query("m13_rq1_feature_model")
def m13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score as outcome: out-of-fold R2, and its drop when each feature is dealt to items anew."""
    features = ("chars", "price", "size")
    rows = cut(folded(spark, sf_dir).select("item", "fold", "model_b", *features))  # ranked four times; responses are joined once
    dealt = hash_rank(rows, hashed("item"), "item")
    for name in features:
        right = hash_rank(rows.select("item", name), hashed(F.lit(name), "item"), "item").select(F.col(name).alias(f"new_{name}"), "rank")
        dealt = dealt.join(per_item(right), "rank")
    cells = [F.struct(F.lit(cell).alias("cell"), *[F.col(f"new_{name}" if name == cell else name).alias(name) for name in features]) for cell in ("whole", *features)]
    found = ridge.out_of_fold_r2(dealt.select("fold", "model_b", F.inline(F.array(*cells))), "model_b", features, "cell")
    whole = found.where("cell = 'whole'").select(F.col("r2").alias("r2_whole"))
    both = found.where("cell <> 'whole'").crossJoin(F.broadcast(whole))  # one row
    return rounded(both.select(F.col("cell").alias("feature"), "r2_whole", (F.col("r2_whole") - F.col("r2")).alias("drop")))


#: Errors of an item by other responses than its score is tested on in the frame: column, rows, and whether smoothed.
REFERENCES = {
    "test_raw": ("SELECT * FROM ixs WHERE split = 'test'", False), "test_smoothed": ("SELECT * FROM ixs WHERE split = 'test'", True),
    "oracle_smoothed": ("SELECT * FROM ixs", True), "train_smoothed": ("SELECT * FROM ixs WHERE split = 'train'", True),
    "first_raw": ("SELECT * FROM first_seen", False), "first_smoothed": ("SELECT * FROM first_seen", True),
}
LONG = " UNION ALL ".join(
    f"SELECT model, '{name}' AS reference, item, score AS x, round({'(k + 1.0) / (n + 2.0)' if smooth else 'k * 1.0 / n'}, 9)::DOUBLE AS y FROM (SELECT item, count(*) AS n, sum(1 - correct) AS k FROM ({rows}) GROUP BY item HAVING count(*) >= {LEAST}) JOIN scores USING (item)"
    for name, (rows, smooth) in REFERENCES.items()
)


@query("m16_convergent_validity_table", correlated(LONG, "model, reference", "ixs", "scores", tau=True, first_seen=FIRST))
def m16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pearson, Spearman and Kendall correlation of each score with six references, with intervals, p and Holm's p over all."""
    rows = V.ixs(spark, sf_dir)
    test = F.col("split") == "test"
    each = rows.select("item", "correct", F.explode(F.array_compact(F.array(F.lit("oracle"), F.when(test, "test"), F.when(F.col("split") == "train", "train")))).alias("part"))
    first = rates.first_observed(rows.where(test), "ts", "event_id").select("item", "correct", F.lit("first").alias("part"))
    counts = each.unionByName(first).groupBy("part", "item").agg(count_rows().alias("n"), F.sum(1 - F.col("correct")).alias("k")).where(F.col("n") >= LEAST)
    smooth = F.struct(F.concat("part", F.lit("_smoothed")).alias("reference"), F.round(rates.beta_smoothed("k", "n"), 9).alias("y"))
    raw = F.when(F.col("part").isin("test", "first"), F.struct(F.concat("part", F.lit("_raw")).alias("reference"), F.round(F.col("k") / F.col("n"), 9).alias("y")))
    long = counts.select("item", F.inline(F.array_compact(F.array(smooth, raw)))).join(V.scores(spark, sf_dir), "item")
    return rounded(resampling.correlation_table(long, "score", "y", "item", "model", "reference", tau=True))


CRITERIA = f"SELECT 'all' AS criterion, item, count(*) AS n, avg(1 - correct) AS y FROM ixs WHERE split = 'test' GROUP BY item HAVING count(*) >= {LEAST} UNION ALL SELECT 'first', item, count(*), avg(1 - correct) FROM first_seen GROUP BY item HAVING count(*) >= {LEAST} UNION ALL SELECT 'learner', item, count(*), avg(e) FROM (SELECT item, learner, avg(1 - correct) AS e FROM ixs WHERE split = 'test' GROUP BY 1, 2) GROUP BY item HAVING count(*) >= {LEAST}"
SCORED = "SELECT criterion, model, item, n AS records, round(y, 9) AS y, score AS x FROM criteria JOIN scores USING (item)"


@query("m17_criterion_sensitivity", correlated(SCORED, "criterion, model", "ixs", "scores", kinds=("rho",), first_seen=FIRST, criteria=CRITERIA).replace(" FROM stepped", ", least_records, median_records FROM stepped JOIN (SELECT criterion, model, min(records) AS least_records, quantile_cont(records, 0.5)::DOUBLE AS median_records FROM long GROUP BY 1, 2) USING (criterion, model)"))
def m17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation of each score with three error criteria, with interval, p, Holm's p and the records per item."""
    rows = V.ixs(spark, sf_dir).where("split = 'test'")
    wrong = 1 - F.col("correct")
    mean = lambda frame, x: frame.groupBy("item").agg(F.avg(x).alias("y"), count_rows().alias("n")).where(F.col("n") >= LEAST)
    views = {"all": mean(rows, wrong), "first": mean(rates.first_observed(rows, "ts", "event_id"), wrong), "learner": mean(rows.groupBy("item", "learner").agg(F.avg(wrong).alias("e")), F.col("e"))}
    long = reduce(DataFrame.unionByName, [v.select(F.lit(c).alias("criterion"), "item", "n", F.round("y", 9).alias("y")) for c, v in views.items()]).join(V.scores(spark, sf_dir), "item")
    records = long.groupBy("criterion", "model").agg(F.min("n").alias("least_records"), F.percentile("n", F.lit(0.5)).alias("median_records"))
    return rounded(resampling.correlation_table(long, "score", "y", "item", "criterion", "model", kinds=("rho",)).join(records, ["criterion", "model"]))


TESTED = f"SELECT *, {P_DF4} AS p FROM (SELECT condition, count(*) AS n, avg(d) AS m, stddev_samp(d) AS s, avg(d) / (stddev_samp(d) / sqrt(count(*))) AS t FROM deltas GROUP BY condition)"
STEPPED = "SELECT *, least(1.0, (count(*) OVER () - row_number() OVER (ORDER BY p, condition) + 1) * p) AS step FROM tested"


@query("m20_paired_seed_test", V.sql("SELECT condition, n, round(m, 6) AS mean, round(m - 1.96 * s / sqrt(n), 6) AS low, round(m + 1.96 * s / sqrt(n), 6) AS high, round(m / s, 4) AS cohen_d, round(p, 6) AS p, round(max(step) OVER (ORDER BY p, condition ROWS UNBOUNDED PRECEDING), 6) AS p_holm FROM stepped", "pred", seeded=SEEDED, deltas=DELTAS, tested=TESTED, stepped=STEPPED))
def m20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired differences over five seeds: mean, normal interval, Cohen's d, p of the t test, and Holm's over the conditions."""
    mean, sd = F.avg("d"), F.stddev_samp("d")
    half = 1.96 * sd / F.sqrt(count_rows())
    p = A.p_df4(mean / (sd / F.sqrt(count_rows())))
    found = seed_deltas(spark, sf_dir).groupBy("condition").agg(count_rows().alias("n"), mean.alias("mean"), (mean - half).alias("low"), (mean + half).alias("high"), F.round(mean / sd, 4).alias("cohen_d"), p.alias("p"))
    return rounded(A.holm(found.withColumn("family", F.lit("f")), "p", "family", ties=("condition",)).drop("family"))


CONSENSUS = f"SELECT 'all' AS outcome, item, avg(1 - correct) AS y FROM ix GROUP BY item HAVING count(*) >= {LEAST} UNION ALL SELECT 'agreed', item, avg(1 - correct) FROM ix WHERE event_id % 7 = 0 OR (correct = 1) = (response_time < 60) GROUP BY item HAVING count(*) >= {LEAST}"


@query("m28_construct_sensitivity", correlated("SELECT outcome, model, item, round(y, 9) AS y, score AS x FROM criteria JOIN scores USING (item)", "outcome, model", "ix", "scores", kinds=("rho",), criteria=CONSENSUS))
def m28(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rank correlation on all rows and on those whose two sources agree, with interval, p and Holm's p; the outcome is a grouping key."""
    agreed = (F.pmod("event_id", F.lit(7)) == 0) | ((F.col("correct") == 1) == (F.col("response_time") < 60))
    cells = F.array_compact(F.array(F.lit("all"), F.when(agreed, F.lit("agreed"))))
    rows = V.ix(spark, sf_dir).select("item", "correct", F.explode(cells).alias("outcome"))
    long = rows.groupBy("outcome", "item").agg(F.round(F.avg(1 - F.col("correct")), 9).alias("y"), count_rows().alias("n")).where(F.col("n") >= LEAST)
    return rounded(resampling.correlation_table(long.join(V.scores(spark, sf_dir), "item"), "score", "y", "item", "outcome", "model", kinds=("rho",)))


RATED = f"SELECT item, p_size // 10 AS rating, (k + 1.0) / (n + 2.0) AS error FROM part JOIN (SELECT item, count(*) AS n, sum(1 - correct) AS k FROM ix GROUP BY item HAVING count(*) >= {LEAST}) ON p_partkey = item"
CONTRASTED = "SELECT 'error' AS contrast, item, rating AS x, round(error, 9)::DOUBLE AS y FROM rated UNION ALL SELECT model, item, rating, score FROM rated JOIN scores USING (item)"


@query("m29_ordinal_contrast", correlated(CONTRASTED, "contrast", "ix", "scores", kinds=("rho",), tau=True, rated=RATED))
def m29(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation and Kendall's tau of an ordinal rating with error and with each score, with interval, p and Holm's p."""
    e = V.ix(spark, sf_dir).groupBy("item").agg(count_rows().alias("n"), F.sum(1 - F.col("correct")).alias("k")).where(F.col("n") >= LEAST)
    rated = e.join(V.items(spark, sf_dir), "item").select("item", F.floor(F.col("size") / 10).alias("rating"), F.round(rates.beta_smoothed("k", "n"), 9).alias("error"))
    own = rated.select(F.lit("error").alias("contrast"), "item", "rating", F.col("error").alias("y"))
    other = rated.join(V.scores(spark, sf_dir), "item").select(F.col("model").alias("contrast"), "item", "rating", F.col("score").alias("y"))
    return rounded(resampling.correlation_table(own.unionByName(other), "rating", "y", "item", "contrast", kinds=("rho",), tau=True))


@query("k12_two_conditions")
def k12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Next-response models with and without the score, fitted on train learners and scored on test learners."""
    by = Window.partitionBy("learner").orderBy("ts", "event_id")
    rows = V.ixs(spark, sf_dir).join(V.scores(spark, sf_dir).where("model = 'model_a'").select("item", "score"), "item")
    known = rows.where("split = 'train'").groupBy("item").agg(rates.beta_smoothed(F.sum("correct"), count_rows()).alias("item_rate"))
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("lagged", F.lag("correct", 1, 0).over(by)).withColumn("running", F.coalesce(F.avg("correct").over(before), F.lit(0.5)))
    rows = rows.join(known, "item", "left").select("split", F.col("correct").alias("y"), F.col("lagged").cast("double"), "running", F.coalesce("item_rate", F.lit(0.5)).alias("item_rate"), "score")
    rows = cut(rows)  # read by two fits and their scores; the windows over learners are sorted once
    parts = []
    for name, features in (("base", ["lagged", "running", "item_rate"]), ("score", ["lagged", "running", "item_rate", "score"])):
        both = VectorAssembler(inputCols=features, outputCol="features").transform(rows)
        model = LogisticRegression(featuresCol="features", labelCol="y", regParam=0.001, maxIter=25).fit(both.where("split = 'train'"))
        p = model.transform(both.where("split = 'test'")).select(F.lit(name).alias("condition"), "y", vector_to_array("probability")[1].alias("p"))
        parts.append(p)
    whole = cut(parts[0].unionByName(parts[1]))
    return rounded(evaluation.binary_metrics(whole, "condition").join(evaluation.roc_auc(whole, "condition"), "condition"))
