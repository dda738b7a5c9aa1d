"""Association, evaluation of predictions, knowledge-tracing views and run statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugewell.functions.hashing import hash_number, hashed
from gaugewell.operators import association as A
from gaugewell.operators import evaluation, isotonic, mixed_ridge, rates, resampling, ridge
from gaugewell.operators.tracing import per_item
from gaugewell.plans.q_rates import FIRST, LEAST, RANK, count_rows, held_out, r6
from gaugewell.plans.q_tables import FRAME_PARTS, PAIR, RUNS, analysis_frame, runs
from gaugewell.plans.registry import Catalog
from gaugewell.sources import views as V
from gaugewell.sources.files import cut

CATALOG = Catalog()
query = CATALOG.query
VIEWS = ("ixs", "scores", "items")
LOSS = "avg(-(y * ln(greatest(least(p, 1 - 1e-6), 1e-6)) + (1 - y) * ln(1 - greatest(least(p, 1 - 1e-6), 1e-6))))"


def rounded(frame: DataFrame) -> DataFrame:
    """Every double rounded to six digits."""
    return frame.select(*[r6(c).alias(c) if t == "double" else F.col(c) for c, t in frame.dtypes])


@query("m1_pearson", V.sql("SELECT model, count(*) AS n, round(corr(score, smoothed), 6) AS r FROM frame GROUP BY model", *VIEWS, **FRAME_PARTS))
def m1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pearson correlation of score and held-out error."""
    return rounded(A.pearson(analysis_frame(spark, sf_dir), "score", "smoothed", "model"))


def _spearman_sql(x: str, y: str, frame: str = "frame", cell: str = "model") -> str:
    return f"SELECT {cell}, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM (SELECT {cell}, {RANK.format(c=cell, x=x)} AS rx, {RANK.format(c=cell, x=y)} AS ry FROM {frame}) GROUP BY {cell}"


@query("m2_spearman_p", V.sql(f"SELECT model, n, round(rho, 6) AS rho, round({resampling.rank_p_sql()}, 6) AS p FROM (" + _spearman_sql("score", "smoothed").replace("round(corr(rx, ry), 6)", "corr(rx, ry)") + ")", *VIEWS, **FRAME_PARTS))
def m2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation with its two-sided p."""
    return rounded(A.with_rank_p(A.spearman(analysis_frame(spark, sf_dir), "score", "smoothed", "model")))


@query("m2_rank_p_values", CATALOG.oracles["m2_spearman_p"])
def m2p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlations with their two-sided p values."""
    return m2(spark, sf_dir)


KENDALL = "SELECT a.{c}, any_value(z.n) AS n, round(sum(sign(b.{x} - a.{x}) * sign(b.{y} - a.{y})) / 2 / sqrt((any_value(z.n) * (any_value(z.n) - 1) / 2.0 - any_value(tx)) * (any_value(z.n) * (any_value(z.n) - 1) / 2.0 - any_value(ty))), 6) AS tau FROM {f} a JOIN {f} b USING ({c}) JOIN (SELECT {c}, count(*) AS n FROM {f} GROUP BY {c}) z USING ({c}) JOIN (SELECT {c}, sum(t * (t - 1) / 2.0) AS tx FROM (SELECT {c}, count(*) AS t FROM {f} GROUP BY {c}, {x}) GROUP BY {c}) USING ({c}) JOIN (SELECT {c}, sum(t * (t - 1) / 2.0) AS ty FROM (SELECT {c}, count(*) AS t FROM {f} GROUP BY {c}, {y}) GROUP BY {c}) USING ({c}) GROUP BY a.{c}"


@query("m3_kendall_tau", V.sql(KENDALL.format(c="model", x="score", y="smoothed", f="frame"), *VIEWS, **FRAME_PARTS))
def m3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kendall's tau-b of score and held-out error."""
    return rounded(A.kendall(analysis_frame(spark, sf_dir), "score", "smoothed", "model"))


def correlated(long: str, cell: str, *views: str, kinds: tuple[str, ...] = ("r", "rho"), tau: bool = False, **more: str) -> str:
    """SQL twin of ``resampling.correlation_table`` over a query of the cell, item, x and y."""
    body, parts = resampling.correlation_sql("long", cell, kinds=kinds, tau=KENDALL.format(c=cell, x="x", y="y", f="long") if tau else None)
    return V.sql(body, *views, **more, long=long, **parts)


@query("m4_bootstrap_corr_ci", V.sql("SELECT model, " + ", ".join(f"round({k}_{e}, 6) AS {k}_{e}" for k in ("r", "rho") for e in ("low", "high")) + " FROM r_ends JOIN rho_ends USING (model)", *VIEWS, **FRAME_PARTS, long="SELECT model, item, score AS x, smoothed AS y FROM frame", **resampling.correlation_sql("long", "model")[1]))
def m4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentile intervals of both correlations over 500 item resamples."""
    return rounded(resampling.intervals(analysis_frame(spark, sf_dir), "score", "smoothed", "item", "model"))


DIFFERENCE = {"long": "SELECT model, item, price, score, smoothed FROM frame JOIN (SELECT item, price FROM items) USING (item)", "counts": resampling.sql_counts("long", "item"), "drawn": "SELECT * FROM long JOIN counts USING (item)"}
for _name in ("price", "smoothed"):
    _ranked = resampling.ranked_sql("score", _name, "drawn", "model, b")
    DIFFERENCE[f"by_{_name}"] = resampling.weighted_sql("rx", "ry", f"({_ranked})", "model, b", f"rho_{_name}")


@query("m5_bootstrap_corr_difference", V.sql("SELECT model, round(quantile_cont(d, 0.025), 6) AS low, round(quantile_cont(d, 0.975), 6) AS high, round(avg(d), 6) AS mean FROM (SELECT model, rho_price - rho_smoothed AS d FROM by_price JOIN by_smoothed USING (model, b)) GROUP BY model", *VIEWS, **FRAME_PARTS, **DIFFERENCE))
def m5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval of the difference of two rank correlations of the score, with a surface feature and with error, on the same resamples."""
    frame = analysis_frame(spark, sf_dir).join(V.items(spark, sf_dir).select("item", "price"), "item")
    sides = [resampling.replicated(frame, "score", y, "item", "model", kinds=("rho",))["rho"].select("model", "b", F.col("rho").alias(f"rho_{y}")) for y in ("price", "smoothed")]
    gap = sides[0].join(sides[1], ["model", "b"]).withColumn("d", F.col("rho_price") - F.col("rho_smoothed"))
    return rounded(resampling.percentiles(gap, "d", "model", low="low", high="high").join(gap.groupBy("model").agg(F.avg("d").alias("mean")), "model"))


def folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item errors of the large log with features, both scores and a hash fold; one row per item."""
    e = rates.error_rates(V.ix_big(spark, sf_dir), "item").select("item", rates.beta_smoothed("n_incorrect", "n").alias("y"))
    s = V.scores(spark, sf_dir).groupBy("item").pivot("model", ["model_a", "model_b"]).agg(F.first("score"))
    f = V.items(spark, sf_dir).select("item", F.length("text").alias("chars"), "price", "size")
    return e.join(per_item(s), "item").join(per_item(f), "item").withColumn("fold", F.pmod(hash_number(hashed(2024, "item")), F.lit(5)).cast("int"))


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`folded` with more features, some of them missing, three categories, and two outcomes as cells."""
    p = V.table(spark, sf_dir, "part")
    number = F.regexp_extract("p_brand", "[0-9]+", 0).cast("int")
    more = p.select(
        F.col("p_partkey").alias("item"), F.length("p_type").alias("kind_chars"), F.length(F.substring_index("p_name", " ", 1)).alias("first_chars"), F.length(F.regexp_replace("p_name", "[^aeiou]", "")).alias("vowels"),
        F.when(number % 7 != 0, number).alias("options"), F.substring("p_brand", 1, 7).alias("format"), F.col("p_type").alias("domain"), F.substring_index("p_name", " ", 1).alias("level"),
    )
    known = V.ixs(spark, sf_dir).where("split = 'train'").groupBy("item").agg(F.log1p(count_rows()).alias("log_train"))
    raw = rates.error_rates(V.ix_big(spark, sf_dir), "item").select("item", "error")
    rows = folded(spark, sf_dir).join(more, "item").join(known, "item", "left").join(raw, "item")
    outcomes = F.array(F.struct(F.lit("smoothed").alias("outcome"), F.col("y").alias("value")), F.struct(F.lit("raw").alias("outcome"), F.col("error").alias("value")))
    return rows.select("fold", *SURFACE, "model_a", "model_b", *CATEGORIES, F.inline(outcomes))


SURFACE = ("chars", "kind_chars", "first_chars", "vowels", "options", "log_train")
CATEGORIES = ("format", "domain", "level")


@query("m9_ridge_delta_r2")
def m9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold fit on six shared numbers without and with each score, and the differences in R2, RMSE and MAE."""
    sets = {"base": SURFACE, "model_a": (*SURFACE, "model_a"), "model_b": (*SURFACE, "model_b")}
    found = mixed_ridge.out_of_fold(mixed(spark, sf_dir).where("outcome = 'smoothed'"), "value", (*SURFACE, "model_a", "model_b"), (), sets, "outcome")
    return rounded(mixed_ridge.increments(found, "base", "outcome").where("spec <> 'base'"))


@query("m6_ridge_oof_increment")
def m6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold R2, RMSE and MAE of four feature sets on numbers and categories, for two outcomes, and their gain over the first."""
    sets = {"A": SURFACE, "B": (*SURFACE, "model_a"), "C": (*SURFACE, "model_b"), "D": (*SURFACE, "model_a", "model_b")}
    found = mixed_ridge.out_of_fold(mixed(spark, sf_dir), "value", (*SURFACE, "model_a", "model_b"), CATEGORIES, sets, "outcome")
    return rounded(mixed_ridge.increments(found, "A", "outcome"))


FEATURES = ("size", "price", "chars", "domain")
FEATURE_LONG = "SELECT model, feature, item, x, score AS y FROM (" + " UNION ALL ".join(f"SELECT item, '{f}' AS feature, {x}::DOUBLE AS x FROM items" for f, x in zip(FEATURES, ("size", "price", "length(text)", "length(domain)"), strict=True)) + ") JOIN scores USING (item)"


def feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item's features as rows, with both scores: item, feature, x, model, score."""
    values = {"size": F.col("size"), "price": F.col("price"), "chars": F.length("text"), "domain": F.length("domain")}
    each = F.array(*[F.struct(F.lit(name).alias("feature"), values[name].cast("double").alias("x")) for name in FEATURES])
    return V.items(spark, sf_dir).select("item", F.inline(each)).join(V.scores(spark, sf_dir), "item")


@query("m12_rq1_feature_bivariate", correlated(FEATURE_LONG, "model, feature", "scores", "items", kinds=("rho",)))
def m12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation of each score with each feature, with interval, p and Holm's p over all."""
    return rounded(resampling.correlation_table(feature_rows(spark, sf_dir), "x", "score", "item", "model", "feature", kinds=("rho",)))


CALIBRATED = {
    "f": "SELECT model, item, score AS x, smoothed::DOUBLE AS y, CAST('0x' || substr(sha256('2024|' || item), 1, 8) AS BIGINT) % 5 AS fold FROM frame",
    "folds": "SELECT unnest(range(0, 5)) AS k",
    "h": "SELECT model, k, x, count(*) AS n, sum(y) AS s FROM f, folds WHERE fold <> k GROUP BY ALL",
    "c": "SELECT *, sum(n) OVER w AS cn, sum(s) OVER w AS cs, row_number() OVER w AS i FROM h WINDOW w AS (PARTITION BY model, k ORDER BY x)",
    "means": "SELECT a.model, a.k, a.i AS first, b.i AS last, (b.cs - a.cs + a.s) / (b.cn - a.cn + a.n) AS m FROM c a JOIN c b ON a.model = b.model AND a.k = b.k AND a.i <= b.i",
    "lows": "SELECT model, k, last AS i, min(m) OVER (PARTITION BY model, k, first ORDER BY last DESC ROWS UNBOUNDED PRECEDING) AS low FROM means",
    "fit": "SELECT c.model, c.k, c.x, g FROM c JOIN (SELECT model, k, i, max(low) AS g FROM lows GROUP BY ALL) USING (model, k, i)",
    "sides": "SELECT f.model, f.item, f.x, f.y, f.fold, max(CASE WHEN fit.x <= f.x THEN fit.x END) AS x0, min(CASE WHEN fit.x >= f.x THEN fit.x END) AS x1 FROM f LEFT JOIN fit ON fit.model = f.model AND fit.k = f.fold GROUP BY ALL",
    "iso": "SELECT s.model, s.item, s.y, CASE WHEN x0 IS NULL THEN b.g WHEN x1 IS NULL OR x1 = x0 THEN a.g ELSE a.g + (b.g - a.g) * (s.x - x0) / (x1 - x0) END AS p FROM sides s LEFT JOIN fit a ON a.model = s.model AND a.k = s.fold AND a.x = x0 LEFT JOIN fit b ON b.model = s.model AND b.k = s.fold AND b.x = x1",
    "lines": "SELECT model, k, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept FROM f, folds WHERE fold <> k GROUP BY ALL",
}


@query("m14_calibration", V.sql("SELECT * FROM (SELECT model, count(*) AS n, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept FROM f GROUP BY model) JOIN (SELECT f.model, round(avg((y - intercept - slope * x) * (y - intercept - slope * x)), 6) AS linear_mse FROM f JOIN lines ON lines.model = f.model AND k = fold GROUP BY f.model) USING (model) JOIN (SELECT model, round(avg(abs(y - p)), 6) AS isotonic_residual, round(avg((y - p) * (y - p)), 6) AS isotonic_mse FROM iso GROUP BY model) USING (model)", *VIEWS, **FRAME_PARTS, **CALIBRATED))
def m14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibration of error on score: the line, its out-of-fold squared error, and those of an out-of-fold isotonic fit."""
    fold = F.pmod(hash_number(hashed(2024, "item")), F.lit(5)).cast("int")
    rows = cut(analysis_frame(spark, sf_dir).select("model", "item", F.col("score").alias("x"), F.col("smoothed").cast("double").alias("y"), fold.alias("fold")))
    # Each point trains the four folds that are not its own.
    others = F.explode(F.filter(F.array(*[F.lit(k) for k in range(5)]), lambda k: k != F.col("fold"))).alias("k")
    train = rows.select("model", "x", "y", others)
    points = train.groupBy("model", "k", "x").agg(count_rows().alias("weight"), F.sum("y").alias("total"))
    fitted = isotonic.predict_isotonic(rows.withColumnRenamed("fold", "k"), isotonic.fit_isotonic(points, "model", "k"), "x", "model", "k")
    lines = train.groupBy("model", "k").agg(F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"))
    off, line = F.col("y") - F.col("fitted"), F.col("y") - F.col("a") - F.col("b") * F.col("x")
    found = fitted.join(lines, ["model", "k"]).groupBy("model").agg(F.avg(line * line).alias("linear_mse"), F.avg(F.abs(off)).alias("isotonic_residual"), F.avg(off * off).alias("isotonic_mse"))
    whole = rows.groupBy("model").agg(count_rows().alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"))
    return rounded(whole.join(found, "model"))


@query("m15_meta_summary", V.sql("SELECT k, round(pooled, 6) AS pooled, round(1 / sqrt(w), 6) AS se, round(q, 4) AS q, round(greatest(0.0, 1 - (k - 1) / q), 4) AS i2, round(greatest(0.0, (q - (k - 1)) / (w - ww / w)), 6) AS tau2, round(low, 6) AS low, round(high, 6) AS high FROM (SELECT count(*) AS k, sum(1 / v) AS w, sum(1 / v / v) AS ww, sum(m / v) / sum(1 / v) AS pooled, sum(m * m / v) - sum(m / v) * sum(m / v) / sum(1 / v) AS q, min(m) AS low, max(m) AS high FROM (SELECT condition, avg(log_loss) AS m, var_samp(log_loss) / count(*) AS v FROM runs GROUP BY condition))", "pred", runs=RUNS))
def m15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inverse-variance pooled loss of the conditions with its error, Cochran's Q, I2, tau2 and the range."""
    each = runs(spark, sf_dir).groupBy("condition").agg(F.avg("log_loss").alias("m"), (F.var_samp("log_loss") / count_rows()).alias("v"))
    m, v = F.col("m"), F.col("v")
    sums = each.agg(count_rows().alias("k"), F.sum(1 / v).alias("w"), F.sum(1 / v / v).alias("ww"), F.sum(m / v).alias("wm"), F.sum(m * m / v).alias("wmm"), F.min("m").alias("low"), F.max("m").alias("high"))
    q, w, df = F.col("wmm") - F.col("wm") * F.col("wm") / F.col("w"), F.col("w"), F.col("k") - 1
    i2, tau2 = F.greatest(F.lit(0.0), 1 - df / q), F.greatest(F.lit(0.0), (q - df) / (w - F.col("ww") / w))
    return sums.select("k", r6(F.col("wm") / w).alias("pooled"), r6(1 / F.sqrt(w)).alias("se"), F.round(q, 4).alias("q"), F.round(i2, 4).alias("i2"), r6(tau2).alias("tau2"), r6("low").alias("low"), r6("high").alias("high"))


AGREED = "SELECT 'x' AS cell, a AS u, b AS v FROM pairs"


@query("m18_model_agreement", V.sql(f"SELECT n, r, rho, tau, signed_gap, gap FROM (SELECT count(*) AS n, round(corr(u, v), 6) AS r, round(avg(u - v), 6) AS signed_gap, round(avg(abs(u - v)), 6) AS gap FROM agreed), (SELECT rho FROM ({_spearman_sql('u', 'v', 'agreed', 'cell')})), (SELECT tau FROM ({KENDALL.format(c='cell', x='u', y='v', f='agreed')}))", "scores", pairs=PAIR, agreed=AGREED))
def m18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of two models: three correlations and mean gaps."""
    p = V.scores(spark, sf_dir).groupBy("item").pivot("model", ["model_a", "model_b"]).agg(F.first("score")).toDF("item", "u", "v").withColumn("cell", F.lit("x"))
    found = p.groupBy("cell").agg(count_rows().alias("n"), F.corr("u", "v").alias("r"), F.avg(F.col("u") - F.col("v")).alias("signed_gap"), F.avg(F.abs(F.col("u") - F.col("v"))).alias("gap"))
    rho, tau = A.spearman(p, "u", "v", "cell").drop("n"), A.kendall(p, "u", "v", "cell").drop("n")
    return rounded(found.join(rho, "cell").join(tau, "cell").drop("cell"))


def compared_sql(one: str, other: str) -> dict[str, str]:
    """SQL of ``rates.compare_errors`` over two queries of item, n and error: the parts, the last of which is ``compared``."""
    common = f"n >= {LEAST} AND n_other >= {LEAST}"
    gap = f"abs(error - error_other)) FILTER (WHERE {common})"
    return {
        "paired": f"SELECT item, n, error, coalesce(n_other, 0) AS n_other, error_other FROM ({one}) LEFT JOIN (SELECT item, n AS n_other, error AS error_other FROM ({other})) USING (item)",
        "common": f"SELECT 'x' AS cell, 1 AS w, error, error_other FROM paired WHERE {common}",
        "rank_agreement": resampling.weighted_sql("rx", "ry", "(" + resampling.ranked_sql("error", "error_other", "common", "cell") + ")", "cell", "rho"),
        "compared": f"SELECT *, (SELECT rho FROM rank_agreement) AS rho, flips / greatest(either, 1)::DOUBLE AS flip_share FROM (SELECT count(*) FILTER (WHERE {common}) AS items, corr(error, error_other) FILTER (WHERE {common}) AS r, quantile_cont(abs(error - error_other), 0.5) FILTER (WHERE {common}) AS median_gap, quantile_cont(abs(error - error_other), 0.95) FILTER (WHERE {common}) AS p95_gap, max({gap} AS max_gap, count(*) FILTER (WHERE n >= {LEAST}) AS eligible_one, count(*) FILTER (WHERE n_other >= {LEAST}) AS eligible_other, count(*) FILTER (WHERE (n >= {LEAST}) <> (n_other >= {LEAST})) AS flips, count(*) FILTER (WHERE n >= {LEAST} OR n_other >= {LEAST}) AS either, count(*) FILTER (WHERE n >= {LEAST} AND n_other < {LEAST}) AS lost FROM paired)",
    }


def smoothed_errors(rows: DataFrame) -> DataFrame:
    """item, n and the smoothed error, to nine digits so that equal errors tie."""
    each = rows.groupBy("item").agg(count_rows().alias("n"), F.sum(1 - F.col("correct")).alias("k"))
    return each.select("item", "n", F.round(rates.beta_smoothed("k", "n"), 9).alias("error"))


ERRORS_OF = "SELECT item, count(*) AS n, round((sum(1 - correct) + 1.0) / (count(*) + 2.0), 9)::DOUBLE AS error FROM {} GROUP BY item"
COMPARED = "items, round(r, 6) AS r, round(rho, 6) AS rho, round(median_gap, 6) AS median_gap, round(p95_gap, 6) AS p95_gap, round(max_gap, 6) AS max_gap, eligible_one, eligible_other, flips, round(flip_share, 6) AS flip_share, lost"


@query("m19_construct_compare", V.sql(f"SELECT {COMPARED}, coalesce(rho < 0.95, true) OR coalesce(median_gap > 0.03, true) OR flip_share > 0.1 AS alarm FROM compared", "ixs", first_seen=FIRST, **compared_sql(ERRORS_OF.format("ixs WHERE split = 'test'"), ERRORS_OF.format("first_seen"))))
def m19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error over all responses against error over first ones: agreement, gaps, items whose eligibility flips, and the alarm."""
    rows = V.ixs(spark, sf_dir).where("split = 'test'")
    found = rates.compare_errors(smoothed_errors(rows), smoothed_errors(rates.first_observed(rows, "ts", "event_id")), LEAST)
    alarm = F.coalesce(F.col("rho") < 0.95, F.lit(True)) | F.coalesce(F.col("median_gap") > 0.03, F.lit(True)) | (F.col("flip_share") > 0.1)
    return rounded(found.withColumn("alarm", alarm))


SEEDED = f"SELECT condition, seed, {LOSS} AS log_loss FROM pred GROUP BY 1, 2"
DELTAS = "SELECT condition, seed, log_loss - base AS d FROM seeded JOIN (SELECT seed, log_loss AS base FROM seeded WHERE condition = 'base') USING (seed) WHERE condition <> 'base'"


def seed_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss of each condition less that of base, by seed: condition, seed, d."""
    s = evaluation.binary_metrics(V.pred(spark, sf_dir), "condition", "seed").select("condition", "seed", "log_loss")
    base = s.where("condition = 'base'").select("seed", F.col("log_loss").alias("base"))
    return s.where("condition <> 'base'").join(base, "seed").select("condition", "seed", (F.col("log_loss") - F.col("base")).alias("d"))


P_DF4 = "2 * (1 - (0.5 + 0.375 * abs(t) / sqrt(1 + t * t / 4) * (1 - t * t / (12 * (1 + t * t / 4)))))"


CONTROLS = ("base", "length", "random")
POOLED = f"SELECT condition, seed, count(*) AS n, {LOSS} AS l FROM pred GROUP BY 1, 2"
CONTRASTS = f"SELECT b.condition AS control, a.condition, a.seed, a.l - b.l AS d, a.n FROM pooled a JOIN pooled b ON a.seed = b.seed AND a.condition <> b.condition WHERE a.condition <> 'base' AND b.condition IN {CONTROLS}"


def contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss of each condition less that of each control, predictions pooled over folds: control, condition, seed, d, n."""
    p = evaluation.binary_metrics(V.pred(spark, sf_dir), "condition", "seed").select("condition", "seed", "n", "log_loss")
    control = p.where(F.col("condition").isin(*CONTROLS)).select("seed", F.col("condition").alias("control"), F.col("log_loss").alias("b"))
    pairs = p.where("condition <> 'base'").join(control, "seed").where("condition <> control")
    return pairs.select("control", "condition", "seed", (F.col("log_loss") - F.col("b")).alias("d"), "n")


@query("m23_paired_deltas", V.sql("SELECT control, condition, round(avg(d), 6) AS mean, round(stddev_samp(d), 6) AS sd, " + ", ".join(f"round(max(d) FILTER (WHERE seed = {s}), 6) AS seed_{s}" for s in V.SEEDS) + " FROM contrasts GROUP BY 1, 2", "pred", pooled=POOLED, contrasts=CONTRASTS))
def m23(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deltas against base, random and length: mean, spread and each seed."""
    by_seed = [F.max(F.when(F.col("seed") == s, F.col("d"))).alias(f"seed_{s}") for s in V.SEEDS]
    return rounded(contrasts(spark, sf_dir).groupBy("control", "condition").agg(F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd"), *by_seed))


@query("m25_trend_slope", V.sql("SELECT round(regr_slope(m, level), 6) AS slope, round(regr_intercept(m, level), 6) AS intercept, round(corr(m, level), 6) AS r FROM (SELECT seed::DOUBLE AS level, avg(log_loss) AS m FROM runs GROUP BY seed)", "pred", runs=RUNS))
def m25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slope of the mean loss over an ordered level."""
    m = runs(spark, sf_dir).groupBy(F.col("seed").cast("double").alias("level")).agg(F.avg("log_loss").alias("m"))
    return rounded(m.agg(F.regr_slope("m", "level").alias("slope"), F.regr_intercept("m", "level").alias("intercept"), F.corr("m", "level").alias("r")))


@query("m27_rank_independence", V.sql("SELECT n, abs(rho) AS strength, abs(rho) < 0.2 AS independent FROM (" + _spearman_sql("a", "b", "(SELECT 'x' AS cell, * FROM pairs)", "cell") + ")", "scores", pairs=PAIR))
def m27(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two scores order items independently."""
    p = V.scores(spark, sf_dir).groupBy("item").pivot("model", ["model_a", "model_b"]).agg(F.first("score")).toDF("item", "a", "b").withColumn("cell", F.lit("x"))
    found = rounded(A.spearman(p, "a", "b", "cell"))
    return found.select("n", F.abs("rho").alias("strength"), (F.abs("rho") < 0.2).alias("independent"))


@query("m30_support_flags", V.sql(f"SELECT condition, CASE WHEN p < 0.05 AND m < 0 THEN 'better' WHEN p < 0.05 AND m > 0 THEN 'worse' ELSE 'null' END AS support FROM (SELECT condition, m, {P_DF4} AS p FROM (SELECT condition, avg(d) AS m, avg(d) / (stddev_samp(d) / sqrt(count(*))) AS t FROM deltas GROUP BY condition))", "pred", seeded=SEEDED, deltas=DELTAS))
def m30(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Better, worse or null for each condition."""
    d = seed_deltas(spark, sf_dir).groupBy("condition").agg(F.avg("d").alias("m"), (F.avg("d") / (F.stddev_samp("d") / F.sqrt(count_rows()))).alias("t"))
    p = A.p_df4(F.col("t"))
    return d.select("condition", F.when((p < 0.05) & (F.col("m") < 0), "better").when((p < 0.05) & (F.col("m") > 0), "worse").otherwise("null").alias("support"))


@query("w12_holm_adjust", V.sql("SELECT condition, round(max(step) OVER (ORDER BY p, condition ROWS UNBOUNDED PRECEDING), 6) AS p_holm FROM (SELECT condition, p, least(1.0, (count(*) OVER () - row_number() OVER (ORDER BY p, condition) + 1) * p) AS step FROM " + f"(SELECT condition, {P_DF4} AS p FROM (SELECT condition, avg(d) / (stddev_samp(d) / sqrt(count(*))) AS t FROM deltas GROUP BY condition)))", "pred", seeded=SEEDED, deltas=DELTAS))
def w12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step-down adjusted p values of the conditions."""
    d = seed_deltas(spark, sf_dir).groupBy("condition").agg((F.avg("d") / (F.stddev_samp("d") / F.sqrt(count_rows()))).alias("t"))
    found = A.holm(d.withColumn("p", A.p_df4(F.col("t"))).withColumn("family", F.lit("f")), "p", "family", ties=("condition",))
    return rounded(found.select("condition", "p_holm"))


@query("a19_seed_trends", V.sql("SELECT condition, round(avg(log_loss), 6) AS log_loss, round(stddev_samp(log_loss), 6) AS log_loss_sd, round(avg(brier), 6) AS brier FROM (SELECT condition, seed, avg(log_loss) AS log_loss, avg(brier) AS brier FROM runs GROUP BY 1, 2) GROUP BY condition", "pred", runs=RUNS))
def a19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and spread of metrics over seeds."""
    s = runs(spark, sf_dir).groupBy("condition", "seed").agg(F.avg("log_loss").alias("log_loss"), F.avg("brier").alias("brier"))
    return rounded(s.groupBy("condition").agg(F.avg("log_loss").alias("log_loss"), F.stddev_samp("log_loss").alias("log_loss_sd"), F.avg("brier").alias("brier")))


@query("t8_strongest_feature", V.sql("SELECT model, arg_max(feature, (abs(rho), feature)) AS feature, round(max(abs(rho)), 6) AS strength FROM (" + resampling.weighted_sql("rx", "ry", "(" + resampling.ranked_sql("x", "y", f"(SELECT *, 1 AS w FROM ({FEATURE_LONG}))", "model, feature") + ")", "model, feature", "rho") + ") WHERE rho IS NOT NULL GROUP BY model", "scores", "items"))
def t8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature that each score goes with most, by rank correlation; of equal ones the last by name."""
    s = A.spearman(feature_rows(spark, sf_dir), "x", "score", "model", "feature").where("rho IS NOT NULL").withColumn("strength", F.abs("rho"))
    return rounded(s.groupBy("model").agg(F.max_by("feature", F.struct("strength", "feature")).alias("feature"), F.max("strength").alias("strength")))


@query("k1_train_error", V.sql("SELECT item, round(coalesce((k + 1.0) / (n + 2.0), (SELECT avg(1 - correct) FROM ixs WHERE split = 'train')), 6) AS train_error, n IS NULL AS unseen FROM items LEFT JOIN (SELECT item, count(*) AS n, sum(1 - correct) AS k FROM ixs WHERE split = 'train' GROUP BY item) USING (item)", "ixs", "items"))
def k1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothed train error of every item; the global mean where it has no train rows."""
    train = V.ixs(spark, sf_dir).where("split = 'train'")
    e = rates.error_rates(train, "item").select("item", "n", rates.beta_smoothed("n_incorrect", "n").alias("own"))
    mean = train.agg(F.avg(1 - F.col("correct")).alias("mean"))
    rows = V.items(spark, sf_dir).select("item").join(e, "item", "left").crossJoin(F.broadcast(mean))  # one row
    return rows.select("item", r6(F.coalesce("own", "mean")).alias("train_error"), F.col("n").isNull().alias("unseen"))


MASKED = "SELECT item, event_id, row_number() OVER (PARTITION BY item ORDER BY sha256(learner || '|' || event_id || '|2024'), event_id) AS r FROM ixs WHERE split = 'train'"


@query("k2_exposure_counts", V.sql("SELECT cap, count(*) AS n_rows, count(DISTINCT item) AS items FROM (SELECT cap, item FROM masked, (SELECT unnest([1, 5, 10, 20]) AS cap) WHERE r <= cap) GROUP BY cap", "ixs", masked=MASKED))
def k2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train rows kept at every cap, from one ranking."""
    rows = V.ixs(spark, sf_dir).where("split = 'train'").withColumn("h", hashed("learner", "event_id", 2024))
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("item").orderBy("h", "event_id"))).where("r <= 20")
    caps = F.explode(F.filter(F.array(*[F.lit(c) for c in (1, 5, 10, 20)]), lambda c: c >= F.col("r"))).alias("cap")
    return ranked.select("item", caps).groupBy("cap").agg(count_rows().alias("n_rows"), F.countDistinct("item").alias("items"))


@query("k3_fold_counts", V.sql("SELECT fold, count(*) FILTER (WHERE split <> 'test' AND item % 5 <> fold) AS train_rows, count(*) FILTER (WHERE split <> 'test' AND item % 5 = fold) AS removed_rows, count(*) FILTER (WHERE split = 'test' AND item % 5 = fold) AS target_rows FROM ixs, (SELECT unnest([0, 1, 2, 3, 4]) AS fold) GROUP BY fold", "ixs"))
def k3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that each item fold trains on, removes and evaluates."""
    rows = V.ixs(spark, sf_dir).select("split", F.pmod("item", F.lit(5)).alias("own"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("fold"))
    test, target = F.col("split") == "test", F.col("own") == F.col("fold")
    return rows.groupBy("fold").agg(F.count_if(~test & ~target).alias("train_rows"), F.count_if(~test & target).alias("removed_rows"), F.count_if(test & target).alias("target_rows"))


@query("k4_scalar_attach", V.sql("SELECT event_id, round(coalesce(score, (SELECT avg(score) FROM s)), 6) AS scalar FROM ix LEFT JOIN s USING (item)", "ix", "scores", s="SELECT item, score FROM scores WHERE model = 'model_a' AND item % 3 <> 0"))
def k4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scalar of every response; the mean where its item has none."""
    s = V.scores(spark, sf_dir).where("model = 'model_a' AND item % 3 <> 0").select("item", "score")
    mean = s.agg(F.avg("score").alias("mean"))
    return V.ix(spark, sf_dir).join(s, "item", "left").crossJoin(F.broadcast(mean)).select("event_id", r6(F.coalesce("score", "mean")).alias("scalar"))  # one row


@query("k5_binary_log_loss_brier_acc", V.sql(f"SELECT condition, count(*) AS n, round({LOSS}, 6) AS log_loss, round(avg((p - y) * (p - y)), 6) AS brier, round(avg(((p >= 0.5)::INT = y)::INT), 6) AS accuracy FROM pred GROUP BY condition", "pred"))
def k5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss, Brier score and accuracy by condition."""
    return rounded(evaluation.binary_metrics(V.pred(spark, sf_dir), "condition"))


@query("k6_roc_auc", V.sql("SELECT condition, round((sum(r) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)), 6) AS auc FROM (SELECT condition, y, rank() OVER (PARTITION BY condition ORDER BY p) + (count(*) OVER (PARTITION BY condition, p) - 1) / 2.0 AS r FROM pred) GROUP BY condition", "pred"))
def k6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area under the ROC curve by condition."""
    return rounded(evaluation.roc_auc(V.pred(spark, sf_dir), "condition"))


EDGES = "[" + ", ".join(repr(i / 10) for i in range(1, 10)) + "]"


@query("k7_expected_calibration_error", V.sql(f"SELECT condition, round(sum(n * abs(mp - my)) / sum(n), 6) AS ece FROM (SELECT condition, bin, count(*) AS n, avg(p) AS mp, avg(y) AS my FROM (SELECT condition, p, y, len(list_filter({EDGES}::DOUBLE[], lambda e: e <= p)) AS bin FROM pred) GROUP BY 1, 2) GROUP BY condition", "pred"))
def k7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected calibration error by condition."""
    return rounded(evaluation.calibration_error(V.pred(spark, sf_dir), "condition"))


@query("k8_oof_pooling", V.sql(f"SELECT condition, seed, count(*) AS n, count(DISTINCT fold) AS folds, count(DISTINCT fold) = 5 AS complete, round({LOSS}, 6) AS log_loss FROM pred GROUP BY 1, 2", "pred"))
def k8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics over all folds of a seed, and whether all folds are there."""
    p = V.pred(spark, sf_dir)
    folds = p.groupBy("condition", "seed").agg(F.countDistinct("fold").alias("folds"))
    m = evaluation.binary_metrics(p, "condition", "seed").select("condition", "seed", "n", "log_loss")
    return rounded(m.join(folds, ["condition", "seed"]).withColumn("complete", F.col("folds") == 5))


@query("k9_pairing_integrity", V.sql("SELECT fold, seed, count(DISTINCT condition) = 4 AS all_conditions, count(DISTINCT n) = 1 AND count(DISTINCT h) = 1 AS paired FROM (SELECT fold, seed, condition, count(*) AS n, sum(CAST('0x' || substr(sha256(event_id || '|' || y), 1, 8) AS BIGINT)) AS h FROM pred GROUP BY 1, 2, 3) GROUP BY 1, 2", "pred"))
def k9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all conditions of a fold and seed have the same outcomes, by order-free hash sums."""
    each = V.pred(spark, sf_dir).groupBy("fold", "seed", "condition").agg(count_rows().alias("n"), F.sum(hash_number(hashed("event_id", "y"))).alias("h"))
    same = (F.countDistinct("n") == 1) & (F.countDistinct("h") == 1)
    return each.groupBy("fold", "seed").agg((F.countDistinct("condition") == 4).alias("all_conditions"), same.alias("paired"))


@query("k10_registry_completeness", V.sql("SELECT condition, seed, fold FROM (SELECT unnest(['base', 'score', 'random', 'length']) AS condition), (SELECT unnest([1, 2, 3, 4, 5]) AS seed), (SELECT unnest([0, 1, 2, 3, 4]) AS fold) WHERE (condition, seed, fold) NOT IN (SELECT (condition, seed, fold) FROM runs WHERE NOT (seed = 3 AND fold = 2))", "pred", runs=RUNS))
def k10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the expected grid without a run; one cell's runs are left out on purpose."""
    done = runs(spark, sf_dir).where("NOT (seed = 3 AND fold = 2)").select("condition", "seed", "fold")
    grid = spark.range(100).select(F.element_at(F.array(*[F.lit(c) for c in V.CONDITIONS]), (F.col("id") % 4 + 1).cast("int")).alias("condition"), (F.floor(F.col("id") / 4) % 5 + 1).cast("int").alias("seed"), F.floor(F.col("id") / 20).cast("int").alias("fold"))
    return grid.join(done, ["condition", "seed", "fold"], "left_anti")


@query("k11_fold_audit", V.sql("SELECT fold, count(*) AS items, sum(CAST('0x' || substr(sha256(item::VARCHAR), 1, 8) AS BIGINT))::BIGINT AS fold_hash FROM (SELECT DISTINCT item, item % 5 AS fold FROM ix_big) GROUP BY fold", "ix_big"))
def k11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and order-free hash of each item fold."""
    i = V.ix_big(spark, sf_dir).select("item").distinct().withColumn("fold", F.pmod("item", F.lit(5)))
    return i.groupBy("fold").agg(count_rows().alias("items"), F.sum(hash_number(hashed("item"))).alias("fold_hash"))


@query("m26_rasch_1pl")
def m26(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rasch difficulties of the items of the large log at convergence; items without a finite one are flagged."""
    from gaugewell.operators.rasch import fit_items, flags

    found = fit_items(V.ix_big(spark, sf_dir)).select("item", "n", *flags(), "difficulty", (1 / F.sqrt("h")).alias("se"))
    return rounded(found.withColumn("identifiable", F.col("difficulty").isNotNull()))
