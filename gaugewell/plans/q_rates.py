"""Aggregations, windows and the flagship slice over interactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugewell.functions.hashing import hash_number, hash_rank, hashed
from gaugewell.operators import association, rates, stability
from gaugewell.plans.registry import Catalog
from gaugewell.sources import views as V

CATALOG = Catalog()
query = CATALOG.query
LEAST = 10


def count_rows() -> Column:
    """Number of rows of a group."""
    return F.count(F.lit(1))


def r6(x: Column | str) -> Column:
    """Rounded to six digits."""
    return F.round(x, 6)


FIRST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY learner, item ORDER BY ts, event_id) AS place FROM ixs WHERE split = 'test') WHERE place = 1"
FIRST_ERROR = "SELECT item, count(*) AS n, sum(1 - correct) AS n_incorrect, (sum(1 - correct) + 1.0) / (count(*) + 2.0) AS smoothed FROM first_seen GROUP BY item"
RANK = "rank() OVER (PARTITION BY {c} ORDER BY {x}) + (count(*) OVER (PARTITION BY {c}, {x}) - 1) / 2.0"


def held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error of test learners' first responses, smoothed: item, n, n_incorrect, smoothed."""
    first = rates.first_observed(V.ixs(spark, sf_dir).where("split = 'test'"), "ts", "event_id")
    found = first.groupBy("item").agg(count_rows().alias("n"), F.sum(1 - F.col("correct")).alias("n_incorrect"))
    return found.withColumn("smoothed", rates.beta_smoothed("n_incorrect", "n"))


@query("slice_score_agreement", V.sql(
    f"SELECT model, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM (SELECT model, {RANK.format(c='model', x='score')} AS rx, {RANK.format(c='model', x='smoothed')} AS ry FROM errors JOIN scores USING (item) WHERE n >= {LEAST}) GROUP BY model",
    "ixs", "scores", first_seen=FIRST, errors=FIRST_ERROR))
def slice_score_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation of each score with held-out first-response error."""
    return score_agreement(spark, sf_dir)


def score_agreement(spark: SparkSession, sf_dir: str, least: int = LEAST) -> DataFrame:
    """The agreement over items with at least ``least`` first responses: model, n, rho."""
    frame = held_out(spark, sf_dir).where(F.col("n") >= least).join(V.scores(spark, sf_dir), "item")
    return association.spearman(frame, "score", "smoothed", "model").withColumn("rho", r6("rho"))


@query("a1_item_error_rate", V.sql("SELECT item, count(*) AS n, sum(correct) AS n_correct, count(DISTINCT learner) AS learners, count(*) - sum(correct) AS n_incorrect, round((count(*) - sum(correct)) / count(*), 6) AS error FROM ix_big GROUP BY item", "ix_big"))
def a1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item error rates of the large log."""
    return rates.error_rates(V.ix_big(spark, sf_dir), "item").withColumn("error", r6("error"))


@query("a2_beta_smoothing", V.sql("SELECT item, round((k + 1.0) / (n + 2.0), 6) AS beta_1_1, round((k + 2.0) / (n + 4.0), 6) AS beta_2_2 FROM (SELECT item, count(*) AS n, sum(1 - correct) AS k FROM ix_big GROUP BY item)", "ix_big"))
def a2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothed error under two priors."""
    e = rates.error_rates(V.ix_big(spark, sf_dir), "item")
    return e.select("item", r6(rates.beta_smoothed("n_incorrect", "n")).alias("beta_1_1"), r6(rates.beta_smoothed("n_incorrect", "n", 2, 2)).alias("beta_2_2"))


PRIOR = "SELECT {k} CASE WHEN c >= 2 AND v > 0 AND m * (1 - m) / v - 1 > 0 THEN greatest(m * (m * (1 - m) / v - 1), 0.1) ELSE 1.0 END AS alpha, CASE WHEN c >= 2 AND v > 0 AND m * (1 - m) / v - 1 > 0 THEN greatest((1 - m) * (m * (1 - m) / v - 1), 0.1) ELSE 1.0 END AS beta FROM (SELECT {k} avg(e) AS m, var_samp(e) AS v, count(*) AS c FROM (SELECT {k} least(greatest(error, 1e-6), 1 - 1e-6) AS e FROM rate){g})"


@query("a3_empirical_bayes_prior", V.sql("SELECT item, round((k + alpha) / (n + alpha + beta), 6) AS smoothed FROM rate, prior", "ix_big", rate="SELECT item, count(*) AS n, sum(1 - correct) AS k, avg(1 - correct) AS error FROM ix_big GROUP BY item", prior=PRIOR.format(k="", g="")))
def a3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error smoothed by the items' own prior."""
    e = rates.error_rates(V.ix_big(spark, sf_dir), "item")
    both = e.crossJoin(F.broadcast(rates.empirical_prior(e)))  # one row
    return both.select("item", r6((F.col("n_incorrect") + F.col("alpha")) / (F.col("n") + F.col("alpha") + F.col("beta"))).alias("smoothed"))


@query("a4_multi_scope_reference", V.sql("SELECT scope, item, count(*) AS n, sum(correct) AS n_correct, count(*) - sum(correct) AS n_incorrect, round(avg(1 - correct), 6) AS error, round((sum(1 - correct) + 1.0) / (count(*) + 2.0), 6) AS smoothed FROM (SELECT split AS scope, item, correct FROM ixs UNION ALL SELECT 'all', item, correct FROM ixs) GROUP BY scope, item", "ixs"))
def a4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References for every split and for all learners, in one grouping of exploded scopes."""
    rows = V.ixs(spark, sf_dir).select("item", "learner", "correct", F.explode(F.array("split", F.lit("all"))).alias("scope"))
    e = rates.error_rates(rows, "scope", "item")
    return e.select("scope", "item", "n", "n_correct", "n_incorrect", r6("error").alias("error"), r6(rates.beta_smoothed("n_incorrect", "n")).alias("smoothed"))


@query("a5_student_weighted_error", V.sql("SELECT item, count(*) AS learners, round(avg(e), 6) AS error, round((avg(e) * count(*) + 1) / (count(*) + 2), 6) AS smoothed FROM (SELECT item, learner, avg(1 - correct) AS e FROM ix GROUP BY item, learner) GROUP BY item", "ix"))
def a5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error as a mean of learners' means."""
    e = rates.learner_weighted(V.ix(spark, sf_dir), "item")
    return e.select("item", "learners", r6("error").alias("error"), r6("smoothed").alias("smoothed"))


@query("a6_first_observed_error", V.sql("SELECT item, n, n_incorrect, round(smoothed, 6) AS smoothed FROM errors", "ixs", first_seen=FIRST, errors=FIRST_ERROR))
def a6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothed error over first responses of test learners."""
    return held_out(spark, sf_dir).withColumn("smoothed", r6("smoothed"))


@query("a7_split_counts", V.sql("SELECT split, count(*) AS interactions, count(DISTINCT learner) AS learners, count(DISTINCT item) AS items FROM ixs GROUP BY split", "ixs"))
def a7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, learners and items of each split."""
    return V.ixs(spark, sf_dir).groupBy("split").agg(count_rows().alias("interactions"), F.countDistinct("learner").alias("learners"), F.countDistinct("item").alias("items"))


FUNNEL = (("raw", "true"), ("has_time", "response_time IS NOT NULL"), ("timed", "response_time < 60"), ("no_hint", "response_time < 60 AND NOT hint_used"))


@query("a8_exclusion_flow", V.sql(" UNION ALL ".join(f"SELECT '{s}' AS stage, count(*) AS n_rows, count(DISTINCT learner) AS learners FROM ix WHERE {c}" for s, c in FUNNEL), "ix"))
def a8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The funnel from raw to retained rows, in one pass over exploded stages."""
    stages = F.array_compact(F.array(*[F.when(F.expr(c), F.lit(s)) for s, c in FUNNEL]))
    rows = V.ix(spark, sf_dir).select("learner", F.explode(stages).alias("stage"))
    return rows.groupBy("stage").agg(count_rows().alias("n_rows"), F.countDistinct("learner").alias("learners"))


@query("a9_sequence_length_summary", V.sql("SELECT min(n) AS least, quantile_cont(n, 0.5) AS median, round(avg(n), 6) AS mean, max(n) AS most, count(*) AS learners FROM (SELECT learner, count(*) AS n FROM ix_big GROUP BY learner)", "ix_big"))
def a9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of learners' sequences."""
    n = V.ix_big(spark, sf_dir).groupBy("learner").agg(count_rows().alias("n"))
    return n.agg(F.min("n").alias("least"), F.percentile("n", F.lit(0.5)).alias("median"), r6(F.avg("n")).alias("mean"), F.max("n").alias("most"), count_rows().alias("learners"))


@query("a10_quantile_summary", V.sql("SELECT min(n) AS least, quantile_cont(n, 0.5) AS p50, round(quantile_cont(n, 0.9), 6) AS p90, round(quantile_cont(n, 0.95), 6) AS p95, max(n) AS most, round(avg(n), 6) AS mean FROM (SELECT item, count(*) AS n FROM ix_big GROUP BY item)", "ix_big"))
def a10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of responses per item."""
    n = V.ix_big(spark, sf_dir).groupBy("item").agg(count_rows().alias("n"))
    q = lambda p: F.percentile("n", F.lit(p))
    return n.agg(F.min("n").alias("least"), q(0.5).alias("p50"), r6(q(0.9)).alias("p90"), r6(q(0.95)).alias("p95"), F.max("n").alias("most"), r6(F.avg("n")).alias("mean"))


@query("a11_coverage_stats", V.sql("SELECT (SELECT count(*) FROM ix_big) AS n_rows, (SELECT count(*) FROM l WHERE n >= 5) AS learners_5, (SELECT count(*) FROM l WHERE n >= 10) AS learners_10, (SELECT count(*) FROM l WHERE n >= 20) AS learners_20, (SELECT count(*) FROM l WHERE n >= 50) AS learners_50, (SELECT count(*) FROM i WHERE n >= 20) AS items_20, (SELECT round(max(c) / sum(c), 6) FROM (SELECT domain, count(*) AS c FROM ix_big JOIN items USING (item) GROUP BY domain)) AS top_domain", "ix_big", "items", l="SELECT learner, count(*) AS n FROM ix_big GROUP BY learner", i="SELECT item, count(*) AS n FROM ix_big GROUP BY item"))
def a11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of learners, items and domains, with exact distinct counts."""
    big = V.ix_big(spark, sf_dir)
    learners = big.groupBy("learner").agg(count_rows().alias("n")).agg(F.sum("n").alias("n_rows"), *[F.count_if(F.col("n") >= k).alias(f"learners_{k}") for k in (5, 10, 20, 50)])
    items = big.groupBy("item").agg(count_rows().alias("n")).agg(F.count_if(F.col("n") >= 20).alias("items_20"))
    domains = big.join(V.items(spark, sf_dir), "item").groupBy("domain").agg(count_rows().alias("c")).agg(r6(F.max("c") / F.sum("c")).alias("top_domain"))
    return learners.crossJoin(items).crossJoin(domains)


REASON = "CASE WHEN length(trim(coalesce(text, ''))) < 8 THEN 'missing' WHEN length(text) > 1200 THEN 'too_long' WHEN source IN ('src0') THEN 'source' ELSE 'included' END"


@query("a12_reason_counts", f"SELECT {REASON} AS reason, count(*) AS n FROM documents GROUP BY 1")
def a12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the first reason that excludes them."""
    return V.table(spark, sf_dir, "documents").groupBy(F.expr(REASON).alias("reason")).agg(count_rows().alias("n"))


@query("a13_score_distribution", V.sql("SELECT model, count(*) AS n, round(avg(score), 6) AS mean, round(stddev_samp(score), 6) AS sd, round(quantile_cont(score, 0.5), 6) AS median, round(quantile_cont(score, 0.75) - quantile_cont(score, 0.25), 6) AS iqr, min(score) AS least, max(score) AS most, count(DISTINCT score) AS values_seen, round(avg((score <= 0.05)::INT), 6) AS low_share, round(avg((score >= 0.95)::INT), 6) AS high_share, round(avg((score = 0)::INT), 6) AS zero_share, round(avg((score = 1)::INT), 6) AS one_share, (SELECT round(max(c) / sum(c), 6) FROM (SELECT count(*) AS c FROM scores t WHERE t.model = s.model GROUP BY score)) AS mode_share FROM scores s GROUP BY model", "scores"))
def a13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distribution of each score."""
    s = V.scores(spark, sf_dir)
    share = lambda c: r6(F.avg(c.cast("int")))
    q = lambda p: F.percentile("score", F.lit(p))
    mode = s.groupBy("model", "score").agg(count_rows().alias("c")).groupBy("model").agg(r6(F.max("c") / F.sum("c")).alias("mode_share"))
    x = F.col("score")
    found = s.groupBy("model").agg(count_rows().alias("n"), r6(F.avg(x)).alias("mean"), r6(F.stddev_samp(x)).alias("sd"), r6(q(0.5)).alias("median"), r6(q(0.75) - q(0.25)).alias("iqr"), F.min(x).alias("least"), F.max(x).alias("most"), F.countDistinct(x).alias("values_seen"), share(x <= 0.05).alias("low_share"), share(x >= 0.95).alias("high_share"), share(x == 0).alias("zero_share"), share(x == 1).alias("one_share"))
    return found.join(mode, "model")


REPLICATE_PAIRS = [(i, j) for i in V.SEEDS for j in V.SEEDS if i < j]
STABLE = {
    "each": "SELECT condition, item, seed, round(avg(p), 9) AS p FROM pred GROUP BY 1, 2, 3",
    "ranked": f"SELECT *, {RANK.format(c='condition, seed', x='p')} AS r, avg(p) OVER (PARTITION BY condition, item) AS m, median(p) OVER (PARTITION BY condition, item) AS md FROM each",
    "wide": "SELECT condition, item, max(p) - min(p) AS gap, " + ", ".join(f"max(p) FILTER (WHERE seed = {s}) AS p{s}, max(r) FILTER (WHERE seed = {s}) AS r{s}" for s in V.SEEDS) + " FROM ranked GROUP BY 1, 2",
    "moved": "SELECT condition, avg(abs(p - m)) AS mean_abs_dev, median(round(abs(p - md), 6)) AS median_abs_dev FROM ranked GROUP BY condition",
}
STABLE_SQL = "SELECT condition, count(*) AS items, round(max(gap), 6) AS max_range, round(avg(gap), 6) AS mean_range, round(avg((round(gap, 6) > 0.1)::INT), 6) AS share_over_10, round(avg((round(gap, 6) > 0.2)::INT), 6) AS share_over_20, round(any_value(mean_abs_dev), 6) AS mean_abs_dev, round(any_value(median_abs_dev), 6) AS median_abs_dev, "
STABLE_SQL += f"round(({' + '.join(f'corr(r{i}, r{j})' for i, j in REPLICATE_PAIRS)}) / {len(REPLICATE_PAIRS)}, 6) AS mean_spearman, round(({len(V.SEEDS)} + 2 * ({' + '.join(f'corr(p{i}, p{j})' for i, j in REPLICATE_PAIRS)})) / {len(V.SEEDS) ** 2}, 6) AS matrix_mean FROM wide JOIN moved USING (condition) GROUP BY condition"


@query("a15_replicate_stability", V.sql(STABLE_SQL, "pred", **STABLE))
def a15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much an item's prediction moves over seeds, and how well seeds agree on items."""
    each = V.pred(spark, sf_dir).groupBy("condition", "item", "seed").agg(F.round(F.avg("p"), 9).alias("p"))
    found = stability.replicate_stability(each, "p", "seed", V.SEEDS, "item", "condition")
    return found.select(*[r6(c).alias(c) if t == "double" else F.col(c) for c, t in found.dtypes])


@query("a16_cost_table", "SELECT role, count(*) AS requests, sum(greatest(1, length(text) // 4)) AS tokens, round(sum(greatest(1, length(text) // 4)) * 0.00015 / 1000, 6) AS cost FROM conversations GROUP BY role")
def a16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and cost of replies, priced per thousand tokens."""
    tokens = F.greatest(F.lit(1), F.floor(F.length("text") / 4))
    c = V.table(spark, sf_dir, "conversations").groupBy("role").agg(count_rows().alias("requests"), F.sum(tokens).alias("tokens"))
    return c.withColumn("cost", r6(F.col("tokens") * 0.00015 / 1000))


@query("a17_repeat_pair_rates", V.sql("SELECT count(*) AS pairs, round(avg((n > 1)::INT), 6) AS over_1, round(avg((n > 5)::INT), 6) AS over_5, round(avg((n > 10)::INT), 6) AS over_10 FROM (SELECT learner, item, count(*) AS n FROM ix GROUP BY 1, 2)", "ix"))
def a17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of repeated learner-item pairs."""
    n = V.ix(spark, sf_dir).groupBy("learner", "item").agg(count_rows().alias("n"))
    return n.agg(count_rows().alias("pairs"), *[r6(F.avg((F.col("n") > k).cast("int"))).alias(f"over_{k}") for k in (1, 5, 10)])


@query("a18_retention_table", V.sql("SELECT split, count(*) AS n_rows, count(*) FILTER (WHERE NOT hint_used) AS unhinted, count(*) FILTER (WHERE place = 1) AS first_rows, round(count(*) FILTER (WHERE place = 1) / count(*), 6) AS first_rate FROM (SELECT *, row_number() OVER (PARTITION BY learner, item ORDER BY ts, event_id) AS place FROM ixs) GROUP BY split", "ixs"))
def a18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that remain unhinted, and as first responses."""
    place = F.row_number().over(Window.partitionBy("learner", "item").orderBy("ts", "event_id"))
    first = F.count_if(F.col("place") == 1)
    return V.ixs(spark, sf_dir).withColumn("place", place).groupBy("split").agg(count_rows().alias("n_rows"), F.count_if(~F.col("hint_used")).alias("unhinted"), first.alias("first_rows"), r6(first / count_rows()).alias("first_rate"))


@query("a20_time_to_first_success", V.sql("SELECT learner, item, (epoch_us(min(ts) FILTER (WHERE correct = 1)) - epoch_us(min(ts))) // 1000000 AS seconds FROM ix GROUP BY 1, 2", "ix"))
def a20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole seconds from the first response to the first correct one."""
    first, right = F.unix_micros(F.min("ts").cast("timestamp")), F.unix_micros(F.min(F.when(F.col("correct") == 1, F.col("ts"))).cast("timestamp"))
    return V.ix(spark, sf_dir).groupBy("learner", "item").agg(F.floor((right - first) / 1000000).alias("seconds"))


@query("a21_eventual_success_view", V.sql("SELECT learner, item, bool_or(correct = 1) AS ever, count(*) AS attempts FROM ix GROUP BY 1, 2", "ix"))
def a21(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a pair is ever correct, and its attempts."""
    return V.ix(spark, sf_dir).groupBy("learner", "item").agg(F.bool_or(F.col("correct") == 1).alias("ever"), count_rows().alias("attempts"))


@query("a22_nonmonotonic_learners", V.sql("SELECT learner, bool_or(coalesce(ts < before, false)) AS back FROM (SELECT learner, ts, lag(ts) OVER (PARTITION BY learner ORDER BY event_id) AS before FROM ix) GROUP BY learner", "ix"))
def a22(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learners whose time runs back in id order."""
    before = F.lag("ts").over(Window.partitionBy("learner").orderBy("event_id"))
    return V.ix(spark, sf_dir).withColumn("before", before).groupBy("learner").agg(F.bool_or(F.coalesce(F.col("ts") < F.col("before"), F.lit(False))).alias("back"))


@query("a23_duplicate_text_groups", "SELECT doc_id, CASE WHEN count(*) OVER (PARTITION BY sha256(text)) > 1 THEN substr(sha256(text), 1, 12) END AS label FROM documents")
def a23(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label for documents whose content hash repeats; counts come from a partial aggregation, not a window."""
    d = V.table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    many = d.groupBy("h").agg(count_rows().alias("n")).where("n > 1")
    return d.join(many, "h", "left").select("doc_id", F.when(F.col("n") > 1, F.substring("h", 1, 12)).alias("label"))


@query("a24_review_rate_rollup", "SELECT lang, source, count(*) AS n, round(avg((length(text) > 1200)::INT), 6) AS long_rate FROM documents GROUP BY GROUPING SETS ((lang), (lang, source))")
def a24(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label rates per language, and per language and source."""
    d = V.table(spark, sf_dir, "documents").select("lang", "source", (F.length("text") > 1200).cast("int").alias("long"))
    return d.groupingSets([["lang"], ["lang", "source"]], "lang", "source").agg(count_rows().alias("n"), r6(F.avg("long")).alias("long_rate"))


TWO = "SELECT learner, item, event_id, correct = 1 AS a, CASE WHEN event_id % 7 = 0 THEN NULL ELSE response_time < 60 END AS b FROM ix"


def two_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interactions with two correctness sources; the second is sometimes unknown."""
    b = F.when(F.pmod("event_id", F.lit(7)) != 0, F.col("response_time") < 60)
    return V.ix(spark, sf_dir).select("learner", "item", "event_id", (F.col("correct") == 1).alias("a"), b.alias("b"))


@query("a25_disagreement_concentration", V.sql("SELECT count(b) AS compared, count(*) FILTER (WHERE a <> b) AS disagreements, round(count(*) FILTER (WHERE a <> b) / count(b), 6) AS rate, count(DISTINCT learner) FILTER (WHERE a <> b) AS learners, count(DISTINCT item) FILTER (WHERE a <> b) AS items FROM two", "ix", two=TWO))
def a25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far two correctness sources disagree, and over how many learners and items."""
    wrong = F.col("a") != F.col("b")
    t = two_sources(spark, sf_dir)
    return t.agg(F.count("b").alias("compared"), F.count_if(wrong).alias("disagreements"), r6(F.count_if(wrong) / F.count("b")).alias("rate"), F.countDistinct(F.when(wrong, F.col("learner"))).alias("learners"), F.countDistinct(F.when(wrong, F.col("item"))).alias("items"))


@query("a27_cooccurrence_edges", V.sql("SELECT sha256('concept|' || a) AS source_id, sha256('concept|' || b) AS target_id, count(*) AS weight FROM (SELECT c AS a, lead(c) OVER (PARTITION BY learner ORDER BY ts, event_id) AS b FROM (SELECT learner, ts, event_id, CASE WHEN item % 10 = 9 THEN '' ELSE 'c' || (item % 10) END AS c FROM ixs WHERE split = 'train') WHERE c <> '') WHERE a <> b GROUP BY a, b HAVING count(*) >= 5", "ixs"))
def a27(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between consecutive concepts of train learners, counted at least five times."""
    rows = V.ixs(spark, sf_dir).where("split = 'train'").select("learner", "ts", "event_id", V.concept().alias("a")).where("a != ''")
    edges = rows.withColumn("b", F.lead("a").over(Window.partitionBy("learner").orderBy("ts", "event_id"))).where("a != b")
    counted = edges.groupBy("a", "b").agg(count_rows().alias("weight")).where("weight >= 5")
    return counted.select(hashed(F.lit("concept"), "a").alias("source_id"), hashed(F.lit("concept"), "b").alias("target_id"), "weight")


@query("a28_hierarchy_edges", "SELECT DISTINCT p[i] AS parent, p[i + 1] AS child FROM (SELECT string_split('all----' || r_name || '----' || n_name, '----') AS p, unnest([1, 2]) AS i FROM nation JOIN region ON n_regionkey = r_regionkey)")
def a28(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the paths all / region / nation."""
    n, r = V.table(spark, sf_dir, "nation"), V.table(spark, sf_dir, "region")
    path = F.split(F.concat_ws("----", F.lit("all"), "r_name", "n_name"), "----")
    rows = n.join(r, n.n_regionkey == r.r_regionkey).select(path.alias("p"))
    return rows.select(F.inline(F.expr("transform(sequence(0, size(p) - 2), i -> named_struct('parent', p[i], 'child', p[i + 1]))"))).distinct()


FEATURES = ("size", "price", "chars")


@query("a29_feature_availability", V.sql(" UNION ALL ".join(f"SELECT '{f}' AS feature, count(*) AS n_rows, count(*) FILTER (WHERE {f} = 0) AS zeros, count(*) FILTER (WHERE {f} IS NULL) AS missing FROM f" for f in FEATURES), "items", f="SELECT size, price, length(text) AS chars FROM items"))
def a29(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, zeros and nulls of each feature, in one pass."""
    f = V.items(spark, sf_dir).withColumn("chars", F.length("text"))
    long = f.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in FEATURES])))
    return long.groupBy("feature").agg(count_rows().alias("n_rows"), F.count_if(F.col("x") == 0).alias("zeros"), F.count_if(F.col("x").isNull()).alias("missing"))


@query("a30_prompt_export_audit", "SELECT lang, count(*) AS eligible, count(text) AS exported, count(*) FILTER (WHERE length(text) < 5) AS short_texts FROM documents GROUP BY lang")
def a30(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eligible, exported and too short texts per language."""
    return V.table(spark, sf_dir, "documents").groupBy("lang").agg(count_rows().alias("eligible"), F.count("text").alias("exported"), F.count_if(F.length("text") < 5).alias("short_texts"))


@query("a31_cost_projection", "SELECT lang, count(*) * 2 * 4 AS calls, sum(greatest(1, length(text) // 4)) * 2 * 4 AS tokens, round(sum(greatest(1, length(text) // 4)) * 2 * 4 * 0.00015 / 1000, 6) AS cost, sum(greatest(1, length(text) // 4)) * 2 * 4 * 0.00015 / 1000 > 0.5 AS blocked FROM documents GROUP BY lang")
def a31(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projected calls, tokens and cost for two models and three replicates, blocked over budget."""
    tokens = F.sum(F.greatest(F.lit(1), F.floor(F.length("text") / 4))) * 2 * 4
    found = V.table(spark, sf_dir, "documents").groupBy("lang").agg((count_rows() * 2 * 4).alias("calls"), tokens.alias("tokens"))
    cost = F.col("tokens") * 0.00015 / 1000
    return found.select("lang", "calls", "tokens", r6(cost).alias("cost"), (cost > 0.5).alias("blocked"))


@query("w1_sequence_index", V.sql("SELECT learner, event_id, row_number() OVER (PARTITION BY learner ORDER BY ts, event_id) - 1 AS sequence_index FROM ix", "ix"))
def w1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """0-based place of every interaction of a learner."""
    return V.ix(spark, sf_dir).select("learner", "event_id", (F.row_number().over(Window.partitionBy("learner").orderBy("ts", "event_id")) - 1).alias("sequence_index"))


@query("w2_first_observed_pair", V.sql("SELECT learner, item, event_id, correct FROM first_seen", "ixs", first_seen=FIRST))
def w2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First responses of test learners."""
    return rates.first_observed(V.ixs(spark, sf_dir).where("split = 'test'"), "ts", "event_id").select("learner", "item", "event_id", "correct")


CAPS = (1, 5, 10, 20)


@query("w3_exposure_mask", V.sql("SELECT item, event_id, r AS exposure_rank FROM (SELECT item, event_id, row_number() OVER (PARTITION BY item ORDER BY sha256(learner || '|' || event_id || '|2024'), event_id) AS r FROM ixs WHERE split = 'train') WHERE r <= 20", "ixs"))
def w3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train rows of each item up to the largest cap, with the rank that any smaller cap keeps."""
    order = Window.partitionBy("item").orderBy("h", "event_id")
    rows = V.ixs(spark, sf_dir).where("split = 'train'").withColumn("h", hashed("learner", "event_id", 2024))
    return rows.withColumn("exposure_rank", F.row_number().over(order)).where(F.col("exposure_rank") <= max(CAPS)).select("item", "event_id", "exposure_rank")


@query("w4_sequence_truncate", V.sql("SELECT learner, event_id FROM (SELECT *, row_number() OVER (PARTITION BY learner ORDER BY ts, event_id) AS r FROM ix) WHERE r <= 80", "ix"))
def w4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eighty rows of each learner."""
    return V.ix(spark, sf_dir).withColumn("r", F.row_number().over(Window.partitionBy("learner").orderBy("ts", "event_id"))).where("r <= 80").select("learner", "event_id")


@query("w5_previous_response", V.sql("SELECT event_id, coalesce(lag(correct) OVER (PARTITION BY learner ORDER BY ts, event_id), 0) AS previous FROM ix", "ix"))
def w5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correctness of the response before, 0 at the start."""
    return V.ix(spark, sf_dir).select("event_id", F.lag("correct", 1, 0).over(Window.partitionBy("learner").orderBy("ts", "event_id")).alias("previous"))


@query("w6_first_target_eval_mask", V.sql("SELECT learner, event_id, target AND row_number() OVER (PARTITION BY learner, item ORDER BY ts, event_id) = 1 AS evaluated FROM (SELECT *, bool_or(target) OVER (PARTITION BY learner) AS any_target FROM (SELECT *, item % 5 = 0 AS target, row_number() OVER (PARTITION BY learner ORDER BY ts, event_id) AS r FROM ixs WHERE split = 'test') WHERE r <= 80) WHERE any_target", "ixs"))
def w6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First occurrence of each held-out item in truncated test sequences; learners without one are dropped."""
    time, by = ("ts", "event_id"), Window.partitionBy("learner")
    rows = V.ixs(spark, sf_dir).where("split = 'test'").withColumn("target", F.pmod("item", F.lit(5)) == 0)
    rows = rows.withColumn("r", F.row_number().over(by.orderBy(*time))).where("r <= 80").withColumn("some", F.bool_or("target").over(by)).where("some")
    first = F.row_number().over(Window.partitionBy("learner", "item").orderBy(*time)) == 1
    return rows.select("learner", "event_id", (F.col("target") & first).alias("evaluated"))


@query("w7_average_rank", V.sql(f"SELECT item, model, {RANK.format(c='model', x='score')} AS average_rank FROM scores", "scores"))
def w7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average ranks of scores, from the histogram of distinct values."""
    return association.average_rank(V.scores(spark, sf_dir), "score", "model", name="average_rank").select("item", "model", "average_rank")


@query("w8_stratified_round_robin_folds", V.sql("SELECT item, n, (row_number() OVER (ORDER BY bin, sha256('2024|' || item), item) - 1) % 5 AS fold FROM (SELECT item, n, len(list_filter(list_distinct(edges), lambda e: e < n)) AS bin FROM (SELECT item, count(*) AS n FROM ix_big GROUP BY item), (SELECT quantile_cont(n, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS edges FROM (SELECT count(*) AS n FROM ix_big GROUP BY item)))", "ix_big"))
def w8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item folds dealt in hash order inside deciles of response counts, one counter over all."""
    n = V.ix_big(spark, sf_dir).groupBy("item").agg(count_rows().alias("n"))
    edges = n.agg(F.percentile("n", F.array(*[F.lit(i / 10) for i in range(10)])).alias("edges"))
    binned = n.crossJoin(F.broadcast(edges)).withColumn("bin", F.size(F.filter(F.array_distinct("edges"), lambda e: e < F.col("n"))))  # one row
    counts = binned.groupBy("bin").agg(count_rows().alias("c"))
    before = counts.select("bin", (F.sum("c").over(Window.orderBy("bin")) - F.col("c")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("bin").orderBy(hashed(2024, "item"), "item")) - 1
    return binned.withColumn("inside", inside).join(F.broadcast(before), "bin").select("item", "n", F.pmod(F.col("before") + F.col("inside"), F.lit(5)).alias("fold"))  # at most eleven rows


@query("w9_learner_split", V.sql("SELECT learner, split FROM split", "split"))
def w9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learners' splits in hash order."""
    return V.split(spark, sf_dir)


QUART = "CAST(greatest(0, ceil((row_number() OVER (PARTITION BY lang ORDER BY {x}, doc_id) - 1) * 4.0 / greatest(count(*) OVER (PARTITION BY lang) - 1, 1)) - 1) AS BIGINT)"


@query("w10_rank_quartile_strata", f"SELECT doc_id, lang || '|' || {QUART.format(x='length(text)')} || '|' || {QUART.format(x='sha256(doc_id::VARCHAR)')} AS stratum FROM documents")
def w10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strata from rank quartiles of text length and of a hash, within a language."""
    d = V.table(spark, sf_dir, "documents").select("doc_id", "lang", F.length("text").alias("chars"), hashed("doc_id").alias("h"))

    def quartile(x: str) -> Column:
        place = F.row_number().over(Window.partitionBy("lang").orderBy(x, "doc_id")) - 1
        return F.greatest(F.lit(0), F.ceil(place * 4.0 / F.greatest(count_rows().over(Window.partitionBy("lang")) - 1, F.lit(1))) - 1).cast("long")

    return d.select("doc_id", F.concat_ws("|", "lang", quartile("chars").cast("string"), quartile("h").cast("string")).alias("stratum"))


@query("w11_quantile_buckets", V.sql("SELECT model, bucket, count(*) AS n, round(avg(error), 6) AS mean, round(quantile_cont(error, 0.5), 6) AS median, round(quantile_cont(error, 0.025), 6) AS low, round(quantile_cont(error, 0.975), 6) AS high FROM (SELECT s.model, error, len(list_filter(list_distinct(edges), lambda e: e < score)) AS bucket FROM scores s JOIN rate USING (item) JOIN (SELECT model, quantile_cont(score, [0.2, 0.4, 0.6, 0.8]) AS edges FROM scores GROUP BY model) q ON q.model = s.model) GROUP BY 1, 2", "ix_big", "scores", rate="SELECT item, avg(1 - correct) AS error FROM ix_big GROUP BY item"))
def w11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error by quintile of the score."""
    s, e = V.scores(spark, sf_dir), rates.error_rates(V.ix_big(spark, sf_dir), "item").select("item", "error")
    edges = s.groupBy("model").agg(F.percentile("score", F.array(*[F.lit(x) for x in (0.2, 0.4, 0.6, 0.8)])).alias("edges"))
    rows = s.join(e, "item").join(F.broadcast(edges), "model").withColumn("bucket", F.size(F.filter(F.array_distinct("edges"), lambda x: x < F.col("score"))))  # one row per model
    q = lambda p: r6(F.percentile("error", F.lit(p)))
    return rows.groupBy("model", "bucket").agg(count_rows().alias("n"), r6(F.avg("error")).alias("mean"), q(0.5).alias("median"), q(0.025).alias("low"), q(0.975).alias("high"))


@query("w13_keep_latest_or_earliest", V.sql("SELECT learner, max_by(event_id, epoch_us(ts) * 1000000::HUGEINT + event_id) AS latest, min_by(event_id, epoch_us(ts) * 1000000::HUGEINT + event_id) AS earliest FROM ix GROUP BY learner", "ix"))
def w13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest and earliest interaction of each learner."""
    order = F.struct("ts", "event_id")
    return V.ix(spark, sf_dir).groupBy("learner").agg(F.max_by("event_id", order).alias("latest"), F.min_by("event_id", order).alias("earliest"))


@query("w14_minmax_normalise", V.sql("SELECT item, CASE WHEN hi > lo THEN round(least(greatest((len - lo) / (hi - lo), 0), 1), 6) ELSE 0.5 END AS scaled FROM (SELECT item, length(text)::DOUBLE AS len FROM items), (SELECT min(length(text)) AS lo, max(length(text)) AS hi FROM items WHERE item % 5 <> 0)", "items"))
def w14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text length scaled by the range of the seen items, clipped, 0.5 when flat."""
    i = V.items(spark, sf_dir).select("item", F.length("text").cast("double").alias("len"))
    seen = F.when(F.pmod("item", F.lit(5)) != 0, F.col("len"))
    edge = i.agg(F.min(seen).alias("lo"), F.max(seen).alias("hi"))
    scaled = F.least(F.greatest((F.col("len") - F.col("lo")) / (F.col("hi") - F.col("lo")), F.lit(0.0)), F.lit(1.0))
    return i.crossJoin(F.broadcast(edge)).select("item", F.when(F.col("hi") > F.col("lo"), r6(scaled)).otherwise(0.5).alias("scaled"))  # one row


@query("w15_permuted_score", V.sql("SELECT a.item, b.score AS permuted FROM (SELECT item, row_number() OVER (ORDER BY sha256(item::VARCHAR), item) AS r FROM s) a JOIN (SELECT score, row_number() OVER (ORDER BY sha256('p|' || item), item) AS r FROM s) b USING (r)", "scores", s="SELECT item, score FROM scores WHERE model = 'model_a'"))
def w15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same scores, dealt to items anew."""
    s = V.scores(spark, sf_dir).where("model = 'model_a'").select("item", "score")
    left = hash_rank(s, hashed("item"), "item").select("item", "rank")
    right = hash_rank(s, hashed(F.lit("p"), "item"), "item").select(F.col("score").alias("permuted"), "rank")
    return left.join(right, "rank").select("item", "permuted")


@query("w16_resampled_score", V.sql("SELECT s.item, t.score AS resampled FROM s JOIN (SELECT score, row_number() OVER (ORDER BY sha256(item::VARCHAR), item) - 1 AS r FROM s) t ON t.r = CAST('0x' || substr(sha256('draw|' || s.item), 1, 8) AS BIGINT) % (SELECT count(*) FROM s)", "scores", s="SELECT item, score FROM scores WHERE model = 'model_a'"))
def w16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score drawn with replacement for every item."""
    s = V.scores(spark, sf_dir).where("model = 'model_a'").select("item", "score")
    ranked = hash_rank(s, hashed("item"), "item").select(F.col("score").alias("resampled"), "rank")
    n = s.agg(count_rows().alias("n"))
    drawn = s.crossJoin(F.broadcast(n)).select("item", F.pmod(hash_number(hashed(F.lit("draw"), "item")), F.col("n")).alias("rank"))  # one row
    return drawn.join(ranked, "rank").select("item", "resampled")


@query("w17_dense_item_index", V.sql("SELECT item, CASE WHEN target THEN 1 ELSE row_number() OVER (PARTITION BY target ORDER BY sha256(item::VARCHAR), item) + 1 END AS idx FROM (SELECT DISTINCT item, item % 5 = 0 AS target FROM ix_big)", "ix_big"))
def w17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item indices from 2 in hash order; 1 stands for unseen items, 0 is left for padding."""
    i = V.ix_big(spark, sf_dir).select("item").distinct().withColumn("target", F.pmod("item", F.lit(5)) == 0)
    seen = hash_rank(i.where("NOT target"), hashed("item"), "item").select("item", (F.col("rank") + 2).alias("idx"))
    return seen.unionByName(i.where("target").select("item", F.lit(1).cast("long").alias("idx")))


@query("w18_znormalise_blend", V.sql("SELECT item, round((z - avg(z) OVER ()) / (stddev_pop(z) OVER () + 1e-8), 6) AS blended FROM (SELECT item, 0.7::DOUBLE * ((a - avg(a) OVER ()) / (stddev_pop(a) OVER () + 1e-8)) + 0.3::DOUBLE * ((b - avg(b) OVER ()) / (stddev_pop(b) OVER () + 1e-8)) AS z FROM (SELECT item, size::DOUBLE AS a, price AS b FROM items))", "items"))
def w18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A weighted blend of two standardised features, standardised again by one-row aggregates."""
    i = V.items(spark, sf_dir).select("item", F.col("size").cast("double").alias("a"), F.col("price").alias("b"))

    def z(rows: DataFrame, *names: str) -> DataFrame:
        moments = rows.agg(*[f(c).alias(f"{k}_{c}") for c in names for k, f in (("m", F.avg), ("s", F.stddev_pop))])
        return rows.crossJoin(F.broadcast(moments)).select("item", *[((F.col(c) - F.col(f"m_{c}")) / (F.col(f"s_{c}") + 1e-8)).alias(c) for c in names])  # one row

    blend = z(i, "a", "b").select("item", (0.7 * F.col("a") + 0.3 * F.col("b")).alias("z"))
    return z(blend, "z").select("item", r6("z").alias("blended"))
