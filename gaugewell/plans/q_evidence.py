"""Seed tests of two families of predictions and the evidence matrix of four families."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugewell.functions.hashing import hash_unit, hashed
from gaugewell.operators import evaluation, evidence, rates, resampling
from gaugewell.plans.q_models import P_DF4, rounded
from gaugewell.plans.q_rates import LEAST, count_rows
from gaugewell.plans.q_tables import PAIR
from gaugewell.plans.registry import Catalog
from gaugewell.sources import views as V
from gaugewell.sources.files import cut

CATALOG = Catalog()
query = CATALOG.query
MODELS = ("model_a", "model_b")
#: Comparators of family C, limited responses, and of family D, unseen items.
LIMITED, UNSEEN = ("base", "random"), ("base", "random", "length")
BACKBONES = ("recurrent", "attention")
#: Family, backbone, exposure, and how far a condition moves the prediction from that of base.
SETTINGS = (
    ("C", "recurrent", "1", 0.1), ("C", "recurrent", "2", 0.2), ("C", "recurrent", "5", 0.4), ("C", "recurrent", "10", 0.6), ("C", "recurrent", "20", 0.8), ("C", "recurrent", "all", 1.0),
    ("D", "recurrent", "all", 1.0), ("D", "attention", "all", 0.5),
)
#: Datasets by the item's domain.
DATASETS = {"plain": ("ECONOMY", "STANDARD"), "sized": ("SMALL", "MEDIUM"), "large": ("LARGE", "PROMO")}
CONDITIONS = (*UNSEEN, *MODELS)


def dataset_of(domain: str):
    """The dataset of an item's domain; null for others."""
    found = F.lit(None).cast("string")
    for name, domains in DATASETS.items():
        found = F.when(F.col(domain).isin(*domains), name).otherwise(found)
    return found


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of both families on test rows: family, backbone, exposure, dataset, condition, seed, fold, y, p."""
    score = lambda m: F.max(F.when(F.col("model") == m, F.col("score"))).alias(m)
    wide = V.scores(spark, sf_dir).groupBy("item").agg(*[score(m) for m in MODELS])
    known = V.items(spark, sf_dir).select("item", dataset_of("domain").alias("dataset")).where("dataset IS NOT NULL").join(wide, "item")
    rows = V.ixs(spark, sf_dir).where("split = 'test'").select("item", "event_id", F.col("correct").alias("y"), "response_time").join(known, "item")
    grid = F.array(*[F.struct(F.lit(c).alias("condition"), F.lit(s).alias("seed")) for c in CONDITIONS for s in V.SEEDS])
    drawn = rows.select("*", F.inline(grid)).withColumn("noise", (hash_unit(hashed("event_id", "condition", "seed")) - 0.5) / 100.0)
    is_ = lambda c: F.col("condition") == c
    mean = F.when(is_("base"), 0.8).when(is_("random"), 0.7 + 0.2 * hash_unit(hashed("item"))).when(is_("length"), 0.7 + 0.2 * (F.col("response_time") / 500.0)).when(is_("model_a"), 0.9 - 0.2 * F.col("model_a")).otherwise(0.9 - 0.2 * F.col("model_b"))
    settings = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("family", "backbone", "exposure", "pull"), s, strict=True)]) for s in SETTINGS])
    placed = drawn.withColumn("mean", mean).select("*", F.inline(settings)).where("family = 'D' OR condition <> 'length'")
    p = F.least(F.greatest(0.8 + F.col("pull") * (F.col("mean") - 0.8) + F.col("noise"), F.lit(0.0)), F.lit(1.0))
    return placed.select("family", "backbone", "exposure", "dataset", "condition", "seed", F.pmod("item", F.lit(5)).cast("int").alias("fold"), "y", p.alias("p"))


DATASET_SQL = "CASE " + " ".join(f"WHEN domain IN {d} THEN '{name}'" for name, d in DATASETS.items()) + " END"
SETTINGS_SQL = "(VALUES " + ", ".join(f"('{f}', '{b}', '{e}', {x}::DOUBLE)" for f, b, e, x in SETTINGS) + ") AS t(family, backbone, exposure, pull)"
TRIALS = (
    "SELECT family, backbone, exposure, dataset, condition, seed, item % 5 AS fold, y, least(greatest(0.8::DOUBLE + pull * (mean - 0.8::DOUBLE) + noise, 0.0), 1.0)::DOUBLE AS p FROM "
    f"(SELECT *, (({V._HEX.format('sha256(event_id || chr(124) || condition || chr(124) || seed)')}) - 0.5::DOUBLE) / 100.0::DOUBLE AS noise, CASE condition WHEN 'base' THEN 0.8::DOUBLE WHEN 'random' THEN 0.7::DOUBLE + 0.2::DOUBLE * ({V._HEX.format('sha256(item::VARCHAR)')}) WHEN 'length' THEN 0.7::DOUBLE + 0.2::DOUBLE * (response_time / 500.0::DOUBLE) WHEN 'model_a' THEN 0.9::DOUBLE - 0.2::DOUBLE * a ELSE 0.9::DOUBLE - 0.2::DOUBLE * b END AS mean "
    "FROM (SELECT item, event_id, correct AS y, response_time, dataset, a, b FROM ixs JOIN named USING (item) JOIN pairs USING (item) WHERE split = 'test' AND dataset IS NOT NULL), "
    f"(SELECT unnest({list(CONDITIONS)}) AS condition), (SELECT unnest({list(V.SEEDS)}) AS seed)), {SETTINGS_SQL} WHERE family = 'D' OR condition <> 'length'"
)
_CLIPPED = f"greatest(least(p, 1 - {evaluation.CLIP}), {evaluation.CLIP})"
_ORDER = "PARTITION BY family, p IS NULL ORDER BY p, dataset, backbone, model, comparator"
TESTS = {
    "named": f"SELECT item, {DATASET_SQL} AS dataset FROM items",
    "pairs": PAIR,
    "trials": TRIALS,
    "pooled": f"SELECT family, backbone, exposure, dataset, condition, seed, count(*) AS n, count(DISTINCT fold) AS folds, avg(-(y * ln({_CLIPPED}) + (1 - y) * ln(1 - {_CLIPPED}))) AS log_loss FROM trials GROUP BY ALL",
    "each_seed": f"SELECT family, dataset, backbone, m.condition AS model, c.condition AS comparator, seed, avg(c.log_loss - m.log_loss) AS d, count(DISTINCT exposure) AS exposures, bool_and(m.n = c.n AND m.folds = c.folds) AS paired FROM pooled m JOIN pooled c USING (family, dataset, backbone, exposure, seed) WHERE m.condition IN {MODELS} AND c.condition IN {UNSEEN} GROUP BY ALL",
    "hypotheses": "SELECT family, dataset, backbone, model, comparator, min(exposures) AS exposures, count(*) AS seeds, avg(d) AS effect, stddev_samp(d) AS sd, bool_and(paired) AS paired, CASE WHEN count(*) = 5 THEN nullif(stddev_samp(d), 0) / sqrt(5.0::DOUBLE) END AS se FROM each_seed GROUP BY ALL",
    "seed_p": f"SELECT *, {P_DF4} AS p FROM (SELECT *, effect / se AS t FROM hypotheses)",
    "seed_tests": f"SELECT *, CASE WHEN p IS NOT NULL THEN max(step) OVER ({_ORDER} ROWS UNBOUNDED PRECEDING) END AS p_holm FROM (SELECT *, least(1.0, (count(*) OVER (PARTITION BY family, p IS NULL) - row_number() OVER ({_ORDER}) + 1) * p) AS step FROM seed_p)",
}
SHOWN = "dataset, model, comparator, seeds, round(effect, 6) AS effect, round(sd, 6) AS sd, round(effect - 2.7764451051977987::DOUBLE * se, 6) AS low, round(effect + 2.7764451051977987::DOUBLE * se, 6) AS high, round(t, 4) AS t, round(p, 6) AS p, round(p_holm, 6) AS p_holm, paired FROM seed_tests"


def seed_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tests of families C and D, from one scan of the predictions."""
    losses = cut(evidence.pooled_losses(trials(spark, sf_dir), "family", "backbone", "exposure", "dataset", "condition", "seed"))
    return evidence.seed_tests(evidence.comparator_deltas(losses, MODELS, UNSEEN))


def shown_tests(spark: SparkSession, sf_dir: str, family: str, *more: str) -> DataFrame:
    """Tests of one family, rounded."""
    found = seed_tests(spark, sf_dir).where(F.col("family") == family)
    return rounded(found.select(*more, "dataset", "model", "comparator", "seeds", "effect", "sd", "low", "high", F.round("t", 4).alias("t"), "p", "p_holm", "paired"))


@query("m21_seed_delta_test", V.sql(f"SELECT exposures, {SHOWN} WHERE family = 'C'", "ixs", "items", "scores", **TESTS))
def m21(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve hypotheses: loss of a comparator less that of a score, mean over six exposures in a seed, t test over five seeds, Holm's p."""
    return shown_tests(spark, sf_dir, "C", "exposures")


@query("m22_pooled_seed_test", V.sql(f"SELECT backbone, {SHOWN} WHERE family = 'D'", "ixs", "items", "scores", **TESTS))
def m22(spark: SparkSession, sf_dir: str) -> DataFrame:
    """36 hypotheses on unseen items: folds pooled in a seed, t test and interval over five seeds, Holm's p over the family."""
    return shown_tests(spark, sf_dir, "D", "backbone")


ITEM_LONG = f"SELECT dataset, model, item, score AS x, round((k + 1.0) / (n + 2.0), 9)::DOUBLE AS y, length(text)::DOUBLE AS z FROM (SELECT item, count(*) AS n, sum(1 - correct) AS k FROM ixs WHERE split = 'test' GROUP BY item HAVING count(*) >= {LEAST}) JOIN named USING (item) JOIN items USING (item) JOIN scores USING (item) WHERE dataset IS NOT NULL"
_A, _PARTS = resampling.correlation_sql("long", "dataset, model", kinds=("rho",))
_ADJUSTED = "1 - (1 - {r2}) * (n - 1) / (n - {k} - 1)"
_GAIN = f"({_ADJUSTED.format(r2='r2_both', k=2)}) - ({_ADJUSTED.format(r2='r2_known', k=1)})"


def _fits(source: str, *cell: str) -> str:
    keys = ", ".join(("dataset", "model", *cell))
    return f"SELECT *, {_GAIN} AS gain FROM (SELECT {keys}, n, yz * yz AS r2_known, least(1.0, (yz * yz + yx * yx - 2 * yz * yx * zx) / (1 - zx * zx)) AS r2_both FROM (SELECT {keys}, count(*) AS n, corr(y, z) AS yz, corr(y, x) AS yx, corr(z, x) AS zx FROM {source} GROUP BY {keys}) WHERE n > 4)"


_B_ORDER = "PARTITION BY p IS NULL ORDER BY p, dataset, model"
INCREMENTS = {
    "fits": _fits("long"),
    "refits": _fits("(SELECT dataset, model, b, x, y, z, unnest(range(0, w)) FROM long JOIN counts USING (item))", "b"),
    "gain_ends": "SELECT dataset, model, quantile_cont(gain, 0.025) AS low, quantile_cont(gain, 0.975) AS high FROM refits GROUP BY ALL",
    "gain_p": "SELECT *, " + resampling.p_sql("sqrt(greatest(r2_both - r2_known, 0) * (n - 3) / (1 - r2_both))", "(n - 3)::BIGINT") + " AS p FROM fits JOIN gain_ends USING (dataset, model)",
    "gains": f"SELECT *, max(step) OVER ({_B_ORDER} ROWS UNBOUNDED PRECEDING) AS p_holm FROM (SELECT *, least(1.0, (count(*) OVER () - row_number() OVER ({_B_ORDER}) + 1) * p) AS step FROM gain_p)",
}
FLAGS = {
    **TESTS, "long": ITEM_LONG, **_PARTS, **INCREMENTS, "family_a": "SELECT * FROM stepped JOIN rho_ends USING (dataset, model)",
    "flags": "SELECT 'A' AS family, dataset, model, '-' AS backbone, '-' AS comparator, rho AS effect, rho_low AS low, rho_high AS high, p_holm, coalesce(p_holm < 0.05, false) AS supported FROM family_a"
    " UNION ALL SELECT 'B', dataset, model, '-', '-', gain, low, high, p_holm, coalesce(p_holm < 0.05 AND low > 0, false) FROM gains"
    " UNION ALL SELECT family, dataset, model, backbone, comparator, effect, effect - 2.7764451051977987::DOUBLE * se, effect + 2.7764451051977987::DOUBLE * se, p_holm, coalesce(p_holm < 0.05 AND effect > 0 AND paired, false) FROM seed_tests",
}
VIEWS = ("ixs", "items", "scores")


def item_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dataset, model, item, score, smoothed error of its test rows and characters, of items with enough rows."""
    errors = V.ixs(spark, sf_dir).where("split = 'test'").groupBy("item").agg(count_rows().alias("n"), F.sum(1 - F.col("correct")).alias("k")).where(F.col("n") >= LEAST)
    known = V.items(spark, sf_dir).select("item", dataset_of("domain").alias("dataset"), F.length("text").cast("double").alias("chars")).where("dataset IS NOT NULL")
    return errors.select("item", F.round(rates.beta_smoothed("k", "n"), 9).alias("error")).join(known, "item").join(V.scores(spark, sf_dir), "item")


@query("m9_increment_table", V.sql("SELECT dataset, model, n, round(r2_known, 6) AS r2_known, round(r2_both, 6) AS r2_both, round(gain, 6) AS gain, round(low, 6) AS low, round(high, 6) AS high, round(p, 6) AS p, round(p_holm, 6) AS p_holm FROM gains", *VIEWS, **FLAGS))
def m9_increments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each score explains of the error beyond the text's length, per dataset: gain of adjusted R2, interval, p, Holm's p."""
    return rounded(evidence.increments(item_rows(spark, sf_dir), "error", "chars", "score", "item", "dataset", "model"))


def evidence_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long table of all four families."""
    rows = cut(item_rows(spark, sf_dir))
    association = resampling.correlation_table(rows, "score", "error", "item", "dataset", "model", kinds=("rho",))
    increment = evidence.increments(rows, "error", "chars", "score", "item", "dataset", "model")
    return evidence.flags(association, increment, seed_tests(spark, sf_dir))


@query("j15_evidence_flags", V.sql("SELECT family, dataset, model, backbone, comparator, round(effect, 6) AS effect, round(low, 6) AS low, round(high, 6) AS high, round(p_holm, 6) AS p_holm, supported FROM flags", *VIEWS, **FLAGS))
def j15_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every flag of the four families in long form."""
    return rounded(evidence_flags(spark, sf_dir))


def _wide() -> str:
    """SQL of the matrix: joins of one family's flags each."""
    pick = lambda where, name, more="": f" LEFT JOIN (SELECT dataset, model, effect AS {name}, p_holm AS {name}_holm, supported AS {name}_s{more} FROM flags WHERE {where}) USING (dataset, model)"
    ends = lambda name: f", low AS {name}_low, high AS {name}_high"
    unseen = [(b, c) for b in BACKBONES for c in UNSEEN]
    joins = pick("family = 'A'", "a", ends("a")) + pick("family = 'B'", "b", ends("b"))
    joins += "".join(pick(f"family = 'C' AND comparator = '{c}'", f"c_{c}") for c in LIMITED)
    joins += "".join(pick(f"family = 'D' AND backbone = '{b}' AND comparator = '{c}'", f"d_{b}_{c}") for b, c in unseen)
    values = [f"{x}{e}" for x in "ab" for e in ("", "_low", "_high", "_holm")] + [f"{n}{e}" for n in [*[f"c_{c}" for c in LIMITED], *[f"d_{b}_{c}" for b, c in unseen]] for e in ("", "_holm")]
    c_ok = "coalesce(" + " AND ".join(f"c_{c}_s" for c in LIMITED) + ", false)"
    d_ok = "coalesce(" + " OR ".join("(" + " AND ".join(f"d_{b}_{c}_s" for c in UNSEEN) + ")" for b in BACKBONES) + ", false)"
    found = f"SELECT *, coalesce(a_s, false) AS a_ok, coalesce(b_s, false) AS b_ok, {c_ok} AS c_ok, {d_ok} AS d_ok FROM (SELECT DISTINCT dataset, model FROM flags){joins}"
    name = f"CASE WHEN a_ok THEN CASE WHEN b_ok AND (c_ok OR d_ok) THEN '{evidence.DISTINCTIVE}' WHEN b_ok THEN '{evidence.MEASUREMENT}' WHEN c_ok OR d_ok THEN '{evidence.PARTIAL}' ELSE '{evidence.NONE}' END WHEN c_ok OR d_ok THEN '{evidence.DEPLOYMENT}' ELSE '{evidence.NONE}' END"
    complete = " AND ".join(f"{v} IS NOT NULL" for v in values)
    return f"SELECT dataset, model, {', '.join(f'round({v}, 6) AS {v}' for v in values)}, a_ok, b_ok, c_ok, d_ok, {complete} AS complete, {name} AS label FROM ({found})"


MATRIX = _wide()


def evidence_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix of the given tables; small tables leave parts empty, which ``complete`` shows."""
    return evidence.matrix(evidence_flags(spark, sf_dir), LIMITED, UNSEEN, BACKBONES, strict=False)


@query("j15_evidence_matrix_join", V.sql(MATRIX, *VIEWS, **FLAGS))
def j15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per dataset and model with the four families in wide form."""
    return rounded(evidence_matrix(spark, sf_dir))


@query("m24_evidence_classification", V.sql(f"SELECT dataset, model, a_ok, b_ok, c_ok, d_ok, complete, label FROM ({MATRIX})", *VIEWS, **FLAGS))
def m24(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which families support each dataset and model, and the label that follows."""
    return evidence_matrix(spark, sf_dir).select("dataset", "model", "a_ok", "b_ok", "c_ok", "d_ok", "complete", "label")


@query("m24_triplet_audit", V.sql("SELECT dataset, model, backbone, comparator, round(effect, 6) AS effect, round(low, 6) AS low, round(high, 6) AS high, round(p_holm, 6) AS p_holm, CASE WHEN effect > 0 THEN 'better' ELSE 'worse' END AS direction, " + ", ".join(f"clears_{c}" for c in UNSEEN) + ", " + " AND ".join(f"clears_{c}" for c in UNSEEN) + " AS full_triplet FROM flags JOIN (SELECT dataset, model, backbone, " + ", ".join(f"coalesce(max(supported::INT) FILTER (WHERE comparator = '{c}'), 0) = 1 AS clears_{c}" for c in UNSEEN) + " FROM flags WHERE family = 'D' GROUP BY ALL) USING (dataset, model, backbone) WHERE family = 'D' AND p_holm < 0.05 AND effect <> 0", *VIEWS, **FLAGS))
def m24_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Significant hypotheses on unseen items, and whether all comparators are beaten where they stand."""
    return rounded(evidence.audit(evidence_flags(spark, sf_dir), UNSEEN))


@query("m24_overall_verdict", V.sql(f"SELECT *, CASE WHEN distinctive = cells AND cells > 0 THEN '{evidence.DISTINCTIVE}' WHEN distinctive > 0 THEN '{evidence.MIXED}' ELSE '{evidence.NONE}' END AS verdict FROM (SELECT count(*) AS cells, " + ", ".join(f"count(*) FILTER (WHERE label = '{v}') AS {k}" for k, v in (("distinctive", evidence.DISTINCTIVE), ("partial", evidence.PARTIAL), ("measurement_only", evidence.MEASUREMENT), ("deployment_only", evidence.DEPLOYMENT), ('"none"', evidence.NONE))) + f" FROM ({MATRIX}))", *VIEWS, **FLAGS))
def m24_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells by label and the verdict over all of them."""
    return evidence.verdict(evidence_matrix(spark, sf_dir))
