"""Knowledge-tracing views as tables, the scalars of items and the grid of next-response models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugewell.functions.hashing import hash_number, hashed
from gaugewell.operators import evaluation, tracing
from gaugewell.operators.logistic_grid import Grid
from gaugewell.operators.resampling import EDGES
from gaugewell.plans.q_models import rounded
from gaugewell.plans.registry import Catalog
from gaugewell.sources import views as V
from gaugewell.sources.files import cut

CATALOG = Catalog()
query = CATALOG.query
FOLDS = 5
LARGEST = max(tracing.caps(tracing.EXPOSURES))
CAPS = "(SELECT unnest([" + ", ".join(map(str, tracing.caps(tracing.EXPOSURES))) + "]) AS cap)"
MASKED = f"SELECT learner, item, event_id, correct, r FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY sha256(learner || '|' || event_id || '|{tracing.SEED}'), event_id) AS r FROM ixs WHERE split = 'train') WHERE r <= {LARGEST}"
OWN_ERRORS = "SELECT item, 'warm' AS exposure, (sum(1 - correct) + 1.0) / (count(*) + 2.0) AS e FROM ixs WHERE split = 'train' GROUP BY item"
CAPPED_ERRORS = f"SELECT item, cap::VARCHAR AS exposure, (sum(1 - correct) + 1.0) / (count(*) + 2.0) AS e FROM masked, {CAPS} WHERE r <= cap GROUP BY item, cap"
RESAMPLED = "SELECT s.item, t.score AS value FROM s JOIN (SELECT score, row_number() OVER (ORDER BY sha256(item::VARCHAR), item) - 1 AS r FROM s) t ON t.r = CAST('0x' || substr(sha256('draw|' || s.item), 1, 8) AS BIGINT) % (SELECT count(*) FROM s)"
PERMUTED = "SELECT a.item, b.score AS value FROM (SELECT item, row_number() OVER (ORDER BY sha256(item::VARCHAR), item) AS r FROM s) a JOIN (SELECT score, row_number() OVER (ORDER BY sha256('p|' || item), item) AS r FROM s) b USING (r)"
LENGTHS = "SELECT item, CASE WHEN max(length(text)) OVER () > min(length(text)) OVER () THEN (length(text) - min(length(text)) OVER ())::DOUBLE / (max(length(text)) OVER () - min(length(text)) OVER ()) ELSE 0.5 END AS value FROM items"
LEVELS = "(SELECT unnest([" + ", ".join(f"'{e}'" for e in tracing.EXPOSURES) + "]) AS exposure)"
SCALARS = (
    "SELECT item, 'any' AS exposure, model AS source, score AS value FROM scores UNION ALL "
    + " UNION ALL ".join(f"SELECT item, 'any', '{name}', value FROM ({text})" for name, text in (("resampled", RESAMPLED), ("permuted", PERMUTED), ("length", LENGTHS)))
    + " UNION ALL SELECT item, 'any', 'oracle_error', (sum(1 - correct) + 1.0) / (count(*) + 2.0) FROM ixs WHERE item IN (SELECT item FROM items) GROUP BY item"
    + f" UNION ALL SELECT item, exposure, 'train_error', coalesce(e, (SELECT avg(e) FROM warm)) FROM items CROSS JOIN {LEVELS} LEFT JOIN (SELECT * FROM warm UNION ALL SELECT * FROM capped) USING (item, exposure)"
)


def scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All scalars of the given items."""
    return tracing.scalar_maps(V.items(spark, sf_dir), V.scores(spark, sf_dir), V.ixs(spark, sf_dir), "model_a")


@query("k1_scalar_map_table", V.sql(f"SELECT item, exposure, source, round(value, 6) AS value FROM ({SCALARS})", "ixs", "items", "scores", masked=MASKED, warm=OWN_ERRORS, capped=CAPPED_ERRORS, s="SELECT item, score FROM scores WHERE model = 'model_a'"))
def k1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores, controls, length and errors of every item in one long table, train errors under each exposure."""
    return rounded(scalars(spark, sf_dir))


PLACED = "SELECT exposure, split, learner, event_id, item, correct, row_number() OVER (PARTITION BY exposure, split, learner ORDER BY ts, event_id) - 1 AS position FROM ({rows})"
LIMITED = (
    f"SELECT cap::VARCHAR AS exposure, ixs.* FROM ixs JOIN (SELECT learner, item, min(r) AS r FROM masked GROUP BY learner, item) USING (learner, item), {CAPS} WHERE split = 'train' AND r <= cap"
    " UNION ALL SELECT 'warm', ixs.* FROM ixs WHERE split = 'train' UNION ALL SELECT 'any', ixs.* FROM ixs WHERE split <> 'train'"
)
LIMITED = LIMITED.replace("ixs.*", "learner, item, event_id, ts, correct, split")


@query("k2_response_limited_view", V.sql(f"SELECT exposure, split, learner, position, event_id, item, item_index, correct FROM ({PLACED.format(rows='SELECT * FROM limited SEMI JOIN items USING (item)')}) JOIN indexed USING (item) WHERE position < {tracing.MAX_LEN}", "ixs", "items", masked=MASKED, limited=LIMITED, indexed="SELECT item, row_number() OVER (ORDER BY sha256(item::VARCHAR), item) AS item_index FROM items"))
def k2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learners' sequences under every exposure."""
    return tracing.response_limited_view(V.ixs(spark, sf_dir), V.items(spark, sf_dir))


def item_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item and fold of the given items."""
    return V.items(spark, sf_dir).select("item", F.pmod("item", F.lit(FOLDS)).cast("int").alias("fold"))


EVERY = "(SELECT unnest([" + ", ".join(map(str, range(FOLDS))) + "])::INT AS fold)"
COLD = {
    "own": f"SELECT item, (item % {FOLDS})::INT AS own FROM items",
    "indexed": f"SELECT item, fold, row_number() OVER (PARTITION BY fold ORDER BY sha256(item::VARCHAR), item) + 1 AS idx FROM own, {EVERY} WHERE own <> fold",
    "fit": f"SELECT fold, split, learner, event_id, item, correct, row_number() OVER (PARTITION BY fold, split, learner ORDER BY ts, event_id) - 1 AS position FROM ixs JOIN own USING (item), {EVERY} WHERE split <> 'test' AND own <> fold",
    "tested": f"SELECT *, row_number() OVER (PARTITION BY learner, item ORDER BY ts, event_id) = 1 AS first FROM (SELECT ixs.*, own, row_number() OVER (PARTITION BY learner ORDER BY ts, event_id) - 1 AS position FROM ixs JOIN own USING (item) WHERE split = 'test') WHERE position < {tracing.MAX_LEN}",
    "cold": f"SELECT fold, split, learner, position, event_id, item, CASE WHEN CAST('0x' || substr(sha256(learner || '|' || position || '|' || idx || '|{tracing.SEED}|dropout'), 1, 12) AS BIGINT) % 10000 / 10000.0 < {tracing.DROPOUT} THEN 1 ELSE idx END AS item_index, correct, true AS eval_first, true AS eval_all FROM fit JOIN indexed USING (item, fold) WHERE position < {tracing.MAX_LEN}"
    f" UNION ALL SELECT fold, split, learner, position, event_id, item, coalesce(idx, 1), correct, first AND own = fold, own = fold FROM tested JOIN (SELECT DISTINCT learner, own AS fold FROM tested) USING (learner) LEFT JOIN indexed USING (item, fold)",
}


@query("k3_cold_start_view", V.sql("SELECT * FROM cold", "ixs", "items", **COLD))
def k3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of every item fold without its items in train and val, with both marks of what test evaluates."""
    return tracing.cold_start_view(V.ixs(spark, sf_dir), item_folds(spark, sf_dir), FOLDS)


@query("k3_cold_start_proof", V.sql("SELECT fold, target_items, seen_items, removed_rows, target_fit_rows, first_rows, all_rows, target_largest_index, largest_index, target_fit_rows = 0 AND coalesce(target_largest_index, 1) = 1 AS clean FROM (SELECT own AS fold, count(*) AS target_items, (SELECT count(*) FROM own) - count(*) AS seen_items FROM own GROUP BY own) JOIN (SELECT own AS fold, count(*) AS removed_rows FROM ixs JOIN own USING (item) WHERE split <> 'test' GROUP BY own) USING (fold) JOIN (SELECT fold, count(*) FILTER (WHERE own = fold AND split <> 'test') AS target_fit_rows, count(*) FILTER (WHERE split = 'test' AND eval_first) AS first_rows, count(*) FILTER (WHERE split = 'test' AND eval_all) AS all_rows, max(CASE WHEN own = fold THEN item_index END) AS target_largest_index, max(item_index) AS largest_index FROM cold JOIN own USING (item) GROUP BY fold) USING (fold)", "ixs", "items", **COLD))
def k3_proof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each fold removed and evaluates, counted in the written view."""
    folds = item_folds(spark, sf_dir)
    return tracing.cold_start_proof(V.ixs(spark, sf_dir), folds, cut(k3(spark, sf_dir)), FOLDS)


#: Conditions of the grid: without a scalar, with a score, with a score of another item, with the length, with the error of all rows.
CONDITIONS = ("base", "model_a", "model_b", "resampled", "length", "oracle_error")
SEEDS = 5


def drawn_weights(key: str, seeds: int) -> Column:
    """How often ``key`` counts for each seed: Poisson(1) numbers by its hash."""
    edges = F.array(*[F.lit(e) for e in EDGES])
    number = lambda k: hash_number(hashed(F.lit("seed"), k, key))
    return F.array(*[F.size(F.filter(edges, lambda e, k=k: e <= number(k))) for k in range(1, seeds + 1)])


def next_response_rows(view: DataFrame, maps: DataFrame) -> DataFrame:
    """Rows of a response-limited view for :class:`Grid`: exposure, split, y, x, s, w.

    x: the response before, the mean of those before, the log of the place, and one less the item's train error under the
    exposure. Held-out rows stand under each exposure. A scalar that an item lacks is the mean of that scalar over items.
    """
    exposures = [str(e) for e in tracing.EXPOSURES]
    by = Window.partitionBy("exposure", "split", "learner").orderBy("position")
    before = F.avg("correct").over(by.rowsBetween(Window.unboundedPreceding, -1))
    lagged = view.withColumn("_lag", F.lag("correct", 1, 0).over(by).cast("double")).withColumn("_mean", F.coalesce(before, F.lit(0.5)))
    under = F.when(F.col("exposure") == "any", F.array(*[F.lit(e) for e in exposures])).otherwise(F.array("exposure"))
    lagged = lagged.withColumn("exposure", F.explode(under))
    wide = maps.where(F.col("source").isin(*CONDITIONS)).groupBy("item").pivot("source", list(CONDITIONS[1:])).agg(F.first("value"))
    means = wide.agg(*[F.avg(c).alias(f"_{c}") for c in CONDITIONS[1:]])
    filled = wide.crossJoin(F.broadcast(means)).select("item", F.array(*[F.coalesce(c, f"_{c}", F.lit(0.5)) for c in CONDITIONS[1:]]).alias("s"))  # one row
    errors = maps.where("source = 'train_error'").select("item", "exposure", F.col("value").alias("_error"))
    rows = lagged.join(errors, ["item", "exposure"]).join(filled, "item")
    x = F.array("_lag", "_mean", F.log1p("position"), 1 - F.coalesce("_error", F.lit(0.5)))
    return rows.select("exposure", "split", F.col("correct").alias("y"), x.alias("x"), "s", drawn_weights("learner", SEEDS).alias("w"))


@query("k12_condition_model_grid")
def k12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Next-response models of every exposure, condition and seed (a resample of train learners), scored on val and test rows."""
    rows = cut(next_response_rows(k2(spark, sf_dir), scalars(spark, sf_dir)))
    grid = Grid(tuple(str(e) for e in tracing.EXPOSURES), CONDITIONS, SEEDS, 4).fit(rows.where("split = 'train'"))
    counts = cut(grid.histograms(rows.where("split <> 'train'"), "split"))
    return rounded(evaluation.histogram_metrics(counts, "split", "exposure", "condition", "seed"))
