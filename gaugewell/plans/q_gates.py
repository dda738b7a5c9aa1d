"""Quality gates, leakage checks, request plans, and streams run to completion."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugewell.functions.hashing import hashed
from gaugewell.operators import gates, rates, requests
from gaugewell.plans.q_models import COMPARED, ERRORS_OF, compared_sql, rounded, smoothed_errors
from gaugewell.plans.q_rates import FIRST, LEAST, TWO, count_rows, r6, two_sources
from gaugewell.plans.q_tables import RUNS, runs
from gaugewell.plans.q_text import CLASSIFIED, DOCS, classified, docs
from gaugewell.plans.registry import Catalog
from gaugewell.sources import views as V
from gaugewell.sources.files import shared_folder
from gaugewell.streaming import interactions as stream

CATALOG = Catalog()
query = CATALOG.query
CHECKS = {
    "no_raw_ids": "SELECT count(*) FILTER (WHERE length(sha256('salt|' || learner)) <> 64) AS v FROM ixs",
    "disjoint_splits": "SELECT count(*) AS v FROM (SELECT learner FROM ixs GROUP BY learner HAVING count(DISTINCT split) > 1)",
    "split_present": "SELECT count(*) FILTER (WHERE split IS NULL) AS v FROM ixs",
    "items_known": "SELECT count(*) FILTER (WHERE p_partkey IS NULL) AS v FROM ixs LEFT JOIN part ON item = p_partkey",
    "response_binary": "SELECT count(*) FILTER (WHERE correct NOT IN (0, 1)) AS v FROM ixs",
    "event_unique": "SELECT count(*) - count(DISTINCT event_id) AS v FROM ixs",
}


@query("g1_row_checks", V.sql(" UNION ALL ".join(f"SELECT '{n}' AS \"check\", v AS violations, v = 0 AS passed FROM ({s})" for n, s in CHECKS.items()), "ixs"))
def g1_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named checks of the unified table, with the rows that violate them."""
    rows = V.ixs(spark, sf_dir)
    known = V.items(spark, sf_dir).select("item", F.lit(True).alias("known"))
    return gates.violations({
        "no_raw_ids": gates.counted(rows.select(hashed(F.lit("salt"), "learner").alias("h")), F.length("h") != 64),
        "disjoint_splits": gates.counted(rows.groupBy("learner").agg(F.countDistinct("split").alias("k")), F.col("k") > 1),
        "split_present": gates.counted(rows, F.col("split").isNull()),
        "items_known": gates.counted(rows.join(known, "item", "left"), F.col("known").isNull()),
        "response_binary": gates.counted(rows, ~F.col("correct").isin(0, 1)),
        "event_unique": rows.agg((count_rows() - F.countDistinct("event_id")).alias("violations")),
    })


SEQUENCED = "SELECT learner, item, split, row_number() OVER (PARTITION BY learner ORDER BY ts, event_id) - 1 AS position FROM ixs"
EDGES = "SELECT a, b, 'training_response_cooccurrence' AS source, CASE WHEN bool_and(own = 'train') THEN 'train' ELSE 'all' END AS permitted FROM (SELECT item % 10 AS a, lead(item % 10) OVER (PARTITION BY learner ORDER BY ts, event_id) AS b, split AS own FROM ixs WHERE split = 'train') WHERE b IS NOT NULL GROUP BY a, b UNION ALL SELECT DISTINCT item % 10, NULL, 'official_metadata', 'all' FROM items"
NINE = {
    "no_raw_ids": "SELECT 0 AS v", "prompt_safe": "SELECT 0 AS v",
    "split_disjoint": "SELECT count(*) AS v FROM (SELECT learner FROM split GROUP BY learner HAVING count(DISTINCT split) > 1)",
    "interaction_split_match": "SELECT count(*) AS v FROM sequenced s LEFT JOIN split t USING (learner) WHERE s.split IS DISTINCT FROM t.split",
    "eligible_count": "SELECT abs(count(*) - count(DISTINCT item)) AS v FROM items",
    "interaction_item_join": "SELECT count(*) AS v FROM sequenced ANTI JOIN items USING (item)",
    "stable_content_hash": "SELECT count(*) AS v FROM items WHERE text IS NULL",
    "sequence_monotonic": "SELECT count(*) AS v FROM (SELECT 1 FROM sequenced GROUP BY learner HAVING min(position) <> 0 OR max(position) + 1 <> count(*) OR count(DISTINCT position) <> count(*))",
    "edge_provenance": "SELECT count(*) AS v FROM edges WHERE (source = 'official_metadata') <> (permitted = 'all')",
}


@query("g1_schema_check_table", V.sql("SELECT coalesce(\"check\", 'status') AS \"check\", sum(v)::BIGINT AS violations, bool_and(v = 0) AS passed FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS \"check\", v FROM ({s})" for n, s in NINE.items()) + ") GROUP BY ROLLUP (\"check\")", "ixs", "items", sequenced=SEQUENCED, edges=EDGES))
def g1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine checks of the unified tables and one status; the declared number of items is that of different ones."""
    by = Window.partitionBy("learner").orderBy("ts", "event_id")
    rows = V.ixs(spark, sf_dir)
    items = V.items(spark, sf_dir).select("item", "text", F.sha2("text", 256).alias("content_hash"))
    concept = F.pmod("item", F.lit(10))
    pairs = rows.where("split = 'train'").select(concept.alias("a"), F.lead(concept).over(by).alias("b"), "split").where("b IS NOT NULL")
    permitted = F.when(F.bool_and(F.col("split") == "train"), "train").otherwise("all")
    seen = pairs.groupBy("a", "b").agg(permitted.alias("permitted")).select(F.lit("training_response_cooccurrence").alias("source"), "permitted")
    given = items.select(concept.alias("a")).distinct().select(F.lit("official_metadata").alias("source"), F.lit("all").alias("permitted"))
    placed = rows.select("learner", "item", "split", (F.row_number().over(by) - 1).alias("position"))
    return gates.schema_checks(placed, items, V.split(spark, sf_dir), items.select("item", "text"), seen.unionByName(given), F.count_distinct("item"), ("item", "text"))


@query("g2_sequence_integrity", V.sql("SELECT count(*) AS learners, count(*) FILTER (WHERE lo = 0 AND hi + 1 = n) AS whole, count(*) FILTER (WHERE back) AS unsorted FROM (SELECT learner, min(i) AS lo, max(i) AS hi, count(*) AS n, bool_or(coalesce(ts < before, false)) AS back FROM (SELECT *, lag(ts) OVER (PARTITION BY learner ORDER BY i) AS before FROM (SELECT learner, ts, row_number() OVER (PARTITION BY learner ORDER BY ts, event_id) - 1 AS i FROM ix)) GROUP BY learner)", "ix"))
def g2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learners whose sequence starts at 0, has no gaps and is sorted by time."""
    by = Window.partitionBy("learner")
    rows = V.ix(spark, sf_dir).withColumn("i", F.row_number().over(by.orderBy("ts", "event_id")) - 1).withColumn("before", F.lag("ts").over(by.orderBy("i")))
    each = rows.groupBy("learner").agg(F.min("i").alias("lo"), F.max("i").alias("hi"), count_rows().alias("n"), F.bool_or(F.coalesce(F.col("ts") < F.col("before"), F.lit(False))).alias("back"))
    return each.agg(count_rows().alias("learners"), F.count_if(F.expr("lo = 0 AND hi + 1 = n")).alias("whole"), F.count_if("back").alias("unsorted"))


@query("g3_interaction_split_match", V.sql("SELECT count(*) AS n_rows, count(*) FILTER (WHERE ixs.split <> split.split) AS mismatches FROM ixs JOIN split USING (learner)", "ixs"))
def g3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interactions whose split differs from the split table."""
    own = V.split(spark, sf_dir).withColumnRenamed("split", "expected")
    rows = V.ixs(spark, sf_dir).join(own, "learner")
    return rows.agg(count_rows().alias("n_rows"), F.count_if(F.col("split") != F.col("expected")).alias("mismatches"))


@query("g4_edge_provenance", "SELECT kind, bool_and(CASE WHEN kind = 'train' THEN permitted = 'train' ELSE permitted = 'all' END) AS valid, count(*) AS edges FROM (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'train' ELSE 'official' END AS kind, CASE WHEN o_orderkey % 2 = 0 THEN 'train' ELSE 'all' END AS permitted FROM orders) GROUP BY kind")
def g4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether edges permit only the splits their source allows."""
    even = F.pmod("o_orderkey", F.lit(2)) == 0
    e = V.table(spark, sf_dir, "orders").select(F.when(even, "train").otherwise("official").alias("kind"), F.when(even, "train").otherwise("all").alias("permitted"))
    valid = F.when(F.col("kind") == "train", F.col("permitted") == "train").otherwise(F.col("permitted") == "all")
    return e.groupBy("kind").agg(F.bool_and(valid).alias("valid"), count_rows().alias("edges"))


@query("g5_frozen_count_check", f"SELECT reason, n, CASE WHEN n > 100 THEN 'AS_EXPECTED' WHEN n > 10 THEN 'LOW' ELSE 'MISMATCH' END AS status FROM (SELECT {CLASSIFIED} AS reason, count(*) AS n FROM ({DOCS}) GROUP BY 1)")
def g5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per reason against what is expected."""
    found = classified(docs(spark, sf_dir)).groupBy("reason").agg(count_rows().alias("n"))
    return found.withColumn("status", F.when(F.col("n") > 100, "AS_EXPECTED").when(F.col("n") > 10, "LOW").otherwise("MISMATCH"))


@query("g6_dataset_admission_gates", V.sql("SELECT n_rows >= 1000 AS gate_rows, learners >= 50 AS gate_learners, item_coverage >= 0.94 AS gate_coverage, CASE WHEN n_rows < 1000 THEN 'STOP_ROWS' WHEN learners < 50 THEN 'STOP_LEARNERS' WHEN item_coverage < 0.94 THEN 'STOP_COVERAGE' ELSE 'GO' END AS stop_code FROM (SELECT count(*) AS n_rows, count(DISTINCT learner) AS learners, count(DISTINCT item) FILTER (WHERE p_partkey IS NOT NULL) / count(DISTINCT item) AS item_coverage FROM ix_big LEFT JOIN part ON item = p_partkey)", "ix_big"))
def g6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Admission of the large log by counts and coverage."""
    big = V.ix_big(spark, sf_dir)
    # Rows are counted per item and per learner first: no task expands them for several distinct counts, and the items, which grow, are not broadcast.
    known = V.items(spark, sf_dir).groupBy("item").agg(count_rows().alias("known")).hint("merge")
    items = big.groupBy("item").agg(count_rows().alias("n")).join(known, "item", "left")
    items = items.agg(F.coalesce(F.sum(F.col("n") * F.coalesce("known", F.lit(1))), F.lit(0)).alias("n_rows"), (F.count(F.when(F.col("known").isNotNull(), F.col("item"))) / F.count("item")).alias("c"))
    one = items.crossJoin(big.groupBy("learner").agg(count_rows().alias("n")).agg(F.count("learner").alias("learners")))
    stop = F.when(F.col("n_rows") < 1000, "STOP_ROWS").when(F.col("learners") < 50, "STOP_LEARNERS").when(F.col("c") < 0.94, "STOP_COVERAGE").otherwise("GO")
    return one.select((F.col("n_rows") >= 1000).alias("gate_rows"), (F.col("learners") >= 50).alias("gate_learners"), (F.col("c") >= 0.94).alias("gate_coverage"), stop.alias("stop_code"))


@query("g7_content_gate", "SELECT lang, round(avg((length(coalesce(text, '')) >= 8)::INT), 6) AS text_coverage, round(avg((doc_id IN (SELECT doc_id FROM labels))::INT), 6) AS join_coverage, avg((length(coalesce(text, '')) >= 8)::INT) >= 0.95 AND avg((doc_id IN (SELECT doc_id FROM labels))::INT) >= 0.95 AS passed FROM documents GROUP BY lang")
def g7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether texts and joins cover at least 95 % per language."""
    known = V.table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("known", F.lit(1))
    rows = docs(spark, sf_dir).select("doc_id", "lang", (F.length("stem") >= 8).cast("int").alias("t")).join(known, "doc_id", "left")
    each = rows.groupBy("lang").agg(F.avg("t").alias("t"), F.avg(F.coalesce("known", F.lit(0))).alias("j"))
    return each.select("lang", r6("t").alias("text_coverage"), r6("j").alias("join_coverage"), ((F.col("t") >= 0.95) & (F.col("j") >= 0.95)).alias("passed"))


def _grade(x: str, good: float, fair: float) -> str:
    return f"CASE WHEN {x} >= {good} THEN 'PASS' WHEN {x} >= {fair} THEN 'BORDERLINE' ELSE 'FAIL' END"


@query("g8_feasibility_gates", V.sql(f"SELECT rows_gate, repeat_gate, CASE WHEN 'FAIL' IN (rows_gate, repeat_gate) THEN 'FAIL' WHEN 'BORDERLINE' IN (rows_gate, repeat_gate) THEN 'BORDERLINE' ELSE 'PASS' END AS verdict FROM (SELECT {_grade('sum(n)', 5000, 500)} AS rows_gate, {_grade('avg((n > 1)::INT)', 0.5, 0.1)} AS repeat_gate FROM (SELECT count(*) AS n FROM ix GROUP BY learner, item))", "ix"))
def g8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graded gates and the worst of them."""
    one = V.ix(spark, sf_dir).groupBy("learner", "item").agg(count_rows().alias("n")).agg(F.sum("n").alias("n"), F.avg((F.col("n") > 1).cast("int")).alias("r"))
    found = one.select(gates.graded(F.col("n"), 5000, 500).alias("rows_gate"), gates.graded(F.col("r"), 0.5, 0.1).alias("repeat_gate"))
    return found.withColumn("verdict", gates.worst(F.col("rows_gate"), F.col("repeat_gate")))


@query("g9_leakage_sets", V.sql("SELECT count(DISTINCT learner) FILTER (WHERE split = 'test') AS test_learners, count(DISTINCT learner) FILTER (WHERE split = 'test' AND learner IN (SELECT learner FROM ixs WHERE split = 'train')) AS leaked FROM ixs", "ixs"))
def g9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test learners that a reference built on train learners has seen."""
    rows = V.ixs(spark, sf_dir)
    test = rows.where("split = 'test'").select("learner").distinct()
    leaked = test.join(rows.where("split = 'train'").select("learner"), "learner", "left_semi")
    return test.agg(count_rows().alias("test_learners")).crossJoin(leaked.agg(count_rows().alias("leaked")))


@query("g10_request_plan", V.sql("SELECT item, model, sha256('v1|' || model || '|' || item) AS cache_key FROM items, (SELECT unnest(['model_a', 'model_b']) AS model) WHERE (item, model) NOT IN (SELECT (item, model) FROM scores WHERE item % 3 = 0)", "items", "scores"))
def g10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of all items and models that no cached score answers."""
    plan = V.items(spark, sf_dir).select("item", F.explode(F.array(F.lit("model_a"), F.lit("model_b"))).alias("model"))
    cached = V.scores(spark, sf_dir).where("item % 3 = 0").select("item", "model")
    return plan.join(cached, ["item", "model"], "left_anti").withColumn("cache_key", hashed(F.lit("v1"), "model", "item"))


ATTEMPT_ORDER = ("l_shipdate", "l_orderkey", "l_suppkey", "l_extendedprice", "l_returnflag", "l_linestatus", "l_tax", "l_discount")


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scoring attempts out of small order lines: item, model, valid, value, pilot, cached and the columns of their order."""
    lines = V.table(spark, sf_dir, "lineitem").where("l_linenumber <= 2 AND l_quantity <= 12")
    model = F.when(F.col("l_linenumber") == 1, "model_a").otherwise("model_b")
    value = F.when(F.col("l_discount") > 0, F.col("l_tax") * 20)
    return lines.select(F.col("l_partkey").alias("item"), model.alias("model"), (F.col("l_returnflag") != "R").alias("valid"), value.alias("value"), (F.pmod("l_suppkey", F.lit(9)) == 0).alias("pilot"), (F.col("l_linestatus") == "F").alias("cached"), *ATTEMPT_ORDER)


def request_log(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The plan, every item under both models, and the records of its pairs, both with the item's domain."""
    items = V.items(spark, sf_dir).select("item", "domain")
    plan = items.withColumn("model", F.explode(F.array(F.lit("model_a"), F.lit("model_b"))))
    return plan, requests.records(attempts(spark, sf_dir), ("item", "model"), ATTEMPT_ORDER).join(items, "item")


RECORDS = {
    "attempted": f"SELECT *, row_number() OVER w AS place, coalesce(sum(valid::INT) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS record FROM (SELECT l_partkey AS item, CASE l_linenumber WHEN 1 THEN 'model_a' ELSE 'model_b' END AS model, l_returnflag <> 'R' AS valid, CASE WHEN l_discount > 0 THEN l_tax * 20 END AS value, l_suppkey % 9 = 0 AS pilot, l_linestatus = 'F' AS cached, {', '.join(ATTEMPT_ORDER)} FROM lineitem WHERE l_linenumber <= 2 AND l_quantity <= 12) WINDOW w AS (PARTITION BY item, model ORDER BY {', '.join(ATTEMPT_ORDER)})",
    "records": "SELECT item, model, domain, record, count(*) - 1 AS retries, bool_or(valid) AS valid, (list(value ORDER BY place DESC))[1] AS value, (list(cached ORDER BY place DESC))[1] AS cached, (list(pilot ORDER BY place))[1] AS pilot FROM attempted JOIN items USING (item) GROUP BY ALL",
    "planned": "SELECT item, domain, model FROM items, (SELECT unnest(['model_a', 'model_b']) AS model)",
}


@query("a14_parse_gate_table", V.sql(f"SELECT domain, model, expected, {', '.join(f'coalesce({c}, 0) AS {c}' for c in ('completed', 'valid_first_pass', 'valid_after_retry', 'failed', 'missing_value', 'out_of_range', 'cache_hits', 'pilot_imports', 'paid'))}, CASE WHEN coalesce(completed, 0) < expected OR coalesce(valid_after_retry, 0) < expected THEN '{requests.BLOCKED}' ELSE '{requests.PASSED}' END AS status FROM (SELECT domain, model, count(*) AS expected FROM planned GROUP BY ALL) LEFT JOIN (SELECT domain, model, count(*) AS completed, count(*) FILTER (WHERE valid AND retries = 0) AS valid_first_pass, count(*) FILTER (WHERE valid) AS valid_after_retry, count(*) FILTER (WHERE NOT valid) AS failed, count(*) - count(value) AS missing_value, count(*) FILTER (WHERE valid AND NOT value BETWEEN 0 AND 1) AS out_of_range, count(*) FILTER (WHERE cached) AS cache_hits, count(*) FILTER (WHERE pilot) AS pilot_imports, count(*) FILTER (WHERE valid AND NOT cached) AS paid FROM records GROUP BY ALL) USING (domain, model)", "items", **RECORDS))
def a14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected, completed, valid, failed, missing, out of range, cached, imported and paid records per domain and model, and the status."""
    return requests.parse_gate(*request_log(spark, sf_dir), "domain", "model")


@query("g11_request_reconciliation", V.sql("SELECT *, CASE WHEN extra_calls = 0 THEN 'none' WHEN extra_calls > 0 AND retried_records = extra_calls THEN 'format_retry' WHEN duplicates > 0 THEN 'accidental_duplicate' ELSE 'accounting_error' END AS reason, duplicates = 0 AND observed = expected AND extra_calls = retried_records AS passed FROM (SELECT *, paid_calls - new_records AS extra_calls FROM (SELECT domain, model, expected, coalesce(observed, 0) AS observed, coalesce(duplicates, 0) AS duplicates, coalesce(pilot_reuse, 0) AS pilot_reuse, coalesce(retried_records, 0) AS retried_records, coalesce(paid_calls, 0) AS paid_calls, greatest(0, expected - coalesce(observed, 0)) AS missing, coalesce(observed - pilot_reuse, 0) AS new_records FROM (SELECT domain, model, count(*) AS expected FROM planned GROUP BY ALL) LEFT JOIN (SELECT domain, model, count(*) AS observed, count(*) - count(DISTINCT item) AS duplicates, count(*) FILTER (WHERE pilot) AS pilot_reuse, count(*) FILTER (WHERE NOT pilot AND retries > 0) AS retried_records, sum(CASE WHEN pilot THEN 0 ELSE retries + 1 END) AS paid_calls FROM records GROUP BY ALL) USING (domain, model)))", "items", **RECORDS))
def g11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned records against observed ones and paid calls, per domain and model."""
    plan, found = request_log(spark, sf_dir)
    paid = found.where("calls > 0").select("domain", "model", F.explode(F.sequence(F.lit(1), F.col("calls").cast("int"))))
    return requests.reconcile(plan, found, paid, ("item", "model"), "domain", "model")


@query("g11_request_classes", V.sql(f"SELECT model, kind, count(*) AS records, sum(retries) AS retries, sum(CASE WHEN pilot THEN 0 ELSE retries + 1 END) AS calls, count(*) FILTER (WHERE valid) AS eligible FROM (SELECT *, CASE WHEN pilot THEN '{requests.PILOT}' WHEN retries > 0 THEN '{requests.RETRIED}' ELSE '{requests.FIRST_PASS}' END AS kind FROM records) GROUP BY model, kind", "items", **RECORDS))
def g11_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records, retries, paid calls and eligible records of each class."""
    found = request_log(spark, sf_dir)[1]
    return found.groupBy("model", "kind").agg(count_rows().alias("records"), F.sum("retries").alias("retries"), F.sum("calls").cast("long").alias("calls"), F.count_if("valid").alias("eligible"))


@query("g12_pilot_gate_decision", "SELECT role, round(avg((length(coalesce(text, '')) >= 20)::INT), 6) AS parse_rate, CASE WHEN avg((length(coalesce(text, '')) >= 20)::INT) >= 0.98 THEN 'GO' WHEN avg((length(coalesce(text, '')) >= 20)::INT) >= 0.9 THEN 'AMEND' ELSE 'STOP' END AS decision FROM conversations GROUP BY role")
def g12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decision of a pilot per role from its share of usable replies."""
    rate = F.avg((F.length(F.coalesce("text", F.lit(""))) >= 20).cast("int"))
    found = V.table(spark, sf_dir, "conversations").groupBy("role").agg(rate.alias("r"))
    return found.select("role", r6("r").alias("parse_rate"), F.when(F.col("r") >= 0.98, "GO").when(F.col("r") >= 0.9, "AMEND").otherwise("STOP").alias("decision"))


AGREED_ROWS = "SELECT item, CASE WHEN a THEN 1 ELSE 0 END AS correct FROM two"
DISPUTED = {"every_row": AGREED_ROWS, "agreed_row": AGREED_ROWS + " WHERE a = b", **compared_sql(ERRORS_OF.format("every_row"), ERRORS_OF.format("agreed_row")), "disputed": "SELECT count(*) FILTER (WHERE a <> b) / nullif(count(b), 0) AS disagreement, count(DISTINCT item) FILTER (WHERE a <> b) AS disputed_items FROM two"}


@query("g13_correctness_gate", V.sql(f"SELECT round(disagreement, 6) AS disagreement, disputed_items, {COMPARED}, CASE WHEN coalesce(disagreement >= 0.01, false) OR coalesce(rho < 0.99, false) OR coalesce(median_gap > 0.01, false) OR lost > 5 THEN 'PI_REVIEW_REQUIRED' ELSE 'PASS_WITH_SENSITIVITY' END AS gate FROM compared, disputed", "ix", two=TWO, **DISPUTED))
def g13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two correctness sources part too far: disagreement, and item errors over all rows against those on which both agree."""
    two = two_sources(spark, sf_dir)
    wrong = F.col("a") != F.col("b")
    disputed = two.agg((F.count_if(wrong) / F.nullif(F.count("b"), F.lit(0))).alias("disagreement"), F.count_distinct(F.when(wrong, F.col("item"))).alias("disputed_items"))
    rows = two.select("item", F.col("a").cast("int").alias("correct"), (F.col("a") == F.col("b")).alias("agreed"))
    found = rates.compare_errors(smoothed_errors(rows), smoothed_errors(rows.where("agreed")), LEAST).crossJoin(F.broadcast(disputed))  # one row each
    over = lambda test: F.coalesce(test, F.lit(False))
    review = over(F.col("disagreement") >= 0.01) | over(F.col("rho") < 0.99) | over(F.col("median_gap") > 0.01) | (F.col("lost") > 5)
    return rounded(found.withColumn("gate", F.when(review, "PI_REVIEW_REQUIRED").otherwise("PASS_WITH_SENSITIVITY")))


@query("g14_orientation_identities", V.sql("SELECT count(*) AS items, count(*) FILTER (WHERE k + w <> n) AS count_violations, count(*) FILTER (WHERE abs((k + 1.0) / (n + 2.0) + (w + 1.0) / (n + 2.0) - 1) > 1e-12) AS rate_violations FROM (SELECT item, count(*) AS n, sum(correct) AS k, sum(1 - correct) AS w FROM ix_big GROUP BY item)", "ix_big"))
def g14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items where correct and incorrect do not add up."""
    e = rates.error_rates(V.ix_big(spark, sf_dir), "item")
    both = rates.beta_smoothed("n_correct", "n") + rates.beta_smoothed("n_incorrect", "n")
    return e.agg(count_rows().alias("items"), F.count_if(F.col("n_correct") + F.col("n_incorrect") != F.col("n")).alias("count_violations"), F.count_if(F.abs(both - 1) > 1e-12).alias("rate_violations"))


@query("g15_learner_view_comparison", V.sql("SELECT view, count(*) AS items, sum(n) AS n_rows, round(sum(w) / sum(n), 6) AS error, count(*) FILTER (WHERE n >= 10) AS eligible FROM (SELECT 'all' AS view, item, count(*) AS n, sum(1 - correct) AS w FROM ixs WHERE split = 'test' GROUP BY item UNION ALL SELECT 'first', item, count(*), sum(1 - correct) FROM first_seen GROUP BY item UNION ALL SELECT 'eventual', item, count(*), sum(1 - c) FROM (SELECT learner, item, max(correct) AS c FROM ixs WHERE split = 'test' GROUP BY 1, 2) GROUP BY item) GROUP BY view", "ixs", first_seen=FIRST))
def g15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All responses, first ones and eventual success side by side."""
    rows = V.ixs(spark, sf_dir).where("split = 'test'")
    views = {"all": rows, "first": rates.first_observed(rows, "ts", "event_id"), "eventual": rows.groupBy("learner", "item").agg(F.max("correct").alias("correct"))}
    parts = [v.select(F.lit(name).alias("view"), "item", "correct") for name, v in views.items()]
    each = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("view", "item").agg(count_rows().alias("n"), F.sum(1 - F.col("correct")).alias("w"))
    return each.groupBy("view").agg(count_rows().alias("items"), F.sum("n").alias("n_rows"), r6(F.sum("w") / F.sum("n")).alias("error"), F.count_if(F.col("n") >= 10).alias("eligible"))


@query("g16_reproduction_gate", V.sql("SELECT count(*) AS compared, count(*) FILTER (WHERE abs(a.brier - b.brier) > 1e-9) AS violations FROM runs a JOIN (SELECT condition, seed, fold, avg(p * p) - 2 * avg(p * y) + avg(y * y) AS brier FROM pred GROUP BY 1, 2, 3) b USING (condition, seed, fold)", "pred", runs=RUNS))
def g16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs whose metric is not reproduced by another formula."""
    again = V.pred(spark, sf_dir).groupBy("condition", "seed", "fold").agg((F.avg(F.col("p") * F.col("p")) - 2 * F.avg(F.col("p") * F.col("y")) + F.avg(F.col("y") * F.col("y"))).alias("again"))
    both = runs(spark, sf_dir).join(again, ["condition", "seed", "fold"])
    return both.agg(count_rows().alias("compared"), F.count_if(F.abs(F.col("brier") - F.col("again")) > 1e-9).alias("violations"))


@query("g17_rule_validation_summary", f"SELECT reason, count(*) AS sampled, round(avg((length(stem) >= 15)::INT), 6) AS long_enough, round(avg(((reason = 'PASS_TEXT_COMPLETE') = (length(stem) BETWEEN 15 AND 1200))::INT), 6) AS agreement FROM (SELECT *, {CLASSIFIED} AS reason FROM ({DOCS})) GROUP BY reason")
def g17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How rules and a length check agree, by reason."""
    n = F.length("stem")
    agree = (F.col("reason") == "PASS_TEXT_COMPLETE") == n.between(15, 1200)
    return classified(docs(spark, sf_dir)).groupBy("reason").agg(count_rows().alias("sampled"), r6(F.avg((n >= 15).cast("int"))).alias("long_enough"), r6(F.avg(agree.cast("int"))).alias("agreement"))


def _drained(spark: SparkSession, rows: DataFrame, build, mode: str) -> DataFrame:
    """What a stream over ``rows``, written as files first, has put out once all of them are read."""
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    rows.write.parquet(f"{at}/in")
    source = spark.readStream.schema(rows.schema).parquet(f"{at}/in")
    if mode == "append":
        sink = build(source).writeStream.format("parquet").option("path", f"{at}/out")
    else:
        sink = build(source).writeStream.foreachBatch(lambda frame, number: frame.write.mode("overwrite").parquet(f"{at}/out"))
    sink.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/out")


@query("x1_stream_item_counts", V.sql("SELECT item, count(*) AS n, sum(correct) AS n_correct, round((count(*) - sum(correct) + 1) / (count(*) + 2.0), 6) AS smoothed FROM ix GROUP BY item", "ix"))
def x1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item counts of a stream of all interactions, as of its end."""
    rows = V.ix(spark, sf_dir).select("learner", "item", "correct", F.col("ts").cast("timestamp").alias("ts"))
    return _drained(spark, rows, stream.item_counts, "complete").withColumn("smoothed", r6("smoothed"))


@query("x2_first_arrivals", V.sql("SELECT DISTINCT learner, item FROM ix", "ix"))
def x2_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs whose first response a stream has kept."""
    rows = V.ix(spark, sf_dir).select("learner", "item", "correct", F.col("ts").cast("timestamp").alias("ts"))
    return _drained(spark, rows, stream.first_responses, "append").select("learner", "item")


@query("x2_stream_first_observed", V.sql("SELECT learner, item, epoch_us(ts) AS ts_us, event_id, correct FROM (SELECT *, row_number() OVER (PARTITION BY learner, item ORDER BY ts, event_id) AS place FROM ix) WHERE place = 1", "ix"))
def x2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earliest response of each pair, kept by a stream of all interactions as of its end."""
    rows = V.ix(spark, sf_dir).select("learner", "item", "event_id", "correct", F.col("ts").cast("timestamp").alias("ts"))
    return _drained(spark, rows, stream.earliest_responses, "complete").select("learner", "item", F.unix_micros("ts").alias("ts_us"), "event_id", "correct")
