"""Scans, projections, joins, sorts and set operations."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugewell.functions.hashing import hash_number, hashed, table_fingerprint
from gaugewell.operators import rates
from gaugewell.plans.q_rates import FIRST, FIRST_ERROR, LEAST, REASON, TWO, count_rows, held_out, r6, two_sources
from gaugewell.plans.registry import Catalog
from gaugewell.sources import files
from gaugewell.sources import views as V

CATALOG = Catalog()
query = CATALOG.query
TIME = ("ts", "event_id")

WIDE = "SELECT learner, string_agg(item, ',' ORDER BY ts, event_id) AS questions, string_agg(correct, ',' ORDER BY ts, event_id) AS responses FROM ix GROUP BY learner"


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parallel comma lists of items and responses, one row per learner."""
    rows = V.ix(spark, sf_dir).groupBy("learner").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "item", "correct"))).alias("s"))
    text = lambda c: F.array_join(F.transform("s", lambda x: x[c].cast("string")), ",").alias
    return rows.select("learner", text("item")("questions"), text("correct")("responses"))


@query("s1_wide_sequence_explode", V.sql("SELECT learner, i - 1 AS pos, CAST(string_split(questions, ',')[i] AS BIGINT) AS item, CAST(string_split(responses, ',')[i] AS INT) AS correct FROM (SELECT *, unnest(range(1, len(string_split(questions, ',')) + 1)) AS i FROM w)", "ix", w=WIDE))
def s1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per position of parallel lists, cut to the shortest."""
    return files.explode_wide(wide(spark, sf_dir), "learner", {"item": "questions", "correct": "responses"}).select("learner", "pos", F.col("item").cast("long").alias("item"), F.col("correct").cast("int").alias("correct"))


@query("s2_json_entries", "SELECT event_id, k AS feature, CAST(json_extract_string(props, '$.' || k) AS BIGINT) AS amount FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
def s2_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of a JSON object as rows."""
    e = V.table(spark, sf_dir, "events")
    return e.select("event_id", F.explode(F.from_json("props", "map<string,bigint>")).alias("feature", "amount"))


MULTIPLE = "p_size % 4 IN (1, 2, 3)"
NESTED_ITEMS = f"""SELECT p_partkey AS item, p_name AS text, CASE WHEN {MULTIPLE} THEN 'multiple_choice' ELSE 'fill_in' END AS item_format,
CASE WHEN {MULTIPLE} THEN '{{"A":"' || p_brand || '","B":"' || p_type || '"}}' END AS answer_options, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_brand END AS answer,
CASE WHEN p_partkey % 10 = 9 THEN '' ELSE replace(p_name, ' ', '|') END AS concept_ids, CASE WHEN p_partkey % 10 = 9 THEN '' ELSE string_split(p_name, ' ')[-1] END AS primary_concept FROM part"""


def question_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given items as JSON objects keyed by item, at most 64 in one: types as numbers, as text or absent, other keys absent at times."""
    p = V.table(spark, sf_dir, "part")
    many = F.pmod("p_size", F.lit(4)) > 0
    rest = [
        F.concat(F.lit("  "), "p_name", F.lit("\n")).alias("content"), F.when(many, F.create_map(F.lit("A"), "p_brand", F.lit("B"), "p_type")).alias("options"),
        F.when(F.pmod("p_partkey", F.lit(10)) != 9, F.split("p_name", " ")).alias("kc_routes"), F.when(F.pmod("p_partkey", F.lit(3)) != 0, F.col("p_brand")).alias("answer"),
    ]
    coded = F.when(F.pmod("p_size", F.lit(4)) == 2, "1").when(many, "multiple_choice")
    question = F.when(F.pmod("p_size", F.lit(4)) == 1, F.to_json(F.struct(F.lit(1).alias("type"), *rest))).otherwise(F.to_json(F.struct(coded.alias("type"), *rest)))
    entry = F.concat(F.lit('"'), F.col("p_partkey").cast("string"), F.lit('":'), question)
    return p.groupBy(F.floor(F.col("p_partkey") / 64).alias("part")).agg(F.concat(F.lit("{"), F.array_join(F.collect_list(entry), ","), F.lit("}")).alias("value"))


@query("s2_nested_json_items", NESTED_ITEMS)
def s2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items read from files of nested JSON objects."""
    read = files.round_trip(question_objects(spark, sf_dir).select("value"), "text", f"questions-{uuid.uuid4().hex}")
    return files.nested_items(read, "value")


@query("s3_log_scan_pruned", "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_quantity < 10 AND l_returnflag = 'R'")
def s3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few columns of the log, filtered at the scan."""
    return V.table(spark, sf_dir, "lineitem").where("l_quantity < 10 AND l_returnflag = 'R'").select("l_orderkey", "l_partkey", "l_quantity")


@query("s4_html_document_scan", "SELECT p_partkey AS item, coalesce(html, '') AS html FROM part LEFT JOIN pages ON page_id = p_partkey")
def s4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of every item, empty when absent."""
    i = V.items(spark, sf_dir).select("item")
    p = V.table(spark, sf_dir, "pages").select(F.col("page_id").alias("item"), "html")
    return i.join(p, "item", "left").select("item", F.coalesce("html", F.lit("")).alias("html"))


@query("s5_parquet_scan_projected", "SELECT p_partkey AS item, p_size AS size FROM part WHERE p_size >= 25")
def s5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column subset of scoreable items."""
    return V.items(spark, sf_dir).where("size >= 25").select("item", "size")


@query("s6_json_record_scan", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.absent') AS absent, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT) > 50, false) AS large FROM events")
def s6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON records as fixed rows; missing keys are null."""
    r = V.table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long, absent string").alias("r"))
    return r.select("event_id", "r.k", "r.absent", F.coalesce(F.col("r.k") > 50, F.lit(False)).alias("large"))


@query("s7_prediction_table_load", V.sql("SELECT condition, fold, count(*) AS n, sum(y) AS ones FROM pred GROUP BY 1, 2", "pred"))
def s7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions written once as a table of each fold, and loaded together."""
    whole = files.round_trip(V.pred(spark, sf_dir), "parquet", f"folds-{uuid.uuid4().hex}", "fold")
    return whole.groupBy("condition", "fold").agg(count_rows().alias("n"), F.sum("y").alias("ones"))


@query("s8_parquet_sink", V.sql("SELECT split, count(*) AS n_rows, count(DISTINCT learner) AS learners FROM ixs GROUP BY split", "ixs"))
def s8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interactions written as zstd Parquet by split and read back."""
    rows = files.round_trip(V.ixs(spark, sf_dir), "parquet", f"sink-{uuid.uuid4().hex}", "split", compression="zstd")
    return rows.groupBy("split").agg(count_rows().alias("n_rows"), F.countDistinct("learner").alias("learners"))


@query("s9_csv_json_sink", V.sql("SELECT item, model, round(score, 6) AS score FROM scores", "scores"))
def s9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores written as JSON lines and as CSV, and read back from the second."""
    s = V.scores(spark, sf_dir).withColumn("score", r6("score"))
    lines = files.round_trip(s, "json", f"lines-{uuid.uuid4().hex}")
    return files.round_trip(lines, "csv", f"csv-{uuid.uuid4().hex}", header="true")


@query("s10_registry_upsert", "SELECT o_custkey AS run, max_by(o_totalprice, o_orderkey) AS amount, max(o_orderkey) AS batch FROM orders GROUP BY o_custkey")
def s10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest row of each run, over an older and a newer registry."""
    o = V.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run"), F.col("o_totalprice").alias("amount"), F.col("o_orderkey").alias("batch"))
    return files.upsert(o.where("batch % 2 = 0"), o.where("batch % 2 = 1"), "run", "batch").select("run", "amount", "batch")


@query("s11_table_fingerprint", "SELECT count(*) AS n_rows, CAST(coalesce(sum(CAST(CAST('0x' || substr(sha256(p_partkey || '|' || p_name || '|' || p_size), 1, 12) AS BIGINT) AS HUGEINT)), 0) % 1152921504606846976 AS BIGINT) AS content FROM part")
def s11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row count and order-free content hash of a table."""
    return table_fingerprint(V.table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"))


@query("p1_salted_id_hash", "SELECT user_id, sha256('salt|log|learner|' || user_id) AS hashed FROM (SELECT DISTINCT user_id FROM events)")
def p1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudonyms of learners."""
    return V.table(spark, sf_dir, "events").select("user_id").distinct().select("user_id", hashed(F.lit("salt"), F.lit("log"), F.lit("learner"), "user_id").alias("hashed"))


@query("p2_composite_row_hash", V.sql("SELECT event_id, sha256(learner || '|' || item || '|' || event_id || '|' || correct) AS row_hash FROM ix", "ix"))
def p2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A provenance hash of every interaction."""
    return V.ix(spark, sf_dir).select("event_id", hashed("learner", "item", "event_id", "correct").alias("row_hash"))


@query("p3_allowlist_projection", V.sql("SELECT item, text, domain FROM items", "items"))
def p3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exactly the allowed columns; a missing allowed or present denied one is an error before any action."""
    return files.allowed(V.items(spark, sf_dir).drop("price"), ("item", "text", "domain"), denied=("price", "answer"))


@query("p4_valid_response_filter", V.sql("SELECT CASE WHEN response_time >= 90 THEN 'masked' WHEN item % 10 = 9 THEN 'no_content' ELSE 'kept' END AS reason, count(*) AS n FROM ix GROUP BY 1", "ix"))
def p4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by the first reason that drops them."""
    reason = F.when(F.col("response_time") >= 90, "masked").when(F.pmod("item", F.lit(10)) == 9, "no_content").otherwise("kept")
    return V.ix(spark, sf_dir).groupBy(reason.alias("reason")).agg(count_rows().alias("n"))


@query("p5_min_interactions_filter", V.sql("SELECT learner, item, correct FROM ix_big WHERE learner IN (SELECT learner FROM ix_big GROUP BY learner HAVING count(*) >= 10)", "ix_big"))
def p5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of learners with at least ten."""
    big = V.ix_big(spark, sf_dir)
    return big.join(big.groupBy("learner").agg(count_rows().alias("n")).where("n >= 10").select("learner"), "learner", "left_semi").select("learner", "item", "correct")


@query("p6_domain_exclusion_filter", V.sql("SELECT ix_big.item, domain FROM ix_big LEFT JOIN items USING (item) WHERE coalesce(domain, '') NOT LIKE '%STEEL%'", "ix_big", "items"))
def p6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose item's domain is not excluded; unknown domains stay."""
    i = V.items(spark, sf_dir).select("item", "domain")
    return V.ix_big(spark, sf_dir).join(i, "item", "left").where(~F.coalesce("domain", F.lit("")).like("%STEEL%")).select("item", "domain")


@query("p7_first_attempt_filter", V.sql("SELECT event_id FROM (SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN NOT hint_used END AS first_attempt FROM ix) WHERE coalesce(first_attempt, true)", "ix"))
def p7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First attempts; null counts as true."""
    flag = F.when(F.pmod("event_id", F.lit(5)) != 0, ~F.col("hint_used"))
    return V.ix(spark, sf_dir).where(F.coalesce(flag, F.lit(True))).select("event_id")


@query("p8_threshold_filter", V.sql("SELECT threshold, count(*) FILTER (WHERE n >= threshold) AS eligible, count(*) FILTER (WHERE n < threshold) AS excluded FROM (SELECT count(*) AS n FROM ix_big GROUP BY item), (SELECT unnest([5, 10, 20, 50, 100]) AS threshold) GROUP BY threshold", "ix_big"))
def p8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eligible and excluded items at each threshold."""
    return rates.threshold_table(rates.error_rates(V.ix_big(spark, sf_dir), "item"))


@query("p9_tristate_correctness", "SELECT conv_id, turn, CASE WHEN lower(role) = 'user' THEN true WHEN lower(role) = 'assistant' THEN false END AS is_user FROM conversations")
def p9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text flag as true, false or null."""
    role = F.lower("role")
    return V.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(role == "user", True).when(role == "assistant", False).alias("is_user"))


@query("p10_consensus_filter", V.sql("SELECT event_id, a FROM two WHERE a IS NOT NULL AND (b IS NULL OR a = b)", "ix", two=TWO))
def p10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose two sources agree, or whose second is unknown."""
    return two_sources(spark, sf_dir).where("a IS NOT NULL AND (b IS NULL OR a = b)").select("event_id", "a")


@query("p11_registry_run_filter", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' AND NOT starts_with(o_orderpriority, '5') AND CAST(o_custkey % 3 AS VARCHAR) <> '0'")
def p11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished runs that are no pilots and have an exposure other than 0."""
    kept = (F.col("o_orderstatus") == "F") & ~F.col("o_orderpriority").startswith("5") & (F.pmod("o_custkey", F.lit(3)).cast("string") != "0")
    return V.table(spark, sf_dir, "orders").where(kept).select("o_orderkey", "o_orderstatus")


@query("p12_payload_field_audit", "SELECT doc_id, array_to_string(list_filter([CASE WHEN text LIKE '%@%' THEN 'mail' END, CASE WHEN lower(text) LIKE '%token%' THEN 'token' END, CASE WHEN source = 'src1' THEN 'denied_source' END], lambda x: x IS NOT NULL), '|') AS errors FROM documents")
def p12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All audit errors of every document."""
    t = F.col("text")
    errors = F.array_compact(F.array(F.when(t.contains("@"), "mail"), F.when(F.lower(t).contains("token"), "token"), F.when(F.col("source") == "src1", "denied_source")))
    return V.table(spark, sf_dir, "documents").select("doc_id", F.array_join(errors, "|").alias("errors"))


@query("p13_leakage_token_scan", "SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)(answer key|correct answer|license|secret)')")
def p13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a token that gives something away."""
    return V.table(spark, sf_dir, "documents").where(F.col("text").rlike("(?i)(answer key|correct answer|license|secret)")).select("doc_id")


@query("p14_zero_variance_drop", " UNION ALL ".join(f"SELECT lang, '{f}' AS feature FROM documents GROUP BY lang HAVING count(DISTINCT {x}) > 1" for f, x in (("chars", "n_chars"), ("source", "source"), ("flat", "1"))))
def p14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features with more than one value, per language."""
    d = V.table(spark, sf_dir, "documents")
    pairs = (("chars", F.col("n_chars").cast("string")), ("source", F.col("source")), ("flat", F.lit("1")))
    long = d.select("lang", F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), x.alias("x")) for f, x in pairs])))
    return long.groupBy("lang", "feature").agg(F.countDistinct("x").alias("n")).where("n > 1").select("lang", "feature")


@query("p15_fixed_bin_label", V.sql("SELECT item, model, CASE WHEN score <= 0.33 THEN 'Easy' WHEN score <= 0.67 THEN 'Medium' ELSE 'Hard' END AS label, CASE WHEN score < 0.33 THEN 'low' WHEN score < 0.67 THEN 'mid' ELSE 'high' END AS band FROM scores", "scores"))
def p15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by fixed cut points."""
    x = F.col("score")
    return V.scores(spark, sf_dir).select("item", "model", F.when(x <= 0.33, "Easy").when(x <= 0.67, "Medium").otherwise("Hard").alias("label"), F.when(x < 0.33, "low").when(x < 0.67, "mid").otherwise("high").alias("band"))


@query("p16_schema_crosswalk", "SELECT user_id AS learner, value AS response_time, ts AS at FROM events")
def p16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source columns under canonical names; the first present name wins."""
    return files.crosswalk(V.table(spark, sf_dir, "events"), {"learner": ("student_id", "USER_ID"), "response_time": ("seconds", "value"), "at": ("TS", "timestamp")})


@query("j1_dimension_lookup", V.sql("SELECT ix_big.learner, ix_big.item, coalesce(format, '') AS format FROM ix_big LEFT JOIN items USING (item)", "ix_big", "items"))
def j1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item columns on every interaction, empty when unknown."""
    i = V.items(spark, sf_dir).select("item", "format")
    return V.ix_big(spark, sf_dir).join(i, "item", "left").select("learner", "item", F.coalesce("format", F.lit("")).alias("format"))


@query("j2_split_attach_checked", V.sql("SELECT split, count(*) AS n_rows, count(DISTINCT learner) AS learners FROM ix JOIN split USING (learner) GROUP BY split", "ix", "split"))
def j2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and learners of each split; a row without a split raises an error."""
    rows = rates.attach_split(V.ix(spark, sf_dir), V.split(spark, sf_dir))
    return rows.groupBy("split").agg(count_rows().alias("n_rows"), F.count_distinct("learner").alias("learners"))


@query("j3_semi_join_universe", V.sql("SELECT learner, item FROM ix_big WHERE item IN (SELECT item FROM items WHERE size >= 25)", "ix_big", "items"))
def j3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interactions on eligible items."""
    return V.ix_big(spark, sf_dir).join(V.items(spark, sf_dir).where("size >= 25").select("item"), "item", "left_semi").select("learner", "item")


@query("j4_anti_join_targets", V.sql("SELECT split, count(*) AS n FROM ixs WHERE item NOT IN (SELECT item FROM ix WHERE item % 5 = 0) GROUP BY split", "ix", "ixs"))
def j4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows left once held-out items are removed."""
    rows = V.ixs(spark, sf_dir)
    targets = rows.where(F.pmod("item", F.lit(5)) == 0).select("item").distinct()
    return rows.join(targets, "item", "left_anti").groupBy("split").agg(count_rows().alias("n"))


def analysis_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out error, scores and features: item, model, score, smoothed, n, size, chars, train_error."""
    train = rates.error_rates(V.ixs(spark, sf_dir).where("split = 'train'"), "item").select("item", F.col("error").alias("train_error"))
    features = V.items(spark, sf_dir).select("item", "size", F.length("text").alias("chars"))
    return held_out(spark, sf_dir).where(F.col("n") >= LEAST).join(V.scores(spark, sf_dir), "item").join(features, "item", "left").join(train, "item", "left")


FRAME = f"SELECT item, model, score, smoothed, n, size, length(text) AS chars, train_error FROM errors JOIN scores USING (item) LEFT JOIN items USING (item) LEFT JOIN (SELECT item, avg(1 - correct) AS train_error FROM ixs WHERE split = 'train' GROUP BY item) USING (item) WHERE n >= {LEAST}"
FRAME_PARTS = {"first_seen": FIRST, "errors": FIRST_ERROR, "frame": FRAME}


@query("j5_analysis_frame", V.sql("SELECT item, model, round(score, 6) AS score, round(smoothed, 6) AS smoothed, n, size, chars, round(train_error, 6) AS train_error FROM frame", "ixs", "scores", "items", **FRAME_PARTS))
def j5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The analysis frame of all models at once."""
    f = analysis_frame(spark, sf_dir)
    return f.select("item", "model", r6("score").alias("score"), r6("smoothed").alias("smoothed"), "n", "size", "chars", r6("train_error").alias("train_error"))


@query("j6_exposure_outer_join", V.sql("SELECT item, count(*) FILTER (WHERE split = 'train') AS train_n, count(*) FILTER (WHERE split = 'test') AS test_n, round(ln(1 + count(*) FILTER (WHERE split = 'train')), 6) AS log_train FROM ixs GROUP BY item", "ixs"))
def j6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train and test counts of every item, in one aggregation."""
    found = V.ixs(spark, sf_dir).groupBy("item").agg(F.count_if(F.col("split") == "train").alias("train_n"), F.count_if(F.col("split") == "test").alias("test_n"))
    return found.withColumn("log_train", r6(F.log1p("train_n")))


@query("j7_model_pair_join", V.sql("SELECT item, round(max(score) FILTER (WHERE model = 'model_a'), 6) AS model_a, round(max(score) FILTER (WHERE model = 'model_b'), 6) AS model_b FROM scores GROUP BY item", "scores"))
def j7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two models' scores side by side."""
    return V.scores(spark, sf_dir).groupBy("item").pivot("model", ["model_a", "model_b"]).agg(r6(F.first("score")))


@query("j8_cross_release_overlap", "SELECT count(*) AS ids, count(a) AS in_a, count(b) AS in_b, count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS in_both, round(count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) / count(a), 6) AS share_a FROM (SELECT DISTINCT l_partkey AS a FROM lineitem) FULL JOIN (SELECT p_partkey AS b FROM part WHERE p_size >= 10) ON a = b")
def j8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of two id spaces."""
    a = V.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a")).distinct()
    b = V.table(spark, sf_dir, "part").where("p_size >= 10").select(F.col("p_partkey").alias("b"))
    both = F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull())
    return a.join(b, F.col("a") == F.col("b"), "full").agg(count_rows().alias("ids"), F.count("a").alias("in_a"), F.count("b").alias("in_b"), both.alias("in_both"), r6(both / F.count("a")).alias("share_a"))


@query("j9_event_metadata_left_join", "SELECT l_returnflag, count(*) AS n, round(avg((o_orderdate IS NOT NULL)::INT), 6) AS dated FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') ON l_orderkey = o_orderkey GROUP BY l_returnflag")
def j9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of rows that find their metadata."""
    meta = V.table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    rows = V.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag").join(meta, "l_orderkey", "left")
    return rows.groupBy("l_returnflag").agg(count_rows().alias("n"), r6(F.avg(F.col("o_orderdate").isNotNull().cast("int"))).alias("dated"))


@query("j10_pair_semi_join", V.sql("SELECT event_id FROM ixs WHERE split = 'train' AND (learner, item) IN (SELECT (learner, item) FROM (SELECT learner, item, row_number() OVER (PARTITION BY item ORDER BY sha256(learner || '|' || event_id || '|2024'), event_id) AS r FROM ixs WHERE split = 'train') WHERE r <= 5)", "ixs"))
def j10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train rows of the learner-item pairs in a mask."""
    rows = V.ixs(spark, sf_dir).where("split = 'train'").withColumn("h", hashed("learner", "event_id", 2024))
    mask = rows.withColumn("r", F.row_number().over(Window.partitionBy("item").orderBy("h", "event_id"))).where("r <= 5").select("learner", "item").distinct()
    return rows.join(mask, ["learner", "item"], "left_semi").select("event_id")


RUNS = "SELECT condition, seed, fold, count(*) AS n, avg(-(y * ln(greatest(least(p, 1 - 1e-6), 1e-6)) + (1 - y) * ln(1 - greatest(least(p, 1 - 1e-6), 1e-6)))) AS log_loss, avg((p - y) * (p - y)) AS brier FROM pred GROUP BY 1, 2, 3"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of every run: condition, seed, fold, n, log_loss, brier."""
    p = F.greatest(F.least("p", F.lit(1 - 1e-6)), F.lit(1e-6))
    loss = -(F.col("y") * F.log(p) + (1 - F.col("y")) * F.log(1 - p))
    return V.pred(spark, sf_dir).groupBy("condition", "seed", "fold").agg(count_rows().alias("n"), F.avg(loss).alias("log_loss"), F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier"))


@query("j11_comparator_pair_join", V.sql("SELECT a.condition, a.seed, a.fold, a.n = b.n AS equal_n, round(a.log_loss - b.log_loss, 6) AS delta FROM runs a JOIN runs b ON a.seed = b.seed AND a.fold = b.fold AND b.condition = 'base' AND a.condition <> 'base'", "pred", runs=RUNS))
def j11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run against its comparator."""
    r = runs(spark, sf_dir)
    base = r.where("condition = 'base'").select("seed", "fold", F.col("n").alias("m"), F.col("log_loss").alias("b"))
    return r.where("condition <> 'base'").join(base, ["seed", "fold"]).select("condition", "seed", "fold", (F.col("n") == F.col("m")).alias("equal_n"), r6(F.col("log_loss") - F.col("b")).alias("delta"))


@query("j12_choice_correctness_lookup", "SELECT event_id, p_size > 25 AS correct FROM events LEFT JOIN part ON p_partkey = user_id")
def j12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correctness of the chosen option, null when unknown."""
    p = V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("user_id"), (F.col("p_size") > 25).alias("correct"))
    return V.table(spark, sf_dir, "events").select("event_id", "user_id").join(p, "user_id", "left").select("event_id", "correct")


@query("j13_score_alignment_audit", V.sql("SELECT item, count(DISTINCT model) AS models, count(DISTINCT model) = 2 AS complete FROM (SELECT * FROM scores WHERE NOT (model = 'model_b' AND item % 17 = 0)) GROUP BY item", "scores"))
def j13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models that scored each item, and whether all did."""
    s = V.scores(spark, sf_dir).where("NOT (model = 'model_b' AND item % 17 = 0)").groupBy("item").agg(F.countDistinct("model").alias("models"))
    return s.withColumn("complete", F.col("models") == 2)


@query("j14_hash_verified_join", "SELECT a.doc_id, count(b.doc_id) AS matches FROM documents a LEFT JOIN (SELECT doc_id, sha256(text) AS h FROM documents WHERE lang = 'en') b ON sha256(a.text) = b.h GROUP BY a.doc_id")
def j14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents joined by content hash; matches are counted before the join, so that copies do not multiply."""
    d = V.table(spark, sf_dir, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("h"))
    n = d.where("lang = 'en'").groupBy("h").agg(count_rows().alias("n"))
    return d.join(n, "h", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("matches"))


@query("t1_stratified_pick", f"SELECT doc_id FROM (SELECT *, row_number() OVER (ORDER BY NOT picked, h, doc_id) AS g FROM (SELECT doc_id, h, row_number() OVER (PARTITION BY lang ORDER BY h, doc_id) <= greatest(1, 50 // (SELECT count(DISTINCT lang) FROM documents)) AS picked FROM (SELECT doc_id, lang, sha256('2024|' || doc_id) AS h FROM documents))) WHERE g <= 50")
def t1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty documents: as many per language, then the next in hash order."""
    d = V.table(spark, sf_dir, "documents").select("doc_id", "lang", hashed(2024, "doc_id").alias("h"))
    strata = d.agg(F.greatest(F.lit(1), F.floor(F.lit(50) / F.countDistinct("lang"))).alias("share"))
    ranked = d.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).where("r <= 50")
    return ranked.crossJoin(F.broadcast(strata)).withColumn("later", F.col("r") > F.col("share")).orderBy("later", "h", "doc_id").limit(50).select("doc_id")  # one row


@query("t2_capped_class_sample", f"SELECT reason, doc_id FROM (SELECT reason, doc_id, row_number() OVER (PARTITION BY reason ORDER BY sha256('2024|' || reason || '|' || doc_id), doc_id) AS r FROM (SELECT doc_id, {REASON} AS reason FROM documents)) WHERE r <= 20")
def t2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty documents of each class in hash order."""
    d = V.table(spark, sf_dir, "documents").select("doc_id", F.expr(REASON).alias("reason")).withColumn("h", hashed(2024, "reason", "doc_id"))
    return d.withColumn("r", F.row_number().over(Window.partitionBy("reason").orderBy("h", "doc_id"))).where("r <= 20").select("reason", "doc_id")


@query("t3_spot_check_sample", V.sql("SELECT model, item FROM (SELECT model, item, row_number() OVER (PARTITION BY model ORDER BY CAST('0x' || substr(sha256(model || '|' || item), 1, 8) AS BIGINT) % 997, item) AS r FROM scores) WHERE r <= 30", "scores"))
def t3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirty items of each model by a hash residue."""
    s = V.scores(spark, sf_dir).select("model", "item", (hash_number(hashed("model", "item")) % 997).alias("k"))
    return s.withColumn("r", F.row_number().over(Window.partitionBy("model").orderBy("k", "item"))).where("r <= 30").select("model", "item")


@query("t4_evenly_spaced_pick", V.sql("SELECT domain, item FROM (SELECT domain, item, row_number() OVER (PARTITION BY domain ORDER BY text, item) - 1 AS r, count(*) OVER (PARTITION BY domain) AS m FROM items) WHERE r IN (0, (m - 1) // 4, 2 * (m - 1) // 4, 3 * (m - 1) // 4, m - 1)", "items"))
def t4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five evenly spaced items of each domain in name order."""
    by = Window.partitionBy("domain")
    i = V.items(spark, sf_dir).withColumn("r", F.row_number().over(by.orderBy("text", "item")) - 1).withColumn("m", count_rows().over(by))
    return i.where(F.array_contains(F.array(*[F.floor((F.col("m") - 1) * k / 4) for k in range(5)]), F.col("r").cast("long"))).select("domain", "item")


@query("t5_review_first_n", "SELECT lang, count(*) AS n, sha256(string_agg(doc_id, ',' ORDER BY doc_id)) AS sample_hash FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents) WHERE r <= 10 GROUP BY lang")
def t5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten documents of each language, as a hash."""
    d = V.table(spark, sf_dir, "documents").withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("doc_id"))).where("r <= 10")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), ",")
    return d.groupBy("lang").agg(count_rows().alias("n"), F.sha2(ids, 256).alias("sample_hash"))


@query("t6_review_budget_topk", V.sql("SELECT model, k, round(sum((rs <= k AND rt <= k)::INT) / k, 6) AS precision, round(sum(CASE WHEN rs <= k AND smoothed > edge THEN 1 / (ln(rs + 1) / ln(2)) ELSE 0 END), 6) AS dcg FROM (SELECT *, least(20, greatest(1, count(*) OVER w // 5)) AS k, quantile_cont(smoothed, 0.8) OVER w AS edge, row_number() OVER (PARTITION BY model ORDER BY score DESC, item) AS rs, row_number() OVER (PARTITION BY model ORDER BY smoothed DESC, item) AS rt FROM frame WINDOW w AS (PARTITION BY model)) GROUP BY model, k", "ixs", "scores", "items", **FRAME_PARTS))
def t6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision and discounted gain of reviewing the hardest predicted items."""
    f = analysis_frame(spark, sf_dir)
    cell = f.groupBy("model").agg(F.least(F.lit(20), F.greatest(F.lit(1), F.floor(count_rows() / 5))).alias("k"), F.percentile("smoothed", F.lit(0.8)).alias("edge"))
    by = Window.partitionBy("model")
    ranked = f.join(cell, "model").withColumn("rs", F.row_number().over(by.orderBy(F.desc("score"), "item"))).withColumn("rt", F.row_number().over(by.orderBy(F.desc("smoothed"), "item")))
    top = F.col("rs") <= F.col("k")
    gain = F.when(top & (F.col("smoothed") > F.col("edge")), 1 / (F.log(F.col("rs") + 1) / F.log(F.lit(2.0)))).otherwise(0.0)
    return ranked.groupBy("model", "k").agg(r6(F.sum((top & (F.col("rt") <= F.col("k"))).cast("int")) / F.first("k")).alias("precision"), r6(F.sum(gain)).alias("dcg"))


PAIR = "SELECT item, max(score) FILTER (WHERE model = 'model_a') AS a, max(score) FILTER (WHERE model = 'model_b') AS b FROM scores GROUP BY item"


@query("t7_decile_overlap", V.sql("SELECT count(*) FILTER (WHERE a >= ah AND b >= bh) AS top_both, round(count(*) FILTER (WHERE a >= ah AND b >= bh) / count(*) FILTER (WHERE a >= ah), 6) AS top_share, round(count(*) FILTER (WHERE a <= al AND b <= bl) / count(*) FILTER (WHERE a <= al), 6) AS bottom_share FROM pairs, (SELECT quantile_cont(a, 0.9) AS ah, quantile_cont(a, 0.1) AS al, quantile_cont(b, 0.9) AS bh, quantile_cont(b, 0.1) AS bl FROM pairs)", "scores", pairs=PAIR))
def t7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of two models' top and bottom deciles."""
    p = V.scores(spark, sf_dir).groupBy("item").pivot("model", ["model_a", "model_b"]).agg(F.first("score")).toDF("item", "a", "b")
    edge = p.agg(*[F.percentile(c, F.lit(q)).alias(n) for c, q, n in (("a", 0.9, "ah"), ("a", 0.1, "al"), ("b", 0.9, "bh"), ("b", 0.1, "bl"))])
    top_a, top, low_a, low = F.expr("a >= ah"), F.expr("a >= ah AND b >= bh"), F.expr("a <= al"), F.expr("a <= al AND b <= bl")
    return p.crossJoin(F.broadcast(edge)).agg(F.count_if(top).alias("top_both"), r6(F.count_if(top) / F.count_if(top_a)).alias("top_share"), r6(F.count_if(low) / F.count_if(low_a)).alias("bottom_share"))  # one row


@query("t9_learner_cap", V.sql("SELECT learner, event_id FROM ix WHERE learner IN (SELECT DISTINCT learner FROM ix ORDER BY learner LIMIT 20)", "ix"))
def t9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interactions of the first twenty learners by id."""
    rows = V.ix(spark, sf_dir)
    return rows.join(rows.select("learner").distinct().orderBy("learner").limit(20), "learner", "left_semi").select("learner", "event_id")


@query("u1_union_edge_sources", "SELECT 'order' AS kind, o_custkey AS a, o_orderkey AS b FROM orders UNION ALL SELECT 'line', l_orderkey, l_partkey FROM lineitem")
def u1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of two sources, united by name."""
    o = V.table(spark, sf_dir, "orders").select(F.lit("order").alias("kind"), F.col("o_custkey").alias("a"), F.col("o_orderkey").alias("b"))
    return o.unionByName(V.table(spark, sf_dir, "lineitem").select(F.lit("line").alias("kind"), F.col("l_orderkey").alias("a"), F.col("l_partkey").alias("b")))


@query("u2_coverage_intersection", V.sql("SELECT count(i.item) AS interacted, count(a.item) AS available, count(*) FILTER (WHERE i.item IS NOT NULL AND a.item IS NOT NULL) AS covered, round(count(*) FILTER (WHERE i.item IS NOT NULL AND a.item IS NOT NULL) / count(i.item), 6) AS item_coverage, round(sum(n) FILTER (WHERE a.item IS NOT NULL) / sum(n), 6) AS response_coverage FROM (SELECT item, count(*) AS n FROM ix_big GROUP BY item) i FULL JOIN (SELECT item FROM items WHERE size >= 10) a USING (item)", "ix_big", "items"))
def u2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of interacted items by available ones, by item and by response."""
    i = V.ix_big(spark, sf_dir).groupBy(F.col("item").alias("i")).agg(count_rows().alias("n"))
    a = V.items(spark, sf_dir).where("size >= 10").select(F.col("item").alias("a"))
    both = F.count_if(F.expr("i IS NOT NULL AND a IS NOT NULL"))
    return i.join(a, F.col("i") == F.col("a"), "full").agg(F.count("i").alias("interacted"), F.count("a").alias("available"), both.alias("covered"), r6(both / F.count("i")).alias("item_coverage"), r6(F.sum(F.when(F.col("a").isNotNull(), F.col("n"))) / F.sum("n")).alias("response_coverage"))


@query("u3_eligibility_flips", V.sql("SELECT count(*) FILTER (WHERE f AND NOT g) AS only_first, count(*) FILTER (WHERE g AND NOT f) AS only_all, count(*) FILTER (WHERE f AND g) AS common, round(count(*) FILTER (WHERE f <> g) / nullif(count(*), 0), 6) AS flip_share FROM (SELECT coalesce(e.n, 0) >= 14 AS f, a.n >= 18 AS g FROM (SELECT item, count(*) AS n FROM ixs WHERE split = 'test' GROUP BY item) a LEFT JOIN errors e USING (item)) WHERE f OR g", "ixs", first_seen=FIRST, errors=FIRST_ERROR))
def u3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items eligible under one response view only."""
    every = V.ixs(spark, sf_dir).where("split = 'test'").groupBy("item").agg(count_rows().alias("m"))
    both = every.join(held_out(spark, sf_dir).select("item", "n"), "item", "left").select((F.coalesce("n", F.lit(0)) >= 14).alias("f"), (F.col("m") >= 18).alias("g")).where("f OR g")
    return both.agg(F.count_if(F.expr("f AND NOT g")).alias("only_first"), F.count_if(F.expr("g AND NOT f")).alias("only_all"), F.count_if(F.expr("f AND g")).alias("common"), r6(F.try_divide(F.count_if(F.expr("f <> g")), count_rows())).alias("flip_share"))


@query("u4_split_disjointness", V.sql("SELECT count(*) AS learners, count(*) FILTER (WHERE k > 1) AS overlapping FROM (SELECT learner, count(DISTINCT split) AS k FROM ixs GROUP BY learner)", "ixs"))
def u4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learners in more than one split."""
    k = V.ixs(spark, sf_dir).groupBy("learner").agg(F.countDistinct("split").alias("k"))
    return k.agg(count_rows().alias("learners"), F.count_if(F.col("k") > 1).alias("overlapping"))


@query("u5_universe_reconciliation", V.sql("SELECT universe, count(DISTINCT item) AS items, count(DISTINCT learner) AS learners, count(*) AS n_rows FROM (SELECT 'all' AS universe, * FROM ix_big UNION ALL SELECT 'scoreable', * FROM ix_big WHERE item % 2 = 0 UNION ALL SELECT 'frequent', * FROM ix_big WHERE item IN (SELECT item FROM ix_big GROUP BY item HAVING count(*) >= 30)) GROUP BY universe", "ix_big"))
def u5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items, learners and rows of nested universes."""
    big = V.ix_big(spark, sf_dir)
    n = big.groupBy("item").agg(count_rows().alias("n"))
    flags = F.array_compact(F.array(F.lit("all"), F.when(F.pmod("item", F.lit(2)) == 0, F.lit("scoreable")), F.when(F.col("n") >= 30, F.lit("frequent"))))
    return big.join(n, "item").select("item", "learner", F.explode(flags).alias("universe")).groupBy("universe").agg(F.countDistinct("item").alias("items"), F.countDistinct("learner").alias("learners"), count_rows().alias("n_rows"))


@query("u6_union_run_registries", V.sql("SELECT CASE condition WHEN 'base' THEN 'Standard' WHEN 'score' THEN 'Score' ELSE condition END AS protocol, kind, count(*) AS n, round(avg(log_loss), 6) AS log_loss FROM (SELECT condition, log_loss, 'odd' AS kind FROM runs WHERE seed % 2 = 1 UNION ALL SELECT condition, log_loss, NULL FROM runs WHERE seed % 2 = 0) GROUP BY 1, 2", "pred", runs=RUNS))
def u6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two run registries under protocol names; a column only one of them has is null in the other."""
    r = runs(spark, sf_dir)
    both = r.where("seed % 2 = 1").withColumn("kind", F.lit("odd")).unionByName(r.where("seed % 2 = 0"), allowMissingColumns=True)
    name = F.when(F.col("condition") == "base", "Standard").when(F.col("condition") == "score", "Score").otherwise(F.col("condition"))
    return both.groupBy(name.alias("protocol"), "kind").agg(count_rows().alias("n"), r6(F.avg("log_loss")).alias("log_loss"))


@query("u7_union_dataset_tables", V.sql("SELECT 'small' AS dataset, learner, item, correct FROM ix UNION ALL SELECT 'large', learner, item, correct FROM ix_big", "ix", "ix_big"))
def u7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two logs stacked with their names."""
    small = V.ix(spark, sf_dir).select(F.lit("small").alias("dataset"), "learner", "item", "correct")
    return small.unionByName(V.ix_big(spark, sf_dir).withColumn("dataset", F.lit("large")))
