"""Scalar functions over texts, pages and replies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugewell.functions import text as T
from gaugewell.functions.hashing import hash_number, hashed
from gaugewell.plans.registry import Catalog
from gaugewell.sources import views as V

CATALOG = Catalog()
query = CATALOG.query


def _q(pattern: str) -> str:
    return pattern.replace("'", "''")


def _squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'))"


def _strip(x: str) -> str:
    for pattern in (T.SCRIPT, T.STYLE, T.TAG):
        x = f"regexp_replace({x}, '{_q(pattern)}', ' ', 'g')"
    for name, character in T.ENTITIES:
        x = f"replace({x}, '{name}', '{character}')"
    return _squeeze(x)


def _count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{_q(pattern)}'))::BIGINT"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their text as ``stem``, null as empty."""
    return V.table(spark, sf_dir, "documents").withColumn("stem", F.coalesce("text", F.lit("")))


DOCS = "SELECT *, coalesce(text, '') AS stem FROM documents"


@query("f1_html_to_text", f"SELECT page_id, {_strip('html')} AS plain FROM pages")
def f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain text of every page."""
    return V.table(spark, sf_dir, "pages").select("page_id", T.html_to_text(F.col("html")).alias("plain"))


STEM = f"SELECT page_id, {_strip('''regexp_extract(html, '%s', 1)''' % _q(T.QUESTION))} AS question, {_strip('''array_to_string(regexp_extract_all(html, '%s', 1)[1:3], ' ')''' % _q(T.PARAGRAPH))} AS paragraphs, {_strip('''regexp_extract(html, '%s', 1)''' % _q(T.TITLE))} AS title FROM pages"


@query("f2_html_stem_extract", f"SELECT page_id, CASE WHEN question <> '' THEN 'question' WHEN paragraphs <> '' THEN 'paragraphs' WHEN title <> '' THEN 'title' ELSE 'none' END AS stem_source, coalesce(nullif(question, ''), nullif(paragraphs, ''), title) AS stem FROM ({STEM})")
def f2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The question, else the first three paragraphs, else the title; and which it was."""
    html = F.col("html")
    part = lambda pattern: T.html_to_text(F.regexp_extract(html, pattern, 1))
    paragraphs = T.html_to_text(F.array_join(F.slice(F.regexp_extract_all("html", F.lit(T.PARAGRAPH), F.lit(1)), 1, 3), " "))
    p = V.table(spark, sf_dir, "pages").select("page_id", part(T.QUESTION).alias("question"), paragraphs.alias("paragraphs"), part(T.TITLE).alias("title"))
    rules = tuple((c, F.col(c) != "") for c in ("question", "paragraphs", "title"))
    return p.select("page_id", T.first_rule(rules, "none").alias("stem_source"), F.coalesce(F.nullif("question", F.lit("")), F.nullif("paragraphs", F.lit("")), "title").alias("stem"))


FLAGS = (("has_latex", T.LATEX), ("has_dynamic", T.DYNAMIC), ("has_image", T.IMAGE), ("has_choices", T.CHOICES), ("has_figure", T.FIGURE_REFERENCE))


@query("f3_html_flags", "SELECT page_id, " + ", ".join(f"regexp_matches(html, '{_q(p)}') AS {n}" for n, p in FLAGS) + f", length({_strip('html')}) >= 10 OR regexp_matches(html, '{_q(T.LATEX)}') AS intelligible FROM pages")
def f3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each page depends on."""
    html = F.col("html")
    return V.table(spark, sf_dir, "pages").select("page_id", *[html.rlike(p).alias(n) for n, p in FLAGS], ((F.length(T.html_to_text(html)) >= 10) | html.rlike(T.LATEX)).alias("intelligible"))


@query("f4_surface_features", f"SELECT doc_id, length(stem) AS chars, len(list_filter(string_split_regex(stem, '[ \\t\\n\\r\\f\\x0B]+'), lambda x: x <> ''))::BIGINT AS tokens, greatest(1, len(string_split_regex(stem, '{T.SENTENCE_END}')))::BIGINT AS sentences, {_count('stem', T.NUMBER)} AS numbers, {_count('stem', T.MATH_SYMBOL)} AS math_symbols, {_count('stem', T.EQUATION)} AS equations FROM ({DOCS})")
def f4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surface counts; the piece after a final stop counts as a sentence."""
    stem = F.col("stem")
    counts = [T.matches(stem, p).alias(n) for n, p in (("numbers", T.NUMBER), ("math_symbols", T.MATH_SYMBOL), ("equations", T.EQUATION))]
    return docs(spark, sf_dir).select("doc_id", F.length(stem).alias("chars"), T.matches(stem, r"[^ \t\n\r\f\x0B]+").alias("tokens"), (T.matches(stem, T.SENTENCE_END) + 1).alias("sentences"), *counts)


@query("f5_surface_features_en", f"SELECT doc_id, {_count('stem', '[∑∫√∞≈≠≤≥±×÷^=+*/<>-]')} AS math_symbols, {_count('stem', '[=≈≠]')} AS equations, len(list_filter(string_split_regex(stem, '[.!?]+'), lambda x: trim(x) <> ''))::BIGINT AS sentences FROM ({DOCS})")
def f5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surface counts that leave empty sentences out."""
    stem = F.col("stem")
    sentences = F.size(F.filter(F.split(stem, r"[.!?]+"), lambda x: F.trim(x) != "")).cast("long")
    return docs(spark, sf_dir).select("doc_id", T.matches(stem, "[∑∫√∞≈≠≤≥±×÷^=+*/<>-]").alias("math_symbols"), T.matches(stem, "[=≈≠]").alias("equations"), sentences.alias("sentences"))


@query("f6_parse_score", f"SELECT doc_id, score IS NOT NULL AS valid, CASE WHEN score IS NOT NULL THEN least(greatest(score, 0.0), 1.0) END AS score FROM (SELECT doc_id, TRY_CAST(nullif(regexp_extract(stem, '{T.SCORE}'), '') AS DOUBLE) AS score FROM ({DOCS}))")
def f6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score parsed from every text, and whether there is one."""
    score = T.parse_score(F.col("stem"))
    return docs(spark, sf_dir).select("doc_id", score.isNotNull().alias("valid"), score.alias("score"))


RULES = (
    ("EXCLUDE_MISSING_STEM", f"length(trim(stem)) < {T.SHORTEST}"),
    ("EXCLUDE_TRUNCATED_CONTENT", f"length(trim(stem)) < {T.TRUNCATED}"),
    ("EXCLUDE_NON_MATHEMATICS", "source IN ('src0', '')"),
    ("EXCLUDE_UNRESOLVED_TEMPLATE", ("stem", T.TEMPLATE)),
    ("EXCLUDE_REQUIRED_IMAGE", ("stem", T.IMAGE_PLACEHOLDER)),
    ("EXCLUDE_REQUIRED_DIAGRAM", ("stem", T.FIGURE_REFERENCE)),
    ("EXCLUDE_OTHER_STATIC_CONTENT_FAILURE", f"length(stem) > {T.LONGEST}"),
)
PASSED = "PASS_TEXT_COMPLETE"


def _sql_rule(rule: str | tuple[str, str]) -> str:
    return rule if isinstance(rule, str) else f"regexp_matches({rule[0]}, '{_q(rule[1])}')"


def _column_rule(rule: str | tuple[str, str]):
    return F.expr(rule) if isinstance(rule, str) else F.col(rule[0]).rlike(rule[1])


CLASSIFIED = "CASE " + " ".join(f"WHEN {_sql_rule(r)} THEN '{n}'" for n, r in RULES) + f" ELSE '{PASSED}' END"


def classified(rows: DataFrame) -> DataFrame:
    """``rows`` with the first content rule that excludes them, or the pass mark, as ``reason``."""
    return rows.withColumn("reason", T.first_rule(tuple((n, _column_rule(r)) for n, r in RULES), PASSED))


@query("f7_content_rule_classifier", f"SELECT doc_id, {CLASSIFIED} AS reason FROM ({DOCS})")
def f7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first content rule that excludes each document."""
    return classified(docs(spark, sf_dir)).select("doc_id", "reason")


WARNINGS = (("image_placeholder", ("stem", T.IMAGE_PLACEHOLDER)), ("figure_reference", ("stem", T.FIGURE_REFERENCE)), ("malformed_expression", "contains(stem, chr(92)) AND NOT contains(stem, '$')"), ("prompt_length_risk", f"length(stem) > {T.LONGEST}"))


@query("f8_content_secondary_flags", "SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {_sql_rule(r)} THEN '{n}' END" for n, r in WARNINGS) + f"], lambda x: x IS NOT NULL), '|') AS flags FROM ({DOCS})")
def f8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All warnings of each document."""
    return docs(spark, sf_dir).select("doc_id", T.all_flags(tuple((n, _column_rule(r)) for n, r in WARNINGS)).alias("flags"))


IMAGE_CUE = r"(?i)(<img|!\[[^\]]*\]\([^)]+\)|\.(png|jpe?g|gif|svg|webp)|figure\s*[0-9]|see\s+(the\s+)?(figure|diagram|image))"
PLACEHOLDER = r"(\{\{[^{}]+\}\}|\$\{[^}]+\}|<%[^%]+%>|\[\[[^\]]+\]\]|TODO_FILL|FIXME)"
CUT_OFF = r"(\.{3}|…|TRUNCATED|\[cut\])\s*$"


@query("f9_text_completeness_classifier", f"SELECT page_id, CASE WHEN plain = '' THEN 'EXCLUDE_MISSING_STEM' WHEN plain = title AND length(plain) < 40 THEN 'EXCLUDE_OTHER' WHEN regexp_matches(plain, '{_q(CUT_OFF)}') THEN 'EXCLUDE_TRUNCATED_CONTENT' WHEN regexp_matches(plain, '{_q(PLACEHOLDER)}') THEN 'EXCLUDE_UNRESOLVED_TEMPLATE' WHEN contains(plain, '�') THEN 'EXCLUDE_MALFORMED_CONTENT' WHEN regexp_matches(plain, '{_q(IMAGE_CUE)}') AND length(plain) < 80 THEN 'EXCLUDE_REQUIRED_IMAGE' ELSE 'PASS_TEXT_COMPLETE' END AS status FROM (SELECT page_id, {_strip('html')} AS plain, {_strip('''regexp_extract(html, '%s', 1)''' % _q(T.TITLE))} AS title FROM pages)")
def f9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completeness of every page's text by ordered rules."""
    plain = F.col("plain")
    rules = (
        ("EXCLUDE_MISSING_STEM", plain == ""),
        ("EXCLUDE_OTHER", (plain == F.col("title")) & (F.length(plain) < 40)),
        ("EXCLUDE_TRUNCATED_CONTENT", plain.rlike(CUT_OFF)),
        ("EXCLUDE_UNRESOLVED_TEMPLATE", plain.rlike(PLACEHOLDER)),
        ("EXCLUDE_MALFORMED_CONTENT", plain.contains("\ufffd")),
        ("EXCLUDE_REQUIRED_IMAGE", plain.rlike(IMAGE_CUE) & (F.length(plain) < 80)),
    )
    p = V.table(spark, sf_dir, "pages").select("page_id", T.html_to_text(F.col("html")).alias("plain"), T.html_to_text(F.regexp_extract("html", T.TITLE, 1)).alias("title"))
    return p.select("page_id", T.first_rule(rules, PASSED).alias("status"))


@query("f10_sectioned_text_builder", "SELECT conv_id, string_agg('[' || upper(role) || '] ' || coalesce(text, ''), chr(10) ORDER BY turn, role) AS sections FROM conversations GROUP BY conv_id")
def f10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled sections of each conversation, in order."""
    section = F.concat(F.lit("["), F.upper("role"), F.lit("] "), F.coalesce("text", F.lit("")))
    c = V.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", section.alias("s")))).alias("all"))
    return c.select("conv_id", F.array_join(F.col("all.s"), "\n").alias("sections"))


@query("f11_mcq_canonical_text", "SELECT o_orderkey AS question, 'Order ' || o_orderkey || chr(10) || string_agg(chr((64 + r)::INT) || '. ' || l_partkey, chr(10) ORDER BY r) AS canonical FROM (SELECT DISTINCT o_orderkey, l_partkey, dense_rank() OVER (PARTITION BY o_orderkey ORDER BY l_partkey) AS r FROM orders JOIN lineitem ON o_orderkey = l_orderkey) GROUP BY o_orderkey")
def f11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stem and its lettered choices in the order of their ids."""
    lines = V.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("question")).agg(F.array_sort(F.collect_set("l_partkey")).alias("choices"))
    asked = V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("question")).join(lines, "question")
    lettered = F.transform("choices", lambda x, i: F.concat(F.char(i + 65), F.lit(". "), x.cast("string")))
    return asked.select("question", F.concat_ws("\n", F.concat(F.lit("Order "), F.col("question").cast("string")), F.array_join(lettered, "\n")).alias("canonical"))


SYSTEM = "Rate the difficulty from 0 to 1."


#: Escapes of a JSON string: the backslash first, then the quote and the control characters.
ESCAPES = (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f"))
ESCAPES += tuple((chr(i), f"\\u{i:04x}") for i in range(1, 32) if chr(i) not in "\n\r\t\b\f")


def _escaped_sql(x: str) -> str:
    for raw, shown in ESCAPES:
        x = f"replace({x}, chr({ord(raw)}), '{shown}')"
    return f"replace({x}, chr(0), '\\u0000')"


@query("f12_prompt_render_hash", f"""SELECT doc_id, sha256('[{{"role": "system", "content": "{SYSTEM}"}}, {{"role": "user", "content": "' || {_escaped_sql('stem')} || '"}}]') AS prompt_hash FROM ({DOCS})""")
def f12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash of the exact prompt of every document; other characters than those of ``ESCAPES`` stand as they are."""
    body = F.col("stem")
    for raw, shown in (*ESCAPES, ("\0", "\\u0000")):
        body = F.replace(body, F.lit(raw), F.lit(shown))
    prompt = F.concat(F.lit(f'[{{"role": "system", "content": "{SYSTEM}"}}, {{"role": "user", "content": "'), body, F.lit('"}]'))
    return docs(spark, sf_dir).select("doc_id", F.sha2(prompt, 256).alias("prompt_hash"))


@query("f13_request_cache_key", "SELECT doc_id, model, sha256('v1|' || model || '|' || doc_id || '|' || sha256(coalesce(text, '')) || '|0.0|2024') AS cache_key FROM documents, (SELECT unnest(['model_a', 'model_b']) AS model)")
def f13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cache keys of all requests; numbers go in as text."""
    d = docs(spark, sf_dir).select("doc_id", F.sha2("stem", 256).alias("content"), F.explode(F.array(F.lit("model_a"), F.lit("model_b"))).alias("model"))
    return d.select("doc_id", "model", hashed(F.lit("v1"), "model", "doc_id", "content", F.lit("0.0"), 2024).alias("cache_key"))


CLASSES = (
    ("transient_connection", "contains(e, 'connection') OR contains(e, 'timeout')"),
    ("rate_limit", "contains(e, 'rate') AND contains(e, 'limit')"),
    ("model_unavailable", "contains(e, 'model_not_found') OR contains(e, 'does not exist')"),
    ("invalid_request", "contains(e, 'invalid_request') OR contains(e, 'unsupported_parameter')"),
    ("content_policy", "contains(e, 'content_policy') OR contains(e, 'content_filter')"),
    ("model_unavailable", "contains(e, 'permission') OR contains(e, '403')"),
)


@query("f14_error_class", "SELECT conv_id, turn, class, class IN ('transient_connection', 'rate_limit', 'unknown') AS retryable FROM (SELECT conv_id, turn, CASE " + " ".join(f"WHEN {c} THEN '{n}'" for n, c in CLASSES) + " ELSE 'unknown' END AS class FROM (SELECT *, lower(coalesce(text, '')) AS e FROM conversations))")
def f14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error classes of texts in a fixed order, and whether to try again."""
    c = V.table(spark, sf_dir, "conversations").withColumn("e", F.lower(F.coalesce("text", F.lit(""))))
    c = c.select("conv_id", "turn", T.first_rule(tuple((n, F.expr(x)) for n, x in CLASSES), "unknown").alias("class"))
    return c.withColumn("retryable", F.col("class").isin("transient_connection", "rate_limit", "unknown"))


@query("f15_token_cost_estimate", f"SELECT doc_id, greatest(1, length(stem) // 4) AS tokens, round(greatest(1, length(stem) // 4) * 0.00015 / 1000, 9) AS cost FROM ({DOCS})")
def f15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimated tokens and cost."""
    d = docs(spark, sf_dir).select("doc_id", F.greatest(F.lit(1), F.floor(F.length("stem") / 4)).alias("tokens"))
    return d.withColumn("cost", F.round(F.col("tokens") * 0.00015 / 1000, 9))


REVIEW = (("format_failure", "text IS NULL OR trim(text) = ''"), ("limited", "length(text) < 20"), ("invented", "contains(lower(text), 'sorry') OR contains(lower(text), 'cannot')"))


@query("f16_review_label", "SELECT conv_id, turn, CASE " + " ".join(f"WHEN {c} THEN '{n}'" for n, c in REVIEW) + " ELSE 'pass' END AS label FROM conversations")
def f16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review labels of replies by ordered rules."""
    return V.table(spark, sf_dir, "conversations").select("conv_id", "turn", T.first_rule(tuple((n, F.expr(c)) for n, c in REVIEW), "pass").alias("label"))


LIMITS = (("truncated_stem", "length(trim(stem)) < 10"), ("malformed_expression", "contains(stem, chr(92)) AND NOT contains(stem, '$')"), ("missing_option_context", "lang = 'de' AND NOT contains(stem, 'A.') AND NOT contains(stem, 'A、')"), ("unresolved_template_variables", "contains(stem, '{{') OR contains(stem, '[[[')"), ("prompt_length_risk", f"length(stem) > {T.LONGEST}"))


@query("f17_limitation_flags", "SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in LIMITS) + f"], lambda x: x IS NOT NULL), '|') AS flags FROM ({DOCS})")
def f17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content limitations of each document."""
    return docs(spark, sf_dir).select("doc_id", T.all_flags(tuple((n, F.expr(c)) for n, c in LIMITS)).alias("flags"))


@query("f18_script_ratio", f"SELECT doc_id, round({_count('stem', T.CJK)} / greatest(length(stem), 1), 6) AS cjk_share, round({_count('stem', '[^\\x00-\\x7F]')} / greatest(length(stem), 1), 6) AS non_ascii_share FROM ({DOCS})")
def f18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of CJK and of non-ASCII characters."""
    n = F.greatest(F.length("stem"), F.lit(1))
    share = lambda p: F.round(T.matches(F.col("stem"), p) / n, 6)
    return docs(spark, sf_dir).select("doc_id", share(T.CJK).alias("cjk_share"), share(r"[^\x00-\x7F]").alias("non_ascii_share"))


@query("f19_first_of_list", "SELECT p_partkey, list_transform(string_split(regexp_replace(p_brand || '_' || p_size, '[^0-9_]', '', 'g'), '_'), lambda x: coalesce(TRY_CAST(x AS INT), 0))[1] AS concept, p_size AS last_value FROM part")
def f19_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of a list of integers in text, 0 when it is none."""
    parts = F.split(F.regexp_replace(F.concat_ws("_", "p_brand", F.col("p_size").cast("string")), "[^0-9_]", ""), "_")
    ints = F.transform(parts, lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))
    return V.table(spark, sf_dir, "part").select("p_partkey", F.get(ints, F.lit(0)).alias("concept"), F.element_at(ints, -1).alias("last_value"))


LISTS = "SELECT l_orderkey, string_agg(l_partkey, ',' ORDER BY l_linenumber, l_partkey, l_suppkey) AS items, string_agg(CASE l_partkey % 10 WHEN 9 THEN '' WHEN 8 THEN 'none_8' ELSE (l_partkey % 10) || '_' || l_suppkey END, ',' ORDER BY l_linenumber, l_partkey, l_suppkey) AS concepts FROM lineitem GROUP BY l_orderkey"


@query("f19_int_list_parse", f"SELECT l_orderkey, array_to_string(list_transform(string_split(items, ','), lambda x: CAST(x AS BIGINT)), '|') AS items, array_to_string(list_transform(c, lambda x: coalesce(x, 0)), '|') AS concepts, len(list_filter(c, lambda x: x IS NULL)) AS failures FROM (SELECT *, list_transform(string_split(concepts, ','), lambda x: TRY_CAST(string_split(x, '_')[1] AS BIGINT)) AS c FROM ({LISTS}))")
def f19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comma lists of an order's items and concepts as numbers, concepts that are none as 0 and counted."""
    ends = F.pmod("l_partkey", F.lit(10))
    concept = F.when(ends == 9, "").when(ends == 8, "none_8").otherwise(F.concat_ws("_", ends.cast("string"), F.col("l_suppkey").cast("string")))
    lines = V.table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_partkey").cast("string").alias("item"), concept.alias("concept")).alias("line"))
    orders = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("line")).alias("lines"))  # an order has few lines
    lists = orders.select("l_orderkey", F.array_join("lines.item", ",").alias("items"), F.array_join("lines.concept", ",").alias("concepts"))
    read = lists.select("l_orderkey", T.int_list("items").alias("items"), T.int_list("concepts", "_").alias("concepts"))
    shown = lambda c: F.array_join(c.cast("array<string>"), "|")
    return read.select("l_orderkey", shown(F.col("items")).alias("items"), shown(T.zero_failures(F.col("concepts"))).alias("concepts"), F.size(F.filter("concepts", lambda x: x.isNull())).alias("failures"))


@query("f20_sequence_arrays", V.sql("SELECT learner, string_agg(item, ',' ORDER BY r) AS items, string_agg(correct, ',' ORDER BY r) AS corrects, count(*) AS length, 80 - count(*) AS padding FROM (SELECT *, row_number() OVER (PARTITION BY learner ORDER BY ts, event_id) AS r FROM ix) WHERE r <= 80 GROUP BY learner", "ix"))
def f20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parallel arrays of each learner's first eighty interactions, as text."""
    rows = V.ix(spark, sf_dir).withColumn("r", F.row_number().over(Window.partitionBy("learner").orderBy("ts", "event_id"))).where("r <= 80")
    s = rows.groupBy("learner").agg(F.array_sort(F.collect_list(F.struct("r", "item", "correct"))).alias("s"))
    text = lambda c: F.array_join(F.transform(F.col(f"s.{c}"), lambda x: x.cast("string")), ",").alias(f"{c}s")
    return s.select("learner", text("item"), text("correct"), F.size("s").alias("length"), (80 - F.size("s")).alias("padding"))


@query("f21_hash_dropout", V.sql("SELECT event_id, CASE WHEN CAST('0x' || substr(sha256('drop|' || learner || '|' || event_id), 1, 12) AS BIGINT) % 10000 / 10000.0 < 0.1 THEN 1 ELSE item + 2 END AS idx FROM ix", "ix"))
def f21(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item indices, a stable tenth of them replaced by "unknown"."""
    draw = hash_number(hashed(F.lit("drop"), "learner", "event_id"), 12) % 10000 / 10000.0
    return V.ix(spark, sf_dir).select("event_id", F.when(draw < 0.1, F.lit(1)).otherwise(F.col("item") + 2).alias("idx"))


@query("f22_text_snippet", f"SELECT doc_id, CASE WHEN length(s) > 80 THEN substr(s, 1, 77) || '...' ELSE s END AS snippet FROM (SELECT doc_id, trim(replace(stem, chr(10), ' ')) AS s FROM ({DOCS}))")
def f22(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eighty characters on one line."""
    d = docs(spark, sf_dir).select("doc_id", F.trim(F.replace("stem", F.lit("\n"), F.lit(" "))).alias("s"))
    return d.select("doc_id", F.when(F.length("s") > 80, F.concat(F.substring("s", 1, 77), F.lit("..."))).otherwise(F.col("s")).alias("snippet"))


@query("f23_math_title_flag", f"SELECT page_id, length(trim(t)) >= 2 AND (regexp_matches(t, '{_q(T.MATH_CHARACTERS)}') OR regexp_matches(t, '({'|'.join(T.MATH_TERMS)})')) AS is_math FROM (SELECT page_id, regexp_extract(html, '{_q(T.TITLE)}', 1) AS t FROM pages)")
def f23(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles with digits, operators or a mathematical term."""
    p = V.table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", T.TITLE, 1).alias("t"))
    return p.select("page_id", ((F.length(F.trim("t")) >= 2) & (F.col("t").rlike(T.MATH_CHARACTERS) | F.col("t").rlike("|".join(T.MATH_TERMS)))).alias("is_math"))


@query("f24_content_column_presence", "SELECT p_partkey, trim(coalesce(p_name, '')) <> '' AS has_content FROM part")
def f24(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether any column named like a stem holds something."""
    p = V.table(spark, sf_dir, "part")
    named = [c for c in p.columns if any(word in c for word in ("name", "stem", "content", "question"))]
    some = [F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != "" for c in named]
    return p.select("p_partkey", (F.greatest(*some) if len(some) > 1 else some[0] if some else F.lit(False)).alias("has_content"))
