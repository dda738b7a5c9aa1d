"""Secret scans over every historical version of a path, by an incremental blob ledger; Spark SQL functions only.

Each version's text is content-addressed by its SHA-256. A text that stands under many paths or versions is one
blob and is scanned once; texts do not move for it, save those that repeat. A ledger is a folder of two tables:
``pairs``, the rules and rule versions each blob has been scanned by, and ``findings``, what they found. A run scans
the pairs that the ledger lacks, appends to both, and joins all findings back to every path that holds the blob.

Matches become spans by a running sum over the lengths of the matches and of the pieces between them, one row per
match, so that the work grows with the number of matches in a text and not with its square.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from gaugewell.llm.session import cut, fresh_path
from gaugewell.llm.spread import join_unique


class Rule(NamedTuple):
    """A kind of secret: where ``pattern`` matches, ``group`` has at least ``shortest`` characters.

    Only texts that hold ``hint``, a part of every match, are searched.
    """

    kind: str
    version: int
    pattern: str
    group: int
    shortest: int
    hint: str = ""


#: A private key to its END line; where another line comes first or none, to the end of the run of base64 lines.
_GAP = r"(?:\s|\\[nrt])"
PEM = (
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?>(?s:.*?)-----)END [A-Z ]*PRIVATE KEY-----"
    rf"|(?:{_GAP}*+(?:Proc-Type|DEK-Info|Version|Comment): ?[^\r\n\\]*+)*+(?:(?:{_GAP}*+[A-Za-z0-9+/=]{{40,}}+)++(?:{_GAP}++[A-Za-z0-9+/]++={{0,2}}+)?+|{_GAP}*+[A-Za-z0-9+/=]{{16,}}+)?+)"
)
#: The first three are the base rules; the order is that of spans with one start. ``access`` and ``hex`` ask for the
#: least length in the pattern itself, as their matches are whole runs and a shorter run holds no longer one.
RULES = (
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", 1, r"AKIA[A-Z0-9]{14,}", 0, 18, "AKIA"),
    Rule("hex", 1, r"[0-9a-f]{16,}", 0, 16),
    Rule("pem", 2, PEM, 0, 1, "-----BEGIN "),
    Rule("github", 2, r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1, "gh"),
    Rule("chat", 2, r"xox[abeprs]-[A-Za-z0-9-]{10,}", 0, 1, "xox"),
    # A run that is no token is taken whole, with an empty group: what starts later in it is none either.
    Rule("jwt", 2, r"eyJ(?:([A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)|[A-Za-z0-9_-]*+)", 1, 1, "eyJ"),
)
BASE = ("assign", "access", "hex")
#: The DuckDB twin has the base rules as the contract states them, and no atomic groups: it differs on texts that hold
#: a key's body or longer tokens.
TWIN_PATTERNS = {
    "access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]+", "pem": r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "github": r"gh[pousr]_[A-Za-z0-9]{36,255}", "chat": r"xox[abeprs]-[A-Za-z0-9-]{10,255}",
    "jwt": r"(eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})",
}
SPAN = "array<struct<start:long,rank:int,end:long,kind:string>>"
PAIRS = "blob binary, pairs array<struct<rule:string,version:int>>"
FINDINGS = "blob binary, rule string, version int, start long, end long"
#: Name of the setting with the folder of a lasting ledger; where it is unset each run starts one of its own.
LEDGER_SETTING = "gaugewell.secrets.ledger"
#: Rows of a hash and a few rule names, and spans, up to which a side is broadcast; past that Spark joins by shuffle.
BROADCAST_BLOBS = BROADCAST_SPANS = 500_000
#: Characters of the parts of a text in which marks are set.
PART = 4096


def content_address(text: Column) -> Column:
    """The blob id of a text; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _near(frame: DataFrame) -> DataFrame:
    """``frame``, of which the plan is cut, broadcast behind a count."""
    return F.broadcast(frame) if frame.count() <= BROADCAST_BLOBS else frame


def _is_small(found: DataFrame) -> bool:
    """Whether all spans together are few enough to be broadcast."""
    return (found.agg(F.sum(F.size("spans"))).first()[0] or 0) <= BROADCAST_SPANS


def _every_pair(rules: tuple[Rule, ...]) -> Column:
    return F.array(*[F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version")) for r in rules])


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Matches in ``blobs`` (``blob``, ``text``, ``kinds``: the rules to apply): :data:`FINDINGS`, one row a match.

    Matches of a rule are leftmost and do not overlap; those whose group is too short are dropped. Starts and ends
    count code points, the end exclusive.
    """
    found = blobs.select("blob", "text", *[F.when(F.array_contains("kinds", r.kind) & F.contains("text", F.lit(r.hint)), F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0))).alias(f"{r.kind}_found") for r in rules])
    found = found.where(reduce(Column.__or__, [F.size(f"{r.kind}_found") > 0 for r in rules]))
    sizes = lambda strings: F.transform(strings, lambda x: F.length(x))
    parts = []
    for r in rules:
        group = F.regexp_extract_all("text", F.lit(r.pattern), F.lit(r.group)) if r.group else F.col(f"{r.kind}_found")
        steps = F.arrays_zip(sizes(F.col(f"{r.kind}_found")).alias("long"), sizes(group).alias("group"), sizes(F.split("text", r.pattern, -1)).alias("gap"))
        parts.append(F.when(F.size(f"{r.kind}_found") > 0, F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version"), F.lit(r.shortest).alias("shortest"), steps.alias("steps"))))
    runs = found.select("blob", F.inline(F.array_compact(F.array(*parts))))
    # The piece after the last match has no match and no end.
    steps = runs.select("blob", "rule", "version", "shortest", F.posexplode("steps").alias("at", "step")).where("step.long is not null")
    order = Window.partitionBy("blob", "rule", "version").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    ended = steps.withColumn("end", F.sum(F.col("step.gap").cast("long") + F.col("step.long")).over(order))
    return ended.where(F.col("step.group") >= F.col("shortest")).select("blob", "rule", "version", (F.col("end") - F.col("step.long")).alias("start"), "end")


def distinct_blobs(versions: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(blob, text)`` once for every text of ``versions``, and the blobs alone.

    Only texts that repeat are shuffled, after one of each is left per task; the others stay where they are.
    """
    texts = versions.select(content_address(F.col(text_col)).alias("blob"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counts = cut(texts.groupBy("blob").agg(F.count(F.lit(1)).alias("n")))
    repeated = _near(counts.where("n > 1").select("blob"))
    once = texts.join(repeated, "blob", "left_anti").unionByName(texts.join(repeated, "blob", "left_semi").dropDuplicates(["blob"]))
    return once, counts.select("blob")


def unseen_pairs(blobs: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """:data:`PAIRS` of every row of ``blobs`` (``blob``) with a rule and version that ``ledger`` lacks for it."""
    every = _every_pair(rules)
    if ledger is None:
        return blobs.select("blob", every.alias("pairs"))
    seen = ledger.groupBy("blob").agg(F.flatten(F.collect_list("pairs")).alias("seen"))
    lacking = F.array_except(every, F.coalesce("seen", F.array().cast("array<struct<rule:string,version:int>>")))
    return blobs.join(seen, "blob", "left").select("blob", lacking.alias("pairs")).where(F.size("pairs") > 0)


def scan_new(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Findings and ledger rows of the pairs of ``versions`` that ``ledger`` lacks: :data:`FINDINGS`, :data:`PAIRS`.

    Append both to earlier ones. A null text is the empty blob, which has no findings.
    """
    once, blobs = distinct_blobs(versions, text_col)
    pairs = unseen_pairs(blobs, ledger, rules)
    if ledger is None:
        return scan_blobs(once.withColumn("kinds", F.array(*[F.lit(r.kind) for r in rules])), rules), pairs
    pairs = cut(pairs)
    wanted = _near(pairs.select("blob", F.col("pairs.rule").alias("kinds")))
    return scan_blobs(once.join(wanted, "blob"), rules), pairs


def read_ledger(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame] | None:
    """The tables ``pairs`` and ``findings`` of a ledger; None where there is none yet."""
    try:
        return spark.read.schema(PAIRS).parquet(f"{folder}/pairs"), spark.read.schema(FINDINGS).parquet(f"{folder}/findings")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def scan_into(versions: DataFrame, folder: str, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """Scan what the ledger in ``folder`` lacks of ``versions``, append to it, and return its findings of them.

    ``blob`` and ``spans`` of every blob with findings under the versions of ``rules``, sorted by start, then in the
    order of the rules. Findings are appended before the pairs that vouch for them: a run that breaks off between
    leaves pairs to be scanned again, whose findings count once.
    """
    spark = versions.sparkSession
    known = read_ledger(spark, folder)
    found, pairs = scan_new(versions, known[0] if known else None, rules, text_col)
    found.write.mode("append").parquet(f"{folder}/findings")
    pairs.write.mode("append").parquet(f"{folder}/pairs")
    current = F.broadcast(spark.createDataFrame([(r.kind, r.version, rank) for rank, r in enumerate(rules)], "rule string, version int, rank int"))  # one row per rule
    findings = spark.read.schema(FINDINGS).parquet(f"{folder}/findings")
    if known:
        # An older ledger may have findings of blobs that this run does not hold.
        findings = findings.join(versions.select(content_address(F.col(text_col)).alias("blob")).distinct(), "blob", "left_semi")
    findings = findings.distinct().join(current, ["rule", "version"])
    spans = F.array_sort(F.collect_list(F.struct("start", "rank", "end", F.col("rule").alias("kind"))))
    return findings.groupBy("blob").agg(spans.alias("spans"))


def ledger_folder(spark: SparkSession) -> str:
    """The folder that :data:`LEDGER_SETTING` names, or a new one in the shared folder."""
    return spark.conf.get(LEDGER_SETTING, None) or fresh_path(spark, "ledger")


def scan_documents(docs: DataFrame, *keep: str, rules: tuple[Rule, ...] = RULES, text_col: str = "text", ledger: str | None = None) -> DataFrame:
    """The columns ``keep``, ``blob`` and ``spans`` of every row of ``docs``, scanned through a ledger.

    ``ledger`` is its folder (see :func:`ledger_folder`). One row per row: nulls, blank texts and repeated ids are
    kept, and have the spans of their text; other columns are ignored. An empty table gives an empty result.
    """
    found = cut(scan_into(docs, ledger or ledger_folder(docs.sparkSession), rules, text_col))
    paths = docs.select(*keep, content_address(F.col(text_col)).alias("blob"))
    return join_unique(paths, found, "blob", "left", _is_small(found)).select(*keep, "blob", F.coalesce("spans", F.array().cast(SPAN)).alias("spans"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def marks_of(found: DataFrame, part: int = PART) -> DataFrame:
    """Where marks go in each blob of ``found`` (``blob``, ``spans``): ``blob`` and ``marks``.

    Overlapping or touching spans become one run, by a running maximum; runs are cut at the edges of parts of ``part``
    characters. ``marks`` maps the number of a part to its cuts in order: start and end in the part, and whether the
    run starts there, which is where its mark is set.
    """
    spans = found.select("blob", F.inline("spans"))
    order = Window.partitionBy("blob").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    fresh = (F.col("start") > F.coalesce(F.max("end").over(order), F.lit(-1))).cast("long")
    numbered = spans.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(Window.partitionBy("blob").orderBy("start", "end")))
    runs = numbered.groupBy("blob", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    cuts = runs.withColumn("part", F.explode(F.sequence(F.floor(F.col("start") / part), F.floor((F.col("end") - 1) / part))))
    edge = F.col("part") * part
    cuts = cuts.select("blob", "part", F.struct(F.greatest(F.col("start") - edge, F.lit(0)).alias("start"), F.least(F.col("end") - edge, F.lit(part)).alias("end"), (F.col("start") >= edge).alias("first")).alias("cut"))
    parts = cuts.groupBy("blob", "part").agg(F.array_sort(F.collect_list("cut")).alias("cuts"))
    return parts.groupBy("blob").agg(F.map_from_entries(F.collect_list(F.struct("part", "cuts"))).alias("marks"))


def redacted(text: Column, marks: Column, mark: str = "[SECRET]", part: int = PART) -> Column:
    """``text`` with every run of :func:`marks_of` replaced by ``mark``; a part at a time, so that no text is copied per span."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def in_part(piece: Column, number: Column) -> Column:
        def step(state: Column, c: Column) -> Column:
            gap = F.substring(piece, (state["at"] + 1).cast("int"), (c["start"] - state["at"]).cast("int"))
            return F.struct(F.concat(state["out"], gap, F.when(c["first"], F.lit(mark)).otherwise(F.lit(""))).alias("out"), c["end"].cast("long").alias("at"))

        rest = lambda state: F.concat(state["out"], F.substring(piece, (state["at"] + 1).cast("int"), F.lit(part)))
        return F.coalesce(F.aggregate(F.try_element_at(marks, number.cast("long")), start, step, rest), piece)

    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{part}}}"), F.lit(0))
    return F.when(marks.isNotNull(), F.array_join(F.transform(pieces, in_part), "")).otherwise(text)


def redact_documents(docs: DataFrame, *keep: str, rules: tuple[Rule, ...] = RULES, text_col: str = "text", ledger: str | None = None, mark: str = "[SECRET]") -> DataFrame:
    """The columns ``keep`` of every row of ``docs``, its ``spans``, and ``clean``, its text with ``mark`` for each run of them.

    A text without spans, or null, is as it was. Rows are as in :func:`scan_documents`.
    """
    found = scan_into(docs, ledger or ledger_folder(docs.sparkSession), rules, text_col)
    found = cut(found)
    marks = cut(found.join(marks_of(found), "blob"))
    rows = docs.select(*keep, F.col(text_col).alias("_text"), content_address(F.col(text_col)).alias("blob"))
    met = join_unique(rows, marks, "blob", "left", _is_small(found))
    return met.select(*keep, F.coalesce("spans", F.array().cast(SPAN)).alias("spans"), redacted(F.col("_text"), F.col("marks"), mark).alias("clean"))


def _sql_parts(rule: Rule) -> str:
    """Matches, pieces between them and groups of one rule, each computed once."""
    k, pattern = rule.kind, rule.pattern.replace("'", "''")
    return f"regexp_extract_all(t, '{pattern}', 0) AS f_{k}, string_split_regex(t, '{pattern}') AS p_{k}, regexp_extract_all(t, '{pattern}', {rule.group}) AS g_{k}"


def _sql_spans(rule: Rule, rank: int) -> str:
    k = rule.kind
    return (
        f"list_filter(list_transform(range(1, len(f_{k}) + 1), lambda i: {{"
        f"'s': list_sum(list_transform(p_{k}[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(f_{k}[1:i-1], lambda x: length(x))), 0)::BIGINT, "
        f"'r': {rank}, 'n': length(f_{k}[i])::BIGINT, 'k': '{k}', 'ok': length(g_{k}[i]) >= {rule.shortest}}}), lambda x: x.ok)"
    )


def oracle() -> str:
    """DuckDB twin of the op5 query."""
    rules = [rule._replace(pattern=TWIN_PATTERNS.get(rule.kind, rule.pattern)) for rule in RULES]
    spans = reduce(lambda a, b: f"list_concat({a}, {b})", [_sql_spans(rule, rank) for rank, rule in enumerate(rules)])
    text = lambda s: f"array_to_string(list_transform({s}, lambda x: x.k || ':' || x.s || ':' || (x.s + x.n)), ',')"
    count = ", ".join(f"len(list_filter(a, lambda x: x.k = '{kind}'))::BIGINT AS n_{kind}" for kind in BASE)
    return (
        f"WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t FROM documents), "
        f"m AS MATERIALIZED (SELECT doc_id, {', '.join(map(_sql_parts, rules))} FROM d), f AS (SELECT doc_id, list_sort({spans}) AS a FROM m) "
        f"SELECT doc_id, {count}, sha256({text('list_filter(a, lambda x: x.r < 3)')}) AS base_sha256, {text('a')} AS spans FROM f"
    )
