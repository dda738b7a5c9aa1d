"""Registered queries of the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugewell.llm import licenses, pii, secrets, toxicity
from gaugewell.llm.decontamination import contaminated
from gaugewell.llm.fingerprints import documents_with_classes
from gaugewell.llm.html_extraction import extract_pages
from gaugewell.llm.jaccard_join import jaccard_components
from gaugewell.llm.merkle import document_manifest
from gaugewell.llm.packing import packed_pieces
from gaugewell.llm.spelling import spelling_groups
from gaugewell.llm.substring_dedup import remove_repeats
from gaugewell.llm.token_files import token_files_round_trip
from gaugewell.plans.registry import Catalog

CATALOG = Catalog()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


WORDS = r"[^\x20\x09-\x0D]+"
REMOVAL_SQL = f"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS ws FROM documents),
k AS (SELECT doc_id, unnest(list_transform(range(1, len(ws) - 18), lambda i: md5(array_to_string(ws[i:i + 19], ' ')))) AS key, unnest(range(1, len(ws) - 18)) AS st FROM d WHERE len(ws) >= 20),
f AS (SELECT doc_id, st FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id, st) AS r FROM k) WHERE r > 1),
g AS (SELECT DISTINCT doc_id, st + j AS pos FROM f, (SELECT unnest(range(0, 20)) AS j)),
w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS t FROM w ANTI JOIN g USING (doc_id, pos) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""
COMPONENTS_SQL = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}') AS ws FROM documents),
s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: md5_number(array_to_string(ws[i:i + 4], ' ')))) WHEN len(ws) > 0 THEN [md5_number(array_to_string(ws, ' '))] ELSE [] END AS sh FROM d),
u AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS h FROM s),
e AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2 HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
t AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, t.b FROM r JOIN t ON r.b = t.a)
SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, c AS component_id FROM s JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) ON a = s.doc_id"""

#: CRC-32 of a list of byte values, by the table of its polynomial.
_CRC_TABLE = "SELECT list_transform(range(0, 256), lambda i: list_reduce(list_concat([i], range(0, 8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END)) AS tab"
_CRC = "xor(4294967295, list_reduce(list_concat([4294967295], {bytes}), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])))"
_LEAF = "sha256(" + " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c} END" for c in ("doc_id", "source", "lang", "{n}", "text")) + ")"
_PARENTS = "list_transform(range(1, len(nodes) + 1, 2), lambda i: sha256(nodes[i] || coalesce(nodes[i + 1], '')))"
MANIFEST_SQL = f"""
WITH RECURSIVE crc AS MATERIALIZED ({_CRC_TABLE}),
h AS (SELECT documents.*, {_CRC.format(bytes="list_transform(string_split(doc_id::VARCHAR, ''), lambda x: unicode(x)::BIGINT)")} % 7 = 0 AS hit FROM documents, crc),
d AS MATERIALIZED (SELECT doc_id, coalesce('1' || lang, '0') AS grp, {_LEAF.format(n="n_chars")} AS leaf, CASE WHEN hit THEN {_LEAF.format(n="(n_chars + 1)")} ELSE {_LEAF.format(n="n_chars")} END AS changed FROM h),
e AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p FROM d),
t(grp, lv, nodes) AS (SELECT grp, 0, list(leaf ORDER BY p) FROM e GROUP BY grp UNION ALL SELECT grp, lv + 1, {_PARENTS} FROM t WHERE len(nodes) > 1),
s AS MATERIALIZED (SELECT grp, nodes[1] AS subroot, row_number() OVER (ORDER BY grp) - 1 AS q, lv AS height FROM t WHERE len(nodes) = 1),
u(lv, nodes) AS (SELECT 0, list(subroot ORDER BY q) FROM s UNION ALL SELECT lv + 1, {_PARENTS} FROM u WHERE len(nodes) > 1),
v AS MATERIALIZED (SELECT grp, lv, nodes FROM t WHERE len(nodes) > 1 UNION ALL SELECT s.grp, height + u.lv, u.nodes FROM s, u WHERE len(u.nodes) > 1),
f(doc_id, grp, p, lv, proof, digest) AS (SELECT doc_id, grp, p, 0, '', changed FROM e UNION ALL
  SELECT f.doc_id, f.grp, CASE WHEN f.lv + 1 = s.height THEN s.q ELSE f.p // 2 END, f.lv + 1, proof || coalesce(v.nodes[xor(w, 1) + 1], ''),
  sha256(CASE WHEN w % 2 = 0 THEN digest || coalesce(v.nodes[w + 2], '') ELSE v.nodes[w] || digest END)
  FROM (SELECT f.*, CASE WHEN f.lv = 0 AND z.height = 0 THEN z.q ELSE f.p END AS w FROM f JOIN s z ON z.grp = f.grp) f JOIN v ON v.grp = f.grp AND v.lv = f.lv JOIN s ON s.grp = f.grp)
SELECT e.doc_id, e.leaf, s.subroot, r.root, sha256(f.proof) AS proof_sha256, f.digest AS folded_root, f.digest = r.root AS verified
FROM e JOIN s USING (grp) JOIN (SELECT doc_id, max_by(proof, lv) AS proof, max_by(digest, lv) AS digest FROM f GROUP BY doc_id) f USING (doc_id), (SELECT nodes[1] AS root FROM u WHERE len(nodes) = 1) r"""

_RUN_BYTES = "flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195, unicode(x)::BIGINT - 64] END))"
SPELLING_SQL = f"""
WITH RECURSIVE crc AS MATERIALIZED ({_CRC_TABLE}),
r AS (SELECT doc_id, run, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents) WHERE length(run) >= 6 GROUP BY 1, 2),
h AS (SELECT run, c, {_CRC.format(bytes=_RUN_BYTES)} AS h FROM r, crc),
w AS MATERIALIZED (SELECT word, sum(c)::BIGINT AS n, string_split(word, '') AS cs FROM (SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, c FROM h) WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
k AS (SELECT word, n, unnest(range(1, len(cs) + 1)) AS i FROM w),
g AS MATERIALIZED (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS less FROM k),
e AS (SELECT a.word AS a, b.word AS b, b.n AS m FROM g a JOIN g b ON a.less = b.less AND a.i = b.i AND a.word <> b.word UNION SELECT g.word, w.word, w.n FROM g JOIN w ON w.word = g.less UNION SELECT w.word, g.word, g.n FROM g JOIN w ON w.word = g.less),
b AS (SELECT a AS word, count(*) AS n_near, max(m) AS m FROM e GROUP BY a),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN b.m >= 5 * w.n THEN b.m END AS form_n, CASE WHEN b.m >= 5 * w.n THEN (SELECT min(e.b) FROM e WHERE e.a = w.word AND e.m = b.m) END AS form FROM w LEFT JOIN b USING (word)),
t(word, top) AS (SELECT word, word FROM f UNION ALL SELECT t.word, f.form FROM t JOIN f ON f.word = t.top WHERE f.form IS NOT NULL)
SELECT f.word, f.form, t.top AS root, f.n, f.n_near, f.form_n FROM f JOIN t USING (word) JOIN f z ON z.word = t.top WHERE z.form IS NULL"""


@CATALOG.query("op1_substring_dedup", REMOVAL_SQL)
def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of what is left of every document once repeated 20-word windows are cut out."""
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@CATALOG.query("op2_fingerprints")
def document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document and of its edited text, how alike they and the next document are, and its class."""
    return documents_with_classes(table(spark, sf_dir, "documents"))


@CATALOG.query("op4_jaccard_join", COMPONENTS_SQL)
def jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document at a shingle similarity of 0.8."""
    return jaccard_components(table(spark, sf_dir, "documents"))


@CATALOG.query("op5_secret_scans", secrets.oracle())
def secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, counted and listed by kind and span."""
    found = secrets.scan_documents(table(spark, sf_dir, "documents"), "doc_id")
    counts = [F.size(F.expr(f"filter(spans, s -> s.kind = '{kind}')")).cast("long").alias(f"n_{kind}") for kind in secrets.BASE]
    base = F.filter("spans", lambda s: s["rank"] < len(secrets.BASE))
    return found.select("doc_id", *counts, F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"))


@CATALOG.query("op6_token_files")
def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum as read back from its token file."""
    return token_files_round_trip(table(spark, sf_dir, "documents"))


@CATALOG.query("op8_packing")
def packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of all documents with their sequences."""
    return packed_pieces(table(spark, sf_dir, "documents"))


@CATALOG.query("op9_license_scans", licenses.oracle())
def license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and templates found in every document."""
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).drop("blocks")


@CATALOG.query("op10_decontamination")
def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents, with the best window of each."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@CATALOG.query("op3_html_extraction")
def html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    found = extract_pages(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


@CATALOG.query("op7_toxicity")
def toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities and decisions of the chain for every document."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit_chain(docs, table(spark, sf_dir, "labels")), "doc_id")


@CATALOG.query("op13_merkle_manifest", MANIFEST_SQL)
def merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots, proof and folded root of every document, and whether it verifies after tampering."""
    found = document_manifest(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", "verified")


@CATALOG.query("op11_spelling_variants", SPELLING_SQL)
def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word with its near words' number, its form and its root."""
    return spelling_groups(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


@CATALOG.query("op12_personal_data")
def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document, counted and listed by kind and span."""
    found = pii.personal_data(table(spark, sf_dir, "documents"), "doc_id")
    counts = [F.size(F.expr(f"filter(spans, s -> s.base and s.kind = '{kind}')")).cast("long").alias(f"n_{kind}") for kind in pii.BASE]
    base = F.filter("spans", lambda s: s["base"])
    return found.select("doc_id", *counts, F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"))
