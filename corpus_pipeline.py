"""From raw documents to packed training sequences, in five stages.

Each stage takes what the one before it kept, with the columns of ``documents``; its decisions take effect. Ids that
are null or repeat are replaced by row numbers inside a stage, so that decisions are made row by row.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugewell.llm import secrets, toxicity
from gaugewell.llm.decontamination import contaminated
from gaugewell.llm.jaccard_join import jaccard_components
from gaugewell.llm.packing import packed_pieces
from gaugewell.llm.session import remove, scratch, shared_dir, written
from gaugewell.plans.registry import Catalog

CATALOG = Catalog()
ROW = "_row"
#: What columns are called while an operator adds its own beside them.
HELD = "_held_"


def _rows(docs: DataFrame) -> DataFrame:
    """``docs`` with a key of its own for every row, in the order of id and text."""
    repeated = docs.groupBy("doc_id").count().where(F.col("doc_id").isNull() | (F.col("count") > 1))
    if repeated.isEmpty():
        return docs.withColumn(ROW, F.col("doc_id"))
    return written(docs.orderBy(F.col("doc_id").asc_nulls_first(), "text").withColumn(ROW, F.monotonically_increasing_id()), "rows")


def _held(docs: DataFrame) -> DataFrame:
    """``docs`` with names that no operator uses."""
    return docs.select(*[F.col(c).alias(f"{HELD}{c}") for c in docs.columns])


def _given(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` out of ``rows``, under their own names."""
    return rows.select(*[F.col(f"{HELD}{c}").alias(c) for c in docs.columns])


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain, fitted on the labelled ones among them, does not call toxic."""
    chain = toxicity.fit_chain(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = _held(docs)
    scored = toxicity.score(held, chain, *held.columns, text_col=f"{HELD}text")
    return _given(scored.where(F.col("toxic") == 0), docs)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: that with the smallest id."""
    rows = _rows(docs)
    found = jaccard_components(rows, id_col=ROW)
    kept = found.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(ROW))
    return rows.join(kept, ROW, "left_semi").select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    rows = _rows(docs)
    found = contaminated(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=ROW)
    return rows.join(found.select(F.col("doc_id").alias(ROW)).distinct(), ROW, "left_anti").select(*docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret in them replaced by a mark, with the length of the new text."""
    held = _held(docs)
    found = secrets.redact_documents(held, *held.columns, text_col=f"{HELD}text").withColumn("_some", F.size("spans") > 0)
    found = found.withColumn(f"{HELD}text", F.col("clean"))
    if "n_chars" in docs.columns:
        length = F.when(F.col("_some"), F.length(f"{HELD}text").cast("long")).otherwise(F.col(f"{HELD}n_chars"))
        found = found.withColumn(f"{HELD}n_chars", length)
    return _given(found, docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, each a sequence of a power of two."""
    return packed_pieces(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("secrets", without_secrets),
    ("packing", packed),
]
#: The chain's models and tokenizers are not SQL; the stages are tested against brute force and held-out accuracy.
ORACLE_SQL = None


@CATALOG.query("pipeline", ORACLE_SQL)
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each one's rows written in the shared folder for the next.

    A stage's own tables are removed once its rows are written, and those of the stage before it then.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        table = f"{shared_dir(spark)}/stage-{name}-{uuid.uuid4().hex}"
        with scratch(spark):
            docs = written(stage(spark, docs, sf_dir), name, table)
        if before is not None:
            remove(spark, before)
        before = table
    return STAGES[-1][1](spark, docs, sf_dir)
