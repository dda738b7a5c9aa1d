"""Rows whose whole text also stands in an earlier row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewell.llm.session import cut
from gaugewell.llm.spread import join_unique

#: Repeated texts (a hash and an id each) up to which they are broadcast; past that Spark joins by shuffle.
BROADCAST_TEXTS = 500_000


def whole_copies(rows: DataFrame) -> DataFrame:
    """``doc_id`` and ``first`` of every row of ``rows`` (``doc_id``, ``text``) whose text a smaller id has too.

    Texts are compared by SHA-256. Counts are partial aggregates; only texts that repeat are joined back, and as a
    rule they are few enough to be broadcast, so that a text which a third of all rows hold meets in no task.
    """
    texts = rows.select("doc_id", F.unhex(F.sha2("text", 256)).alias("content"))
    repeated = texts.groupBy("content").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    repeated = cut(repeated.select("content", "first"))
    few = repeated.count() <= BROADCAST_TEXTS
    return join_unique(texts, repeated, "content", few=few).where(F.col("doc_id") > F.col("first")).select("doc_id", "first")
