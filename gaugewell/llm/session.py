"""Shared folder, lineage cuts and key handling used by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugewell.sources.files import cut
from gaugewell.sources.files import shared_folder as shared_dir

__all__ = ["cut", "fresh_path", "keyed", "named", "remove", "scratch", "shared_dir", "shuffle_width", "written"]
#: Tables that :func:`written` has made and :func:`scratch` removes; None outside of it.
_scratch: list[str] | None = None


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has been written to yet."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _scratch is not None:
        _scratch.append(path)
    return path


def written(frame: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """``frame`` written as a Parquet table in the shared folder, or under ``path``, and read again."""
    spark = frame.sparkSession
    path = path or fresh_path(spark, name)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table of our own in the shared folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are written inside are removed at the end; results must be written elsewhere before."""
    global _scratch
    before, _scratch = _scratch, []
    try:
        yield
    finally:
        for path in _scratch:
            remove(spark, path)
        _scratch = before


def shuffle_width(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def keyed(docs: DataFrame, *columns: str, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame | None]:
    """Rows of ``docs`` under a key that is unique and not null.

    Returns ``(rows, names)``. As a rule ``id_col`` is such a key already: ``rows`` has it as ``doc_id``
    and ``names`` is None. If an id is null or occurs twice, rows are numbered in the order of id (null
    first), then of the given columns; equal rows follow each other in any order. ``rows`` has the number
    as ``doc_id``, and ``names`` maps it back (``doc_id``, ``given_id``). The numbers are written once, so
    that a task that runs again sees the same ones.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *columns)
    repeated = rows.groupBy("doc_id").count().where(F.col("doc_id").isNull() | (F.col("count") > 1))
    if repeated.isEmpty():
        return rows.where(F.col("doc_id").isNotNull()), None
    numbered = rows.orderBy(F.col("doc_id").asc_nulls_first(), *columns).withColumnRenamed("doc_id", "given_id")
    numbered = written(numbered.withColumn("doc_id", F.monotonically_increasing_id()), "keyed")
    return numbered.select("doc_id", *columns), numbered.select("doc_id", "given_id")


def named(result: DataFrame, names: DataFrame | None, *id_columns: str) -> DataFrame:
    """``result`` with the given ids in place of the numbers of :func:`keyed` in ``id_columns``."""
    for column in id_columns if names is not None else ():
        order = result.columns
        lookup = names.select(F.col("doc_id").alias(column), F.col("given_id").alias("_given"))
        result = result.join(lookup, column).drop(column).withColumnRenamed("_given", column).select(*order)
    return result
