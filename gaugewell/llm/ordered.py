"""Documents dealt into consecutive id ranges, so that tasks can walk them in id order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugewell.llm.packed import packed
from gaugewell.llm.session import shuffle_width


def range_bounds(rows: DataFrame, parts: int | None = None, id_col: str = "doc_id") -> list[int]:
    """Ids that cut ``rows`` into at most ``parts`` ranges of about as many rows; one list of at most that length."""
    parts = parts or shuffle_width(rows.sparkSession)
    cuts = [i / parts for i in range(1, parts)]
    found = rows.agg(F.percentile_approx(id_col, cuts, max(10000, 20 * parts)).alias("cuts")).first().cuts if cuts else []
    return sorted(set(found or []))


def range_of(bounds: list[int], id_col: str = "doc_id") -> Column:
    """The number of the range that an id is in; ranges ascend with the ids."""
    edges = np.asarray(bounds, np.int64)

    @F.pandas_udf("int")
    def find(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, ids.to_numpy(np.int64), "left").astype(np.int32))

    return find(F.col(id_col))


def descending_with_next(rows: DataFrame) -> DataFrame:
    """``rows`` (``doc_id``, ``text``) dealt into id ranges and sorted within each by descending id, every range followed by its successor.

    Texts move as :func:`gaugewell.llm.packed.packed` makes them. Adds ``id_range`` and ``ahead``: a row with ``ahead`` 1
    repeats the row that comes next in descending order after the range, cyclically (after the smallest id: the
    largest). So each row with ``ahead`` 0 is followed, in its task, by its successor. Only the ranges' bounds and
    largest ids pass through the driver.
    """
    bounds = range_bounds(rows)
    heads = {r.id_range: r.head for r in rows.groupBy(range_of(bounds).alias("id_range")).agg(F.max("doc_id").alias("head")).collect()}
    order = sorted(heads)
    leads = {heads[low]: high for low, high in zip(order, order[1:] + order[:1], strict=True)}
    edges = np.asarray(bounds, np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in packed(batches):
            ids = np.asarray(batch.column("doc_id"))
            repeated = [i for i, x in enumerate(ids.tolist()) if x in leads]
            own, next_to = np.searchsorted(edges, ids, "left"), [leads[x] for x in ids[repeated].tolist()]
            for ahead, part, ranges in ((0, batch, own), (1, batch.take(pa.array(repeated, pa.int64())), next_to)):
                columns = [*part.columns, pa.array(np.full(part.num_rows, ahead, np.int32)), pa.array(np.asarray(ranges, np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names, "ahead", "id_range"])

    dealt = rows.select("doc_id", "text").mapInArrow(deal, "doc_id long, packed binary, n_bytes long, ahead int, id_range int")
    return dealt.repartitionById(shuffle_width(rows.sparkSession), "id_range").sortWithinPartitions("id_range", "ahead", F.desc("doc_id"))
