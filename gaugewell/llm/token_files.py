"""Token files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

Every id is replaced by its rank among all ids of the corpus, the most frequent first (ties: the smaller id). A
rank takes one to four bytes, little end first; a control byte holds the lengths, less one, of four ranks, two bits
each, the first lowest. A file row holds the ids of a run of documents in ascending id order:

``start`` (ids before the row in the whole corpus), ``doc_ids``, ``counts`` (ids of each), ``control``, ``data``.

Rows lie in Parquet in the shared folder, so that any executor can read them: one file per id range, in order of
their names, as the rows in each file are, so that reading file after file gives the ids of the corpus in ascending
order of documents. ``ranks`` beside them maps ranks to ids. Decoding looks lengths up by control byte and gathers the bytes in numpy. Texts move once, by id range; what
passes through the driver is the ranges' bounds and one count per vocabulary entry.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from gaugewell.llm import words as W
from gaugewell.llm.ordered import range_bounds, range_of
from gaugewell.llm.session import fresh_path, keyed, named, remove, shuffle_width
from gaugewell.llm.tokens import encoder

#: Tasks that sum the counts of ids; each adds one array per task before it.
SUMMING_TASKS = 8
#: Lengths of the four ranks of each control byte.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit ranks."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    lengths = 1 + (ranks > 0xFF).astype(np.int64) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = lengths - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1).astype(np.uint8)
    kept = np.arange(4) < lengths[:, None]
    return control.tobytes(), ranks.view(np.uint8).reshape(-1, 4)[kept].tobytes()


def decode_ranks(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The ``count`` ranks of :func:`encode_ranks`."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:count]
    ranks = np.zeros((count, 4), np.uint8)
    ranks[np.arange(4) < lengths[:, None]] = np.frombuffer(data, np.uint8)
    return ranks.view("<u4").ravel()


def _encoded(vocabulary: str, end: int):
    """Runs of documents with their ids, and last the counts of all ids of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary)
        totals = np.zeros(max(coder.size, end + 1), np.int64)
        names = ["id_range", "doc_ids", "counts", "ids", "totals"]
        no_ids, no_counts = pa.nulls(1, pa.list_(pa.int64())), pa.nulls(1, pa.list_(pa.int32()))
        for batch in batches:
            ranges = np.asarray(batch.column(0))
            edges = [0, *(np.flatnonzero(np.diff(ranges)) + 1).tolist(), len(ranges)]
            for first, last in zip(edges, edges[1:], strict=False):
                for block in W.blocks(batch.column(2).slice(first, last - first)) if last > first else ():
                    ids, counts = coder.encode(block)
                    with_end = np.full(len(ids) + len(counts), end, np.uint32)
                    with_end[W.ragged(np.cumsum(counts + 1) - counts - 1, counts)] = ids
                    totals += np.bincount(with_end, minlength=len(totals))
                    docs = batch.column(1).slice(first + block.first, block.last - block.first)
                    small = with_end.astype("<u2") if len(totals) <= 1 << 16 else with_end.astype("<u4")
                    row = [pa.array([int(ranges[first])], pa.int32()), W.lists(docs, np.array([0, len(docs)])), W.lists(pa.array((counts + 1).astype(np.int32)), np.array([0, len(counts)]))]
                    yield pa.RecordBatch.from_arrays([*row, pa.array([small.tobytes()]), no_ids], names=names)
        if totals.any():
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int32()), no_ids, no_counts, pa.nulls(1, pa.binary()), W.lists(pa.array(totals), np.array([0, len(totals)]))], names=names)

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: np.ndarray | int = 0
    for batch in batches:
        for row in range(batch.num_rows):
            total = total + np.asarray(batch.column(0)[row].values)
    if not isinstance(total, int):
        yield pa.RecordBatch.from_arrays([W.lists(pa.array(total), np.array([0, len(total)]))], names=["totals"])


def _packed(rank_of: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                raw = batch.column(3)[row].as_buffer()
                ids = np.frombuffer(raw, "<u2" if len(rank_of) <= 1 << 16 else "<u4")
                control, data = encode_ranks(rank_of[ids])
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(row, 1) for i in range(3)), pa.array([control]), pa.array([data])], names=["start", "doc_ids", "counts", "control", "data"])

    return run


def write_token_files(docs: DataFrame, path: str, vocabulary: str = "word_bpe_49k.json", end: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame | None:
    """Encode every text of ``docs``, append the id ``end`` to each, and write token files under ``path``.

    Null texts count as empty and consist of ``end`` alone. ``vocabulary`` is a public tokenizer's name or a file's
    path; special tokens' strings in a text are ordinary text. If an id is null or occurs twice, rows count as
    separate documents in the order of id (null first) and text, under numbers; the returned frame then maps
    ``doc_id`` to ``given_id``. An empty table gives files without rows.
    """
    spark = docs.sparkSession
    rows, names = keyed(docs, F.col(text_col).alias("text"), id_col=id_col)
    dealt = rows.select(range_of(range_bounds(rows)).alias("id_range"), "doc_id", "text").repartitionById(shuffle_width(spark), "id_range")
    schema = "id_range int, doc_ids array<long>, counts array<int>, ids binary, totals array<long>"
    parts = f"{path}/encoded"
    dealt.sortWithinPartitions("id_range", "doc_id").mapInArrow(_encoded(vocabulary, end), schema).write.option("compression", "zstd").parquet(parts)
    blocks = spark.read.schema(schema).parquet(parts)
    # Each task's counts are summed as arrays in a fixed number of tasks before they become rows.
    totals = blocks.where("totals is not null").select("totals").repartition(SUMMING_TASKS).mapInArrow(_summed, "totals array<long>")
    totals = totals.select(F.posexplode("totals").alias("id", "n")).groupBy("id").agg(F.sum("n").alias("n"))
    counted = sorted(((-n, i) for i, n in totals.collect()))
    order = np.array([i for _, i in counted], np.int64)
    rank_of = np.zeros(len(order), np.uint32)
    rank_of[order] = np.arange(len(order), dtype=np.uint32)
    spark.createDataFrame([(i, int(x)) for i, x in enumerate(order)], "rank int, id int").coalesce(1).write.parquet(f"{path}/ranks")
    some = blocks.where("ids is not null").withColumn("n", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).withColumn("first", F.col("doc_ids")[0])
    sums = some.groupBy("id_range").agg(F.sum("n").alias("n"))
    before = sums.select("id_range", (F.sum("n").over(Window.orderBy("id_range")) - F.col("n")).alias("before"))
    places = some.select("id_range", "first", "n").join(before, "id_range")
    inside = F.sum("n").over(Window.partitionBy("id_range").orderBy("first")) - F.col("n")
    places = places.select("first", (F.col("before") + inside).alias("start"))
    # One small row per block: its size is checked, and past it Spark joins by shuffle.
    place_of = F.broadcast(places) if places.count() <= 100_000 else places
    placed = some.join(place_of, "first").select("id_range", "start", "doc_ids", "counts", "ids")
    # Ranges ascend with the ids and files with the partitions, so one file per range keeps the order of ids.
    placed = placed.repartitionById(shuffle_width(spark), "id_range").sortWithinPartitions("start").drop("id_range")
    schema = "start long, doc_ids array<long>, counts array<int>, control binary, data binary"
    placed.mapInArrow(_packed(rank_of), schema).write.option("compression", "zstd").parquet(f"{path}/blocks")
    remove(spark, parts)
    return names


def _documents(id_of: np.ndarray, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                start, docs, counts = batch.column(0)[row].as_py(), batch.column(1)[row].values, np.asarray(batch.column(2)[row].values).astype(np.int64)
                ends = np.cumsum(counts)
                ids = id_of[decode_ranks(batch.column(3)[row].as_buffer(), batch.column(4)[row].as_buffer(), int(ends[-1]))].astype("<u4")
                raw = memoryview(ids.tobytes())
                sums = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                columns = [docs, pa.array(start + ends - counts), pa.array(counts), pa.array(sums, pa.int64())]
                if with_ids:
                    columns.append(W.lists(pa.array(ids.astype(np.int32)), np.concatenate([[0], ends])))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    return run


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Documents of token files: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` and, if wanted, ``ids``."""
    ranks = sorted(spark.read.parquet(f"{path}/ranks").collect())
    id_of = np.array([i for _, i in ranks], np.uint32)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return spark.read.parquet(f"{path}/blocks").select("start", "doc_ids", "counts", "control", "data").mapInArrow(_documents(id_of, with_ids), schema)


def token_files_round_trip(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", end: int = 2) -> DataFrame:
    """Token files of ``docs`` written to the shared folder and read back, one row per document."""
    path = fresh_path(docs.sparkSession, "tokens")
    names = write_token_files(docs, path, vocabulary, end)
    return named(read_token_files(docs.sparkSession, path), names, "doc_id")
