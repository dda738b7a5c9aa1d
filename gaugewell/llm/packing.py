"""Packing by powers of two: documents cut into pieces of binary lengths, equal lengths side by side.

A document of n tokens gives n // 2048 pieces of 2048 tokens and one piece for each bit of the rest, larger ones
first. Each piece is a sequence of its own, so no sequence crosses documents and none is padded. Sequences are
numbered by length, then by document and place: those of one length are a bucket of consecutive numbers, whose
batches need no padding either.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugewell.llm import words as W
from gaugewell.llm.ordered import range_bounds, range_of
from gaugewell.llm.session import keyed, named, written
from gaugewell.llm.tokens import encoder

LONGEST = 2048


def piece_lengths(tokens: int, longest: int = LONGEST) -> list[int]:
    """Lengths of the pieces of a document: as many of ``longest`` as fit, then the rest's powers of two."""
    whole, rest = divmod(tokens, longest)
    return [longest] * whole + [1 << bit for bit in range(longest.bit_length() - 2, -1, -1) if rest >> bit & 1]


def _pieces(vocabulary: str, end: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary)
        mark = np.array([end], "<u4")
        for batch in batches:
            for block in W.blocks(batch.column(1)):
                ids, counts = coder.encode(block)
                at, found, kept = np.cumsum(counts) - counts, [], []
                docs = batch.column(0).slice(block.first, block.last - block.first).to_pylist()
                for doc, first, count in zip(docs, at.tolist(), counts.tolist(), strict=True):
                    own = np.concatenate([ids[first : first + count], mark]).astype("<u4")
                    raw, start = memoryview(own.tobytes()), 0
                    for length in piece_lengths(count + 1):
                        found.append((doc, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]), count + 1))
                        start += length
                    kept.append(own)
                columns = [pa.array(column, pa.int64()) for column in zip(*found, strict=True)]
                if with_ids:
                    ends = np.cumsum([0, *(row[2] for row in found)])
                    columns.append(W.lists(pa.array(np.concatenate(kept).astype(np.int32)), ends))
                whole = pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: len(columns)])
                yield from W.pieces(whole)

    return run


def packed_pieces(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", end: int = 1, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents: ``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``.

    ``bucket`` is the binary logarithm of the length, ``bucket_place`` numbers the sequences of a bucket from 0. Every document ends with the id ``end``; a null text counts as empty and is that id alone. ``with_ids`` adds
    the ids of each piece. ``sequence_id`` numbers sequences from 0 without gaps, longest first; ``offset`` is 0
    throughout. If an id is null or occurs twice, rows count as separate documents in the order of id (null first)
    and text. Texts are not shuffled; pieces are written once, and numbered from the counts of each id range.
    """
    rows, names = keyed(docs, F.col(text_col).alias("text"), id_col=id_col)
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    pieces = rows.mapInArrow(_pieces(vocabulary, end, with_ids), schema)
    pieces = written(pieces.withColumn("id_range", range_of(range_bounds(rows))), "pieces")
    counts = pieces.groupBy("length", "id_range").agg(F.count(F.lit(1)).alias("n"))
    order = Window.orderBy(F.desc("length"), "id_range")
    own = Window.partitionBy("length").orderBy("id_range")
    before = counts.select("length", "id_range", (F.sum("n").over(order) - F.col("n")).alias("before"), (F.sum("n").over(own) - F.col("n")).alias("own_before"))
    inside = F.row_number().over(Window.partitionBy("length", "id_range").orderBy("doc_id", "start")) - 1
    numbered = pieces.withColumn("inside", inside).join(before, ["length", "id_range"])
    kept = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("inside")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")]
    kept += [F.log2("length").cast("int").alias("bucket"), (F.col("own_before") + F.col("inside")).alias("bucket_place")]
    return named(numbered.select(*kept, *["ids"] * with_ids), names, "doc_id")
