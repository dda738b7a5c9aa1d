"""Texts that move between tasks as zstd blobs, a third smaller than what Spark's own shuffle compression leaves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from gaugewell.llm import words as W

LEVEL = 1


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of ``doc_id`` and ``text`` with each text as ``packed`` and its length in bytes as ``n_bytes``; null is empty."""
    codec = pa.Codec("zstd", compression_level=LEVEL)
    for batch in batches:
        for part in W.sized(batch, "text"):
            data, offsets = W.text_buffer(part.column("text"))
            blobs = [codec.compress(data[a:b], asbytes=True) if b > a else b"" for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(blobs, pa.binary()), pa.array(np.diff(offsets))], names=["doc_id", "packed", "n_bytes"])


def opened(batch: pa.RecordBatch, limit: int = 4 * W.BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` with ``text`` in place of ``packed`` and ``n_bytes``, in parts of at most ``limit`` bytes of text, or of one longer row."""
    codec = pa.Codec("zstd", compression_level=LEVEL)
    blobs, sizes = batch.column("packed"), batch.column("n_bytes").to_pylist()
    others = [name for name in batch.schema.names if name not in ("packed", "n_bytes")]
    first = 0
    while first < batch.num_rows:
        last, total = first + 1, sizes[first]
        while last < batch.num_rows and total + sizes[last] <= limit:
            total += sizes[last]
            last += 1
        texts = [codec.decompress(blobs[i].as_buffer(), sizes[i], asbytes=True) if sizes[i] else b"" for i in range(first, last)]
        columns = [batch.column(name).slice(first, last - first) for name in others]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.binary()).cast(pa.string())], names=[*others, "text"])
        first = last
