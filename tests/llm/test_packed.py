"""Texts packed for a shuffle come back as they were."""

from __future__ import annotations

import pyarrow as pa
import pytest

from gaugewell.llm.packed import opened, packed


@pytest.mark.parametrize("limit", [1, 10, 1 << 20])
def test_round_trip(limit):
    texts = ["", None, "a", "ß\u0000 \U0001f600" * 50, "x" * 300_000, "", "last"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9), pa.int64()), pa.array(["skipped", "skipped", *texts])], names=["doc_id", "text"]).slice(2)
    parts = [part for moved in packed([batch]) for part in opened(moved, limit)]
    assert [x for part in parts for x in part.column("text").to_pylist()] == [x or "" for x in texts]
    assert [i for part in parts for i in part.column("doc_id").to_pylist()] == list(range(2, 9))
    assert all(part.num_rows == 1 or sum(len(x.encode()) for x in part.column("text").to_pylist()) <= limit for part in parts)


def test_no_rows():
    empty = pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.string())], names=["doc_id", "text"])
    assert [part for moved in packed([empty]) for part in opened(moved)] == []
