"""The Merkle manifest against plain hashing."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugewell.llm import merkle as M

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, place int"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def fields(row, more: int = 0) -> str:
    values = (row[0], row[1], row[2], None if row[3] is None else row[3] + more, row[4])
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain(rows) -> list[tuple]:
    """What the query returns, by hashlib, one leaf at a time."""

    def climb(nodes, place, digest, proof):
        while len(nodes) > 1:
            run = list(nodes[place - place % 2 : place - place % 2 + 2])
            proof += [x for i, x in enumerate(run) if i != place % 2]
            run[place % 2] = digest
            digest, place = sha("".join(run)), place // 2
            nodes = [sha("".join(nodes[i : i + 2])) for i in range(0, len(nodes), 2)]
        return nodes[0], digest

    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    leaves = {g: sorted(((r[0] is not None, r[0] or 0, fields(r), r) for r in groups[g]), key=lambda x: x[:3]) for g in order}
    tops = [climb([x[2] for x in leaves[g]], 0, "", [])[0] for g in order]
    found = []
    for at, g in enumerate(order):
        nodes = [x[2] for x in leaves[g]]
        for place, (_, _, leaf, row) in enumerate(leaves[g]):
            hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            proof = []
            sub, digest = climb(nodes, place, fields(row, 1) if hit else leaf, proof)
            root, digest = climb(tops, at, digest, proof)
            found.append((row[0], leaf, sub, root, sha("".join(proof)), digest, digest == root))
    return sorted(found, key=repr)


def result(frame) -> list[tuple]:
    found = M.document_manifest(frame).withColumn("proof", F.sha2("proof", 256))
    return sorted((tuple(r) for r in found.select("doc_id", "leaf", "subroot", "root", "proof", "folded_root", "verified").collect()), key=repr)


def test_rounds_and_states():
    nodes = np.random.default_rng(1).integers(0, 1 << 32, (11, 8), np.uint32)
    texts = [M._raw(x).hex() for x in nodes]
    for fanout in (2, 3, 5):
        tree = M.grow(nodes, fanout, None)
        level = texts
        for made in tree.levels[1:]:
            level = [sha("".join(level[i : i + fanout])) for i in range(0, len(level), fanout)]
            assert [M._raw(x).hex() for x in made] == level
        path = M.path_of(tree, np.arange(11), fanout)
        assert (M.fold(nodes, path) == tree.levels[-1]).all()
        changed = nodes.copy()
        changed[7] ^= 1
        assert (M.fold(changed[7:8], M.Path(*[x[7:8] for x in path])) == M.grow(changed, fanout, None).levels[-1]).all()


@pytest.mark.parametrize("block", [4, 1024])
def test_against_plain_hashing(spark, monkeypatch, block):
    monkeypatch.setattr(M, "BLOCK", block)
    rows = [(i, f"s{i % 3}", None if i % 11 == 3 else "ende"[i % 2 * 2 :][:2] if i % 5 else "fr", None if i % 13 == 0 else i * 3, None if i % 17 == 0 else "é" * (i % 4)) for i in range(70)]
    rows += [(None, None, None, None, None), (None, None, None, None, None), (None, "a", "en", 1, "x"), (7, "s", "solo", 9, "one"), (7, "s1", "en", 21, "é" * 3), (5, "", "", 0, "")]
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    assert result(frame) == plain(rows)


def test_one_row_none_and_long(spark):
    frame = lambda rows: spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    assert result(frame([])) == []
    one = [(3, None, "en", (1 << 63) - 1, "long " * 200_000)]
    assert result(frame(one)) == plain(one)
    same = [(12, "a", "b", 1, "same")] * 40
    assert result(frame(same)) == plain(same)


def test_broadcasts_off(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 4)
    monkeypatch.setattr(M, "BROADCAST_OFFSETS", 0)
    rows = [(i, "s", f"l{i % 7}", i, "t") for i in range(60)]
    assert result(spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)) == plain(rows)
