"""Spelling variants against brute force."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from gaugewell.llm import spelling as S
from gaugewell.llm.catalog import CATALOG
from tests.oracle import connect, same

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows) -> list[tuple]:
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            word = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run
            counts[word] += len(word) >= 6
    words = {w: n for w, n in counts.items() if n >= 5}
    found = {}
    for w, n in words.items():
        near = sorted((-m, v) for v, m in words.items() if one_edit(v, w))
        form = near[0][1] if near and -near[0][0] >= 5 * n else None
        found[w] = (form, n, len(near), -near[0][0] if form else None)

    def root(w):
        return root(found[w][0]) if found[w][0] else w

    return sorted((w, f, root(w), n, k, m) for w, (f, n, k, m) in found.items())


def result(spark, rows):
    frame = spark.createDataFrame([(i, t, 1, "clash", 2) for i, t in rows], "doc_id long, text string, n int, word string, key int")
    return sorted(tuple(r) for r in S.spelling_groups(frame).select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_against_brute_force(spark):
    r = random.Random(5)
    base = ["receive", "réceive", "abcdefgh", "aabbccdd", "banana", "ÀÉÎõüçé"] + ["".join(r.choice("abé") for _ in range(r.randint(6, 9))) for _ in range(60)]
    rows = []
    for i in range(400):
        words = []
        for _ in range(40):
            w = list(r.choice(base[: r.choice((3, 6, 66))]))
            for _ in range(r.choice((0, 0, 0, 1, 1, 2))):
                at = r.randrange(len(w))
                w[at : at + r.randint(0, 1)] = r.choice(("", "a", "é", "ab"))
            words.append("".join(w) if r.random() < 0.9 else "".join(w).upper())
        rows.append((i, r.choice((" ", ", ", "1", "÷ ", "Ā")).join(words)))
    rows += [(7, rows[7][1]), (None, "receive " * 9), (9, None), (10, ""), (11, "x" * 5000 + " " + "receiv " * 6)]
    found = result(spark, rows)
    assert found == plain(rows) and sum(x[1] is not None for x in found) > 50 and any(x[1] != x[2] and x[1] for x in found)


def test_every_near_pair_shares_a_signature():
    r = random.Random(9)
    words = sorted({"".join(r.choice("abcdé") for _ in range(r.randint(6, 8))) for _ in range(1500)} | {"a" * n for n in range(6, 40)})
    keys, rows, sides = S.signatures(pa.array(words))
    held = {}
    for k, w, s in zip(keys.tolist(), rows.tolist(), sides.tolist(), strict=True):
        held.setdefault((k, s), set()).add(w)
    met = set()
    for (k, s), some in held.items():
        if s < 2:
            met |= {tuple(sorted((a, b))) for a in some for b in held.get((k, 0 if s == 0 else 2), ()) if a != b}
    near = {(i, j) for i in range(len(words)) for j in range(i) if abs(len(words[i]) - len(words[j])) < 2 and one_edit(words[i], words[j])}
    assert {tuple(sorted(p)) for p in near} <= met and len(near) > 300


def test_long_runs_and_few_rows(spark):
    assert result(spark, []) == [] and result(spark, [(1, None), (None, None), (2, "short words")]) == []
    long = "é" * 50_000 + "abc"
    rows = [(i, f"{long} {long[1:]}") for i in range(6)]
    assert result(spark, rows) == plain(rows)


def test_checksums():
    from gaugewell.llm import words as W

    texts = ["abcdefg " + "z" * 70 + " ok", "Ünder", ""]
    block = next(W.blocks(pa.array(texts), lower=True))
    starts, ends, owners = S.runs_of(block)
    runs = [block.data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
    assert [x.decode() for x in runs] == ["abcdefg", "z" * 70, "ok", "Ünder"]
    assert S.run_checksums(block.data, starts, ends, owners, [3, -4, None]).tolist() == [zlib.crc32(f"{(3, -4)[o]}:".encode() + x) for x, o in zip(runs, owners, strict=True)]


@pytest.mark.parametrize("size", ["sf0.01"])
def test_twin(spark, size):
    same(CATALOG.queries["op11_spelling_variants"](spark, f"/root/testdata/{size}"), connect(f"/root/testdata/{size}").sql(CATALOG.oracles["op11_spelling_variants"]))
