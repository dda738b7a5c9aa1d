"""Personal data against the plain patterns, against planted spans, and the models against what made the votes."""

from __future__ import annotations

import hashlib
import random
import re
import time

import numpy as np
import pytest

from gaugewell.llm import pii
from gaugewell.llm.catalog import CATALOG

SF_DIR = "/root/testdata/sf0.01"


def plain(text: str) -> list[tuple[str, int, int]]:
    """Base spans by the contract's patterns as they stand."""

    def digits(s):
        return re.sub("[^0-9]", "", s)

    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
    found += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))]
    return found + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m.group())) <= 15]


def test_base_spans_of_random_texts():
    r = random.Random(2)
    for alphabet in ("a@.b-+_ é", "0123.. ", "19 -0", "+12() .-3", "a1@.+- 4(é"):
        for _ in range(3000):
            text = "".join(r.choice(alphabet) for _ in range(r.randint(0, 60)))
            assert [(pii.KINDS[k], s, e) for k, s, e in pii.base_spans(text)] == plain(text), text
    assert [(pii.KINDS[k], s, e) for k, s, e in pii.base_spans("4111 1111-1111 1111 and 000000255.1.1.1")] == [("ip", 24, 39), ("card", 0, 19)]


@pytest.mark.parametrize("part", ["a", "a@", "1", "1.", "1 ", "+1", "+1(", "A b ", "a (at) ", "12-", "AA11 ", "0:", "Ab "])
def test_long_texts_are_linear(part):
    began = time.monotonic()
    pii.document_spans(part * (500_000 // len(part)))
    assert time.monotonic() - began < 15


def test_query_against_plain_patterns(spark):
    found = {r.doc_id: r for r in CATALOG.queries["op12_personal_data"](spark, SF_DIR).collect()}
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    assert len(found) == len(docs)
    for doc in docs:
        base, row = plain(doc.text or ""), found[doc.doc_id]
        listed = [f"{k}:{s}:{e}" for k, s, e in base]
        assert row.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest() and set(listed) <= set(filter(None, row.spans.split(",")))
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(x[0] == k for x in base) for k in pii.BASE]


def test_planted_spans_are_found_and_others_left(spark):
    r = random.Random(4)
    number = lambda n: "".join(str(r.randint(0, 9)) for _ in range(n))
    local = lambda: f"({number(3)}) {number(3)}-{number(4)}"
    good, bad = [], []
    for _ in range(150):
        good += [f"please call {local()} soon", f"tel {number(3)}-{number(3)}-{number(4)}", f"mail jo{number(2)} [at] corp{number(1)} [dot] com now", f"signed Dr. Mary Stone{'abc'[r.randint(0, 2)]}"]
        bad += [f"order {number(2)}-{number(3)}-{number(2)}-{number(3)} shipped", f"version {number(2)}.{number(3)}.{number(3)}", f"isbn {number(4)}-{number(4)}-{number(3)}", "Blue Ridge Trail is long", f"hash/{number(15)}x"]
    texts = good + bad
    frame = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)] + [(None, None, "x", 0), (3, "", "x", 0), (3, good[3], "x", 0)], "doc_id long, text string, kind string, start int")
    found = pii.personal_data(frame, "doc_id", "kind", "start").collect()
    assert len(found) == len(texts) + 3
    by_id = {x.doc_id: x for x in found if x.kind == "clash"}
    hit = lambda ids: sum(any(not s.base for s in by_id[i].spans) for i in ids)
    assert hit(range(len(good))) >= 0.95 * len(good)
    assert hit(range(len(good), len(texts))) == 0
    assert sorted(len(x.spans) for x in found if x.kind == "x") == [0, 0, 1]
    with pytest.raises(ValueError, match="spans"):
        pii.personal_data(frame.withColumnRenamed("kind", "spans"), "spans")


def test_clean_documents_get_nothing(spark):
    texts = ["The North Sea Wind was strong in 1998 and 2001.", "Chapter 12 12 1999 begins.", "Plain words only. Then More Words come."] * 30
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert all(not r.spans for r in pii.personal_data(frame, "doc_id").collect())
    assert pii.personal_data(frame.limit(0), "doc_id").collect() == []


def test_em_finds_reliabilities():
    r = np.random.default_rng(6)
    truth = r.random(40_000) < 0.3
    right = np.array([0.95, 0.8, 0.7, 0.9, 0.6, 0.75])
    says = np.where(truth[:, None], 1, -1) * np.where(r.random((len(truth), 6)) < right, 1, -1)
    says[r.random(says.shape) < 0.3] = 0
    kinds, back, counts = np.unique(says, axis=0, return_inverse=True, return_counts=True)
    posterior, table = pii.weigh(kinds, counts.astype(float))
    assert np.abs(table[1, :, 2] / (1 - table[1, :, 1]) - right).max() < 0.05
    # The best that anyone could do who knew all rates.
    best = (np.log(right / (1 - right)) * kinds).sum(1) + np.log(0.3 / 0.7) > 0
    most = (best[back.ravel()] == truth).mean()
    assert most > 0.9 and ((posterior[back.ravel()] > 0.5) == truth).mean() > most - 0.005
    values = np.column_stack([kinds, np.zeros((len(kinds), len(pii.SHAPES)), int)])
    w = pii.train(pii.inputs_of(values), posterior, counts.astype(float))
    p = 1 / (1 + np.exp(-pii.inputs_of(values) @ w))
    assert ((p[back.ravel()] > 0.5) == truth).mean() > most - 0.005
