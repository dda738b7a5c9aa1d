"""Substring removal, the Jaccard join and fingerprints against brute force, with awkward rows."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gaugewell.llm import components, copies, fingerprints, jaccard_join, linking, spread, substring_dedup
from gaugewell.llm import words as W

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, token string, key long, n int, spots string"


def prose(seed: int, n: int, vocabulary: int = 5000) -> list[str]:
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}é" for _ in range(n)]


def corpus() -> list[tuple[int, str | None]]:
    base, passage = prose(1, 120), prose(2, 60)
    near = base.copy()
    near[60] = "changed"
    half = base[:60] + prose(3, 60)
    rows = [(3, " ".join(base)), (1, " ".join(base)), (7, " ".join(near)), (8, "\n".join(half)), (9, " ".join(prose(4, 30) + passage)), (2, " ".join(passage + prose(5, 40)))]
    rows += [(10, " ".join(prose(6, 25) * 3)), (11, ""), (12, " \t\n "), (13, None), (14, "one two"), (15, "one two"), (16, "ONE two"), (17, "x " * 19), (18, "x " * 20), (19, "x " * 30), (20, " ".join(prose(7, 3000)))]
    for i in range(30):
        edited = prose(8, 80)
        edited[i % 80] = f"edit{i}"
        edited[(i * 7) % 80] = f"more{i}"
        rows.append((100 + i, " ".join(edited)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 1, 2, "x") for i, t in rows], SCHEMA)


def expected_removal(rows):
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for s in range(len(words) - 19):
            window = tuple(words[s : s + 20])
            if window in seen:
                gone[s : s + 20] = [True] * 20
            seen.add(window)
        out[i] = (len(words), sum(gone), " ".join(w for w, g in zip(words, gone, strict=True) if not g))
    return out


def expected_components(rows):
    sets = {}
    for i, text in rows:
        w = WORD.findall((text or "").translate(LOW))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}


def test_removal_equals_brute_force(spark):
    found = substring_dedup.remove_repeats(frame(spark, corpus())).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in found} == expected_removal(corpus())
    for r in found:
        assert sum(b - a for a, b in zip(r.removed_from, r.removed_to, strict=True)) == r.n_removed


@pytest.mark.parametrize("limit", [1, 300])
def test_removal_does_not_depend_on_blocks(spark, monkeypatch, limit):
    expected = expected_removal(corpus())
    data = pa.array([t for _, t in corpus()], pa.string())
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in corpus()]), data], names=["doc_id", "text"])
    monkeypatch.setattr(W.blocks, "__defaults__", (False, limit))
    rows = [r for b in substring_dedup._anchors(iter([batch])) for r in b.to_pylist()]
    assert rows and len({r["key"] for r in rows if not r["run"]}) >= 1
    assert len(expected) == len(corpus())


def test_components_equal_brute_force(spark):
    found = jaccard_join.jaccard_components(frame(spark, corpus())).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == expected_components(corpus())


def test_components_with_frequent_tokens(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "FREQUENT_DF", 3)
    monkeypatch.setattr(jaccard_join, "FREQUENT", 0.0001)
    found = jaccard_join.jaccard_components(frame(spark, corpus())).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == expected_components(corpus())


def test_one_equal_hash_is_no_repeat(spark, monkeypatch):
    plain = W.window_hash

    def clashing(hashes, at, size, factor=W.MIX_A):
        found = plain(hashes, at, size, factor)
        return np.zeros_like(found) if size == substring_dedup.WINDOW and factor == W.MIX_A else found

    monkeypatch.setattr(W, "window_hash", clashing)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([" ".join(prose(30, 20)), " ".join(prose(31, 20))]), pa.array([[0], [0]])], names=["doc_id", "text", "spots"])
    rows = [pa.Table.from_batches([b]).sort_by([("key", "ascending"), ("check", "ascending")]).to_batches()[0] for b in substring_dedup._windows(iter([batch]))]
    assert sum(r.num_rows for r in rows) == 2 and sum(b.num_rows for b in substring_dedup._later(iter(rows))) == 0


def test_repeated_and_null_ids(spark):
    rows = [(None, "a " * 25), (5, "a " * 25), (5, "a " * 25), (5, None)]
    kept = substring_dedup.remove_repeats(frame(spark, rows)).collect()
    assert sorted((r.doc_id is None, r.n_words) for r in kept) == sorted([(True, 25), (False, 25), (False, 25), (False, 0)])
    # Equal windows start earlier in the row with the null id, save its own first.
    assert {r.n_removed for r in kept if r.doc_id == 5 and r.n_words} == {25}
    parts = jaccard_join.jaccard_components(frame(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in parts) == [(0, 0), (5, 0), (5, 0), (5, 5)]


def test_empty_tables(spark):
    empty = frame(spark, [])
    assert substring_dedup.remove_repeats(empty).count() == 0
    assert jaccard_join.jaccard_components(empty).count() == 0
    assert fingerprints.fingerprints(empty).count() == 0
    assert fingerprints.fingerprints_under_edits(empty).count() == 0


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(20, 40)] + [(1, 2)], "a long, b long")
    found = {r.doc_id: r.component_id for r in components.connected(links).collect()}
    assert found == {**{i: 20 for i in range(20, 41)}, 1: 1, 2: 1}


def test_words_match_the_pattern():
    texts = ["a  b\tc", "", " x", "é ü \x0bz", None, "end ", " wide \x1c y"]
    for block in W.blocks(pa.array(texts, pa.string())):
        words = W.find_words(block)
        raw = block.data.tobytes()
        got = [raw[s:e].decode() for s, e in zip(words.starts, words.ends, strict=True)]
        assert got == [w for t in texts for w in WORD.findall(t or "")]
        assert np.diff(words.firsts).tolist() == [len(WORD.findall(t or "")) for t in texts]


def test_edits_and_fingerprints(spark):
    rows = corpus()
    found = {r.doc_id: r for r in fingerprints.fingerprints_under_edits(frame(spark, rows)).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    for k, (i, text) in enumerate(order):
        text, following = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        assert found[i].edited_text == text[: len(text) - half] + following[:half]
        assert found[i].n_chars == len(text)
    assert found[1].fingerprint == found[3].fingerprint
    assert found[11].fingerprint == found[13].fingerprint and found[11].near_edited == 1.0
    assert found[20].near_edited < 0.7


def test_one_document_follows_itself(spark):
    row = fingerprints.fingerprints_under_edits(frame(spark, [(1, "abcdef")])).first()
    assert row.edited_text == "abcabc" and row.near_next == 1.0


def test_likeness_estimates_jaccard():
    a, b = prose(10, 400), prose(10, 400)
    b[200:260] = prose(11, 60)
    one, full = fingerprints.signatures(pa.array([" ".join(a), " ".join(b)]))
    x, y = ({tuple(t[i : i + 5]) for i in range(396)} for t in (a, b))
    estimate = fingerprints.likeness(one[:1], one[1:], full[:1], full[1:])[0]
    assert abs(estimate - len(x & y) / len(x | y)) < 0.15


def test_signatures_equal_brute_force():
    texts = [t for _, t in corpus()]
    found, full = fingerprints.signatures(pa.array(texts, pa.string()))
    mask, factors, shifts = (1 << 64) - 1, fingerprints.FACTORS.tolist(), fingerprints.SHIFTS.tolist()

    def scrambled(x: int) -> int:
        return int(W.mix(np.array([x], np.uint64))[0])

    for row, text in enumerate(texts[:20]):
        hashes = [int(h) for block in W.blocks(pa.array([text], pa.string())) for h in W.all_shingles(block, fingerprints.SHINGLE)[0]]
        assert full[row] == bool(hashes)
        expected = [scrambled(min((a * h + b) & mask for h in hashes)) & 0xFFFF if hashes else 0xFFFF for a, b in zip(factors, shifts, strict=True)]
        assert found[row].tolist() == expected


def half_alike() -> list[tuple[int, str | None]]:
    """A group whose smallest ids are just under the similarity to the others, which are links of each other."""
    base = prose(20, 100)
    rows = []
    for i in range(12):
        text = base.copy()
        text[10 : 10 + 7] = prose(21 + i, 7)
        rows.append((i, " ".join(text)))
    for i in range(12, 24):
        text = base.copy()
        text[60 : 60 + 12] = prose(40 + i % 2, 12)
        text[30] = f"own{i}"
        rows.append((i, " ".join(text)))
    return rows


@pytest.mark.parametrize("rows", [corpus(), half_alike()])
def test_classes_by_bands_reach_the_exact_ones(spark, rows):
    exact = expected_components([(i, t) for i, t in rows])
    cased = {i: t for i, t in rows if (t or "").translate(LOW) == (t or "")}
    found = {r.doc_id: r.component_id for r in fingerprints.near_duplicates(frame(spark, rows)).collect()}
    pairs = lambda parts: {(i, j) for i in cased for j in cased if i < j and parts[i] == parts[j] and WORD.findall(cased[i] or "")}
    wanted, got = pairs({i: c for i, (_, c) in exact.items()}), pairs(found)
    assert got <= wanted and len(got) >= 0.9 * len(wanted) and len(found) == len(rows)


def test_joins_past_the_broadcast(spark, monkeypatch):
    for module, name in ((components, "BROADCAST_LABELS"), (linking, "BROADCAST_ROWS"), (fingerprints, "BROADCAST_IDS"), (jaccard_join, "BROADCAST_IDS"), (copies, "BROADCAST_TEXTS")):
        monkeypatch.setattr(module, name, 0)
    monkeypatch.setattr(spread, "HOT", 20)
    monkeypatch.setattr(jaccard_join, "HOT", 20)
    rows = corpus() + [(1000 + i, t) for i, t in half_alike()]
    found = jaccard_join.jaccard_components(frame(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == expected_components(rows)
    assert fingerprints.near_duplicates(frame(spark, rows)).count() == len(rows)


def test_classes_and_edits_of_awkward_rows(spark):
    rows = [(None, "a " * 25), (5, "a " * 25), (5, "b c d e f g"), (5, None), (7, "x" * 3_000_000), (8, "é" * 5)]
    found = fingerprints.documents_with_classes(frame(spark, rows)).collect()
    assert len(found) == 6 and {r.component_id for r in found if r.n_chars == 50} == {None}
    assert {r.n_chars for r in found} == {50, 11, 0, 3_000_000, 5}


def test_digest_of_kept_text(spark):
    kept = substring_dedup.remove_repeats(frame(spark, [(1, "a b")])).select(F.sha2("kept_text", 256).alias("h")).first().h
    assert kept == hashlib.sha256(b"a b").hexdigest()


def alike(n: int, places: int, words: int, seed: int) -> list[tuple[int, str]]:
    """Variants of one text, most of them alike but less than near duplicates."""
    r, base = random.Random(seed), prose(seed, words)
    step = words // places
    return [(i, " ".join(f"v{j // step}" if j % step == 3 and (mask >> (j // step)) & 1 and j // step < places else w for j, w in enumerate(base))) for i, mask in enumerate(r.randrange(1 << places) for _ in range(n))]


def test_no_link_in_a_group_that_is_merely_alike_is_lost(spark):
    rows = alike(400, 12, 84, 21)
    sets = {i: {tuple(t.split(" ")[j : j + 5]) for j in range(80)} for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in range(a + 1, len(rows)):
            shared = len(sets[a] & sets[b])
            if 100 * shared >= 80 * (len(sets[a]) + len(sets[b]) - shared):
                one, other = sorted((root(a), root(b)))
                parent[other] = one
    found = {r.doc_id: r.component_id for r in fingerprints.near_duplicates(frame(spark, rows)).collect()}
    assert found == {i: root(i) for i in sets}


def test_few_pairs_of_a_group_that_is_merely_alike_are_verified(spark, monkeypatch):
    plain, held = linking.verified, []

    def counted(pairs, sets, percent):
        held.append(pairs.count())
        return plain(pairs, sets, percent)

    monkeypatch.setattr(linking, "verified", counted)
    rows = alike(400, 12, 84, 21)
    assert fingerprints.near_duplicates(frame(spark, rows)).count() == len(rows)
    assert len(held) == 2 and held[1] < 5 * len(rows)


def test_bitmaps_never_exceed_the_difference(spark):
    r, rows = random.Random(3), []
    for i in range(60):
        common = [r.getrandbits(63) for _ in range(r.choice([0, 20, 120, 3000]))]
        one, other = ([*common, *(r.getrandbits(63) - (1 << 62) for _ in range(r.choice([0, 1, 9, 70])))] for _ in range(2))
        rows.append((i, one, other))
    plain = spark.createDataFrame(rows, "doc_id long, one array<long>, other array<long>")
    one, other = (linking.bitmaps(plain.select("doc_id", F.col(c).alias("tokens"))).withColumnRenamed("bits", c) for c in ("one", "other"))
    found = one.join(other, "doc_id").select("doc_id", linking.least_difference(F.col("one"), F.col("other")).alias("n"), linking.least_difference(F.col("one"), F.lit(None).cast("array<long>")).alias("none")).collect()
    truth = {i: len(set(a) ^ set(b)) for i, a, b in rows}
    assert len(found) == len(rows) and all(x.none == 0 and x.n <= truth[x.doc_id] for x in found)
    near = [x for x in found if 0 < truth[x.doc_id] <= 18]
    assert near and sum(x.n for x in near) > 0.8 * sum(truth[x.doc_id] for x in near)


def test_sets_move_twice_and_narrow(spark):
    r = random.Random(5)
    rows = [(t, d, 300) for d in range(200) for t in [*range(40), *(r.randrange(40, 12000) << 45 for _ in range(260))]]
    rows = [(t, d, 300) for d, t in sorted({(d, t) for t, d, _ in rows})]
    tokens = spark.createDataFrame(pa.table({"token": [x[0] for x in rows], "doc_id": [x[1] for x in rows], "n": pa.array([x[2] for x in rows], pa.int32())}))
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    stages = lambda: list(gateway.jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)))
    before = max((s.stageId() for s in stages()), default=-1)
    # As with tables that are too large for a broadcast.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = {x.doc_id: [(y.df, y.token) for y in x.ranked] for x in jaccard_join.frequency_ordered(tokens).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved = sum(s.shuffleWriteBytes() for s in stages() if s.stageId() > before)
    df = {}
    for t, _, _ in rows:
        df[t] = df.get(t, 0) + 1
    own = {}
    for t, d, _ in rows:
        if df[t] > 1:
            own.setdefault(d, []).append((df[t], t))
    assert found == {d: sorted(x) for d, x in own.items() if len(x) >= 240}
    assert moved < 17.5 * len(rows), moved / len(rows)
