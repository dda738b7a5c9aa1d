"""Exact removal of word windows that occur earlier in the corpus, by difference-cover anchors.

A window is ``WINDOW`` consecutive words of one text. It is a repeat when the same words start earlier: in a
document with a smaller id, or in the same document further left. Each word that a repeat covers goes.

Anchors are the windows of ``ANCHOR`` words at word positions that are, modulo ``PERIOD``, in ``COVER``. Every
residue is a difference of two members of ``COVER``; so any two places i and j have a shift below ``PERIOD``
that takes both to cover positions, and equal windows of ``PERIOD - 1 + ANCHOR`` words share an aligned anchor.
Only the windows around anchors that occur more than once are then extended and compared, by two independent hashes
of their words of 96 bits together: among 10**12 windows two different ones agree with a probability of 10**-5.

A text that stands whole in an earlier document is settled by its hash and takes no part in the search.

Plan: texts -> anchors (Arrow) -> shuffle by anchor, neighbours compared in sorted order -> repeated anchors
back to their texts -> windows around them -> shuffle by window, all but the earliest marked -> texts cut.
Within a block of texts equal anchors and windows are settled at once, and only one of them travels; a key that
a third of all rows hold sends one row per block, not one per row, and no task holds a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewell.llm import words as W
from gaugewell.llm.copies import whole_copies
from gaugewell.llm.session import keyed, named

WINDOW = 20
PERIOD = 13
COVER = (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1
#: A run of windows that reaches the end of any text.
WHOLE = 1 << 30

_PLACE = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("place", pa.int32()), ("run", pa.int32())])
_PLACE_DDL = "key long, doc_id long, place int, run int"
_WINDOW = pa.schema([("key", pa.int64()), ("check", pa.int32()), *list(_PLACE)[1:]])
_WINDOW_DDL = "key long, check int, doc_id long, place int, run int"


def _places(keys: np.ndarray, docs: np.ndarray, place: np.ndarray, run: np.ndarray) -> pa.RecordBatch:
    """Rows of the shuffle; ``run`` is 0 where the shuffle has to tell whether the key is a repeat."""
    return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(docs), pa.array(place.astype(np.int32)), pa.array(run.astype(np.int32))], schema=_PLACE)


def _checked(keys: np.ndarray, check: np.ndarray, docs: np.ndarray, place: np.ndarray, run: np.ndarray) -> pa.RecordBatch:
    """Rows of the windows' shuffle, with the second hash."""
    return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(check.view(np.int32)), pa.array(docs), pa.array(place.astype(np.int32)), pa.array(run.astype(np.int32))], schema=_WINDOW)


def _apart(docs: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Keys that spread settled rows evenly."""
    return W.mix(docs.astype(np.uint64) * W.MIX_A + place.astype(np.uint64))


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cover = np.zeros(PERIOD, bool)
    cover[list(COVER)] = True
    for batch in batches:
        ids = np.asarray(batch.column(0))
        for block in W.blocks(batch.column(1)):
            words = W.find_words(block)
            owner = words.text_of()
            place = np.arange(len(owner)) - words.firsts[:-1][owner]
            left = words.firsts[1:][owner] - np.arange(len(owner))
            at = np.flatnonzero(cover[place % PERIOD] & (left >= ANCHOR) & (left + place >= WINDOW))
            if not len(at):
                continue
            found = W.window_hash(W.span_hash(block.data, words.starts, words.ends), at, ANCHOR)
            order = np.argsort(found, kind="stable")
            found, at = found[order], at[order]
            equal = np.zeros(len(at) + 1, bool)
            equal[1:-1] = found[1:] == found[:-1]
            docs, spot = ids[block.first : block.last][owner[at]], place[at]
            keys = np.where(equal[:-1], _apart(docs, spot), found)
            yield from W.pieces(_places(keys, docs, spot, (equal[:-1] | equal[1:]).astype(np.int32)))


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by key: those settled before, and those that have an equal neighbour."""
    last: list[np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [np.asarray(column) for column in batch.columns]
        before = False
        if last is not None:
            rows = [np.concatenate(pair) for pair in zip(last[:4], rows, strict=True)]
            before = bool(last[4][0])
        same = np.zeros(len(rows[0]) + 1, bool)
        same[0], same[1:-1] = before, rows[0][1:] == rows[0][:-1]
        keep = (rows[3] > 0) | same[:-1] | same[1:]
        keep[-1] = False
        last = [column[-1:] for column in rows] + [same[-2:-1]]
        yield pa.RecordBatch.from_arrays([pa.array(rows[1][keep]), pa.array(rows[2][keep])], names=["doc_id", "place"])
    if last is not None and (last[3][0] > 0 or last[4][0]):
        yield pa.RecordBatch.from_arrays([pa.array(last[1]), pa.array(last[2])], names=["doc_id", "place"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = np.asarray(batch.column(0))
        spots, firsts = W.list_parts(batch.column(2))
        for block in W.blocks(batch.column(1)):
            words = W.find_words(block)
            rows = slice(block.first, block.last)
            counts = np.diff(words.firsts)
            spot = spots[firsts[block.first] : firsts[block.last]].astype(np.int64)
            owner = np.repeat(np.arange(block.last - block.first), np.diff(firsts[block.first : block.last + 1]))
            low, high = np.maximum(spot - PERIOD + 1, 0), np.minimum(spot, counts[owner] - WINDOW)
            edge = np.zeros(len(words.starts) + 1, np.int64)
            np.add.at(edge, words.firsts[:-1][owner] + low, 1)
            np.add.at(edge, words.firsts[:-1][owner] + high + 1, -1)
            at = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
            if not len(at):
                continue
            hashes = W.span_hash(block.data, words.starts, words.ends)
            found, check = W.window_hash(hashes, at, WINDOW), (W.window_hash(hashes, at, WINDOW, W.MIX_C) >> np.uint64(32)).astype(np.uint32)
            owner = words.text_of()[at]
            docs, start = ids[rows][owner], at - words.firsts[:-1][owner]
            order = np.lexsort((start, docs, check, found))
            later = np.zeros(len(order), bool)
            later[1:] = (found[order][1:] == found[order][:-1]) & (check[order][1:] == check[order][:-1])
            first = order[~later]
            yield from W.pieces(_checked(found[first], check[first], docs[first], start[first], np.zeros(len(first))))
            known = np.sort(order[later])
            if len(known):
                docs, start = docs[known], start[known]
                begins = np.flatnonzero(np.concatenate([[True], (docs[1:] != docs[:-1]) | (start[1:] != start[:-1] + 1)]))
                runs = np.diff(np.concatenate([begins, [len(known)]]))
                yield from W.pieces(_checked(_apart(docs[begins], start[begins]), np.zeros(len(begins), np.uint32), docs[begins], start[begins], runs))


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by both hashes, document and place: runs settled before, and windows after the first of a key."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, check, docs, place, run = (np.asarray(column) for column in batch.columns)
        again = np.zeros(len(keys), bool)
        again[1:] = (keys[1:] == keys[:-1]) & (check[1:] == check[:-1])
        again[0] = last == (keys[0], check[0])
        last = (keys[-1], check[-1])
        keep = again | (run > 0)
        yield pa.RecordBatch.from_arrays([pa.array(docs[keep]), pa.array(place[keep]), pa.array(np.maximum(run[keep], 1))], names=["doc_id", "place", "run"])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spots, firsts = W.list_parts(batch.column(2))
        runs, _ = W.list_parts(batch.column(3))
        for block in W.blocks(batch.column(1)):
            words = W.find_words(block)
            owner = np.repeat(np.arange(block.last - block.first), np.diff(firsts[block.first : block.last + 1]))
            spot = spots[firsts[block.first] : firsts[block.last]].astype(np.int64) + words.firsts[:-1][owner]
            run = runs[firsts[block.first] : firsts[block.last]].astype(np.int64)
            long = np.diff(words.firsts)[owner] >= WINDOW
            edge = np.zeros(len(words.starts) + 1, np.int64)
            np.add.at(edge, spot[long], 1)
            np.add.at(edge, np.minimum(spot + run + WINDOW - 1, words.firsts[1:][owner])[long], -1)
            gone = np.cumsum(edge[:-1]) > 0
            owner = words.text_of()
            stay = np.flatnonzero(~gone)
            kept = np.bincount(owner[stay], minlength=block.last - block.first)
            lengths = (words.ends - words.starts)[stay]
            # Every kept word with the byte after it, which becomes a space; the last of a text goes without.
            last = np.zeros(len(stay), bool)
            last[np.cumsum(kept)[kept > 0] - 1] = True
            spaced = lengths + ~last
            text = block.data[np.minimum(W.ragged(words.starts[stay], spaced), len(block.data) - 1)].copy()
            text[(np.cumsum(spaced) - 1)[~last]] = 32
            sizes = np.bincount(owner[stay], spaced, block.last - block.first).astype(np.int64)
            spans = _spans(gone, words, owner)
            counts = np.diff(words.firsts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(block.first, block.last - block.first), pa.array(counts), pa.array(counts - kept), W.strings(text, sizes), *spans],
                names=["doc_id", "n_words", "n_removed", "kept_text", "removed_from", "removed_to"],
            )


def _spans(gone: np.ndarray, words: W.Words, owner: np.ndarray) -> list[pa.Array]:
    """First and past-the-end word numbers of the removed runs of each text, as two list columns."""
    if not len(gone):
        empty = W.lists(pa.array(np.zeros(0, np.int32)), np.zeros(len(words.firsts), np.int64))
        return [empty, empty]
    cut = gone.copy()
    cut[1:] &= ~gone[:-1] | (owner[1:] != owner[:-1])
    begins = np.flatnonzero(cut)
    stop = gone.copy()
    stop[:-1] &= ~gone[1:] | (owner[1:] != owner[:-1])
    ends = np.flatnonzero(stop) + 1
    base = words.firsts[:-1][owner[begins]]
    firsts = np.searchsorted(owner[begins], np.arange(len(words.firsts)))
    return [W.lists(pa.array((x - base).astype(np.int32)), firsts) for x in (begins, ends)]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut every repeated window of :data:`WINDOW` words out of the texts of ``docs``.

    One row per row of ``docs``: ``doc_id``, ``n_words``, ``n_removed``, ``kept_text`` (the kept words joined by
    one space) and ``removed_from``/``removed_to`` (word numbers of each removed run, the end exclusive). A null
    text counts as one without words and gives an empty ``kept_text``; texts of fewer than :data:`WINDOW` words
    lose nothing. Windows are judged on the input, not on what is left. If an id is null or occurs more than
    once, rows count as separate documents in the order of id (null first) and text, so of equal rows all but
    one lose their windows. Other columns are ignored, and an empty table gives an empty result.
    """
    rows, names = keyed(docs, F.col(text_col).alias("text"), id_col=id_col)
    copies = whole_copies(rows).select("doc_id")
    places = rows.join(copies, "doc_id", "left_anti").mapInArrow(_anchors, _PLACE_DDL).repartition("key").sortWithinPartitions("key")
    anchors = places.mapInArrow(_repeated, "doc_id long, place int").groupBy("doc_id").agg(F.collect_list("place").alias("spots"))
    windows = rows.join(anchors, "doc_id").mapInArrow(_windows, _WINDOW_DDL)
    windows = windows.repartition("key").sortWithinPartitions("key", "check", "doc_id", "place")
    later = windows.mapInArrow(_later, "doc_id long, place int, run int")
    whole = copies.select("doc_id", F.lit(0).alias("place"), F.lit(WHOLE).alias("run"))
    later = later.unionByName(whole).groupBy("doc_id").agg(F.collect_list(F.struct("place", "run")).alias("later"))
    joined = rows.join(later, "doc_id", "left").select("doc_id", "text", F.col("later.place").alias("spots"), F.col("later.run").alias("runs"))
    schema = "doc_id long, n_words long, n_removed long, kept_text string, removed_from array<int>, removed_to array<int>"
    return named(joined.mapInArrow(_kept, schema), names, "doc_id")
