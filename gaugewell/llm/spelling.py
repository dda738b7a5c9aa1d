"""Spelling variants: words one edit apart, by PartEnum signatures of their letter multisets.

A word's letters, each with the number of its earlier occurrences in the word, are a set: a binary vector over (letter,
number). One inserted, deleted or replaced code point changes it in one or two places. Its dimensions are dealt into
parts; two vectors that differ in at most k of them agree on all but k parts, so one signature per choice of the other
parts finds every such pair by an equi-join. As an edit leaves the word's first or its last half as it was, each
signature also holds that half. Pairs that share a signature are verified.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewell.llm import words as W
from gaugewell.llm.session import shuffle_width, written

#: Least code points and occurrences of a word, one in how many (document, run) pairs loses a letter, and how many times
#: as frequent a form is.
SHORTEST, LEAST, DROP, RATIO = 6, 5, 199, 5
#: Parts of the dimensions for pairs of one length, which differ in two dimensions, and for an inserted letter, in one.
PARTS = {2: 4, 1: 3}
#: Runs of more bytes than this are hashed one by one, so that the columns of the others stay short.
LONG = 64
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
#: The first byte of the code points from U+00C0 to U+00FF.
_WIDE = 0xC3


def _crc_table() -> np.ndarray:
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & 1, np.uint32(0xEDB88320) ^ (x >> np.uint32(1)), x >> np.uint32(1))
    return x


_CRC = _crc_table()


def runs_of(block: W.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of letters of a block, and the text of each."""
    data, size = block.data, int(block.offsets[-1])
    letter = _LETTER[data[:size]]
    wide = data[:size] == _WIDE
    letter |= wide
    letter[1:] |= wide[:-1]
    before, after = np.empty(size, bool), np.empty(size, bool)
    if size:
        before[0], before[1:] = True, ~letter[:-1]
        after[-1], after[:-1] = True, ~letter[1:]
        before[block.offsets[:-1][block.offsets[:-1] < size]] = True
        after[block.offsets[1:][block.offsets[1:] > 0] - 1] = True
    starts = np.flatnonzero(letter & before)
    return starts, np.flatnonzero(letter & after) + 1, np.searchsorted(block.offsets, starts, "right") - 1


def run_checksums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, owners: np.ndarray, ids: list[int | None]) -> np.ndarray:
    """CRC-32 of ``<id>:<run>`` for each run of ``data``."""
    heads = np.array([zlib.crc32(b":" if i is None else b"%d:" % i) for i in ids], np.uint32)
    found, lengths = ~heads[owners], ends - starts
    left = np.flatnonzero(lengths <= LONG)
    at, done = starts[left], 0
    while len(left):
        state = found[left]
        found[left] = _CRC[(state ^ data[at + done]) & np.uint32(255)] ^ (state >> np.uint32(8))
        done += 1
        more = lengths[left] > done
        left, at = left[more], at[more]
    found = ~found
    for i in np.flatnonzero(lengths > LONG).tolist():
        found[i] = zlib.crc32(data[starts[i] : ends[i]], int(heads[owners[i]]))
    return found


def count_block(block: W.Block, ids: list[int | None]) -> tuple[pa.Array, pa.Array]:
    """The words of a block of lower-cased texts, after deletions, and how often each occurs."""
    data = block.data
    starts, ends, owners = runs_of(block)
    bytes_before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    sizes = bytes_before[ends] - bytes_before[starts]
    some = np.flatnonzero(sizes >= SHORTEST)  # a shorter run gives no word, with or without a letter less
    starts, ends, owners, sizes = starts[some], ends[some], owners[some], sizes[some]
    sums = run_checksums(data, starts, ends, owners, ids)
    hit = sums % DROP == 0
    changed = []
    for i in np.flatnonzero(hit & (sizes > SHORTEST)).tolist():
        word = data[starts[i] : ends[i]].tobytes().decode()
        drop = int(sums[i]) % len(word)
        changed.append(word[:drop] + word[drop + 1 :])
    lengths = (ends - starts)[~hit]
    whole = W.strings(data[W.ragged(starts[~hit], lengths)], lengths)
    found = pc.value_counts(pa.concat_arrays([whole, pa.array(changed, pa.string())]))
    return found.field("values"), found.field("counts")


def word_counts(docs: DataFrame) -> DataFrame:
    """``word`` and ``n`` of every word of ``docs`` with at least :data:`LEAST` occurrences.

    A document's run of letters, A to Z lower-cased, loses one where :data:`DROP` divides the CRC-32 of ``<id>:<run>``.
    A null text has no words; a null id is written as no digits. Counts are added up per block of texts first.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for block in W.blocks(batch.column("text"), lower=True, limit=4 * W.BLOCK_BYTES):
                values, counts = count_block(block, ids[block.first : block.last])
                yield pa.RecordBatch.from_arrays([values, counts], names=["word", "n"])

    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, "word string, n long")
    found = counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)
    return written(found.repartition(shuffle_width(docs.sparkSession)), "words")


def _letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all words, the word of each, and the first of each word (one more at the end)."""
    points = np.frombuffer("".join(column.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int64)
    lengths = np.asarray(pc.utf8_length(column)).astype(np.int64)
    return points, np.repeat(np.arange(len(column)), lengths), np.concatenate([[0], np.cumsum(lengths)])


def _part_hashes(points: np.ndarray, owner: np.ndarray, firsts: np.ndarray, parts: int) -> np.ndarray:
    """Of each word and part of the dimensions a hash of the word's vector there (words x parts)."""
    order = np.lexsort((points, owner))
    points, owner = points[order], owner[order]
    fresh = np.ones(len(points), bool)
    fresh[1:] = (points[1:] != points[:-1]) | (owner[1:] != owner[:-1])
    at = np.arange(len(points))
    number = at - np.maximum.accumulate(np.where(fresh, at, 0))
    dims = W.mix((points * 4096 + number).astype(np.uint64) * W.MIX_A)
    found = np.zeros((len(firsts) - 1) * parts, np.uint64)
    np.bitwise_xor.at(found, owner * parts + (dims >> np.uint64(40)).astype(np.int64) % parts, dims)
    return found.reshape(-1, parts)


def _half_hashes(points: np.ndarray, firsts: np.ndarray, cut_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the first ``cut_at`` letters of each word, and of the others."""
    power = np.cumprod(np.full(int(np.diff(firsts).max(initial=1)) + 1, W.MIX_A))
    lengths = np.diff(firsts)
    place = np.arange(len(points)) - np.repeat(firsts[:-1], lengths)
    front = place < np.repeat(cut_at, lengths)
    number = np.where(front, place, place - np.repeat(cut_at, lengths))
    terms = W.mix(points.astype(np.uint64) * W.MIX_B + np.uint64(1)) * power[number]
    sums = lambda keep: np.add.reduceat(np.append(np.where(keep, terms, np.uint64(0)), np.uint64(0)), firsts[:-1])
    return sums(front), sums(~front)


def signatures(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of all signatures of the words of ``column``, the word of each, and its side.

    Words of one length meet under signatures for two differing dimensions, on side 0. For one dimension, a word also
    stands on side 1 as the longer of a pair, and on side 2 as the shorter one of a word with a letter more. Both words
    of a pair cut their halves at one place, that of the longer word: a letter more in its first half moves the last.
    """
    points, owner, firsts = _letters(column)
    lengths = np.diff(firsts)
    keys, sides = [], []
    hashes = {k: _part_hashes(points, owner, firsts, PARTS[k]) for k in PARTS}
    for side, (k, shorter) in enumerate(((2, 0), (1, 0), (1, 1))):
        middle = (lengths + shorter) // 2
        halves = _half_hashes(points, firsts, middle)[0], _half_hashes(points, firsts, middle - shorter)[1]
        for which, half in enumerate(halves):
            base = W.mix(half + ((lengths + shorter) * 8 + k * 2 + which).astype(np.uint64) * W.MIX_C)
            for number, chosen in enumerate(combinations(range(PARTS[k]), PARTS[k] - k)):
                key = base + np.uint64(number)
                for part in chosen:
                    key = W.mix(key * W.MIX_A + hashes[k][:, part])
                keys.append(key)
                sides.append(np.full(len(key), side, np.int8))
    return np.concatenate(keys).view(np.int64), np.tile(np.arange(len(column)), len(keys)), np.concatenate(sides)


def near_pairs(words: DataFrame) -> DataFrame:
    """Every two words of ``words`` (``word``, distinct, and ``n``) that one edit tells apart, once: ``a``, ``a_n``, ``b``, ``b_n``."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.sized(batch, "word"):
                if part.num_rows:
                    keys, rows, sides = signatures(part.column("word"))
                    rows = pa.array(rows)
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sides), part.column("word").take(rows), part.column("n").take(rows)], names=["key", "side", "word", "n"])

    signed = written(words.select("word", "n").mapInArrow(sign, "key long, side byte, word string, n long"), "signatures")
    left = signed.where("side < 2").select("key", "side", F.col("word").alias("a"), F.col("n").alias("a_n"))
    right = signed.where("side <> 1").select("key", F.col("word").alias("b"), F.col("n").alias("b_n"))
    met = left.join(right, "key").where((F.col("side") == 1) | (F.col("a") < F.col("b")))
    return met.where(F.levenshtein("a", "b", 1) == 1).select("a", "a_n", "b", "b_n").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root`` of ``forms`` (``word``, ``form``): where forms lead in the end, by doubling.

    A form is :data:`RATIO` times as frequent as its word, so that steps are few.
    """
    links = written(forms.select("word", F.col("form").alias("root")), "links")
    while True:
        up = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = written(links.join(up, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("went")), "links")
        links = moved.select("word", "root")
        if moved.where("went").isEmpty():
            return links


def spelling_groups(docs: DataFrame) -> DataFrame:
    """``word``, ``n``, ``n_near``, ``form``, ``form_n`` and ``root`` of every word of ``docs`` (``doc_id``, ``text``).

    Words are as in :func:`word_counts`. A word's form is its near word of largest n (of ties the first in code-point
    order) if that is :data:`RATIO` times as frequent; its root is where forms lead, itself where it has none. Rows that
    repeat count each; other columns are ignored; an empty table gives no words.
    """
    words = word_counts(docs)
    pairs = near_pairs(words)
    ends = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    best = pairs.select(F.inline(ends)).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), "near")).alias("best"))
    met = words.join(best, "word", "left").withColumn("own", -F.col("best.n") >= RATIO * F.col("n"))
    met = written(met.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("own"), F.col("best.near")).alias("form"), F.when(F.col("own"), -F.col("best.n")).alias("form_n")), "spelling")
    ends = roots(met.where("form IS NOT NULL"))
    return met.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
