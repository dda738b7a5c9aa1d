"""Words, word hashes and word windows of Arrow text columns, in numpy.

A word is a run of bytes other than space and 0x09-0x0D; texts are taken as UTF-8, whose other bytes never
equal these, so that byte runs and code-point runs agree.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 2 << 20
PAD = 8
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Odd 64-bit constants of the mixing steps.
MIX_A, MIX_B, MIX_C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_TAIL = (np.uint64(2) ** (np.arange(9, dtype=np.uint64) * np.uint64(8)) - np.uint64(1)).astype(np.uint64)
_TAIL[8] = np.uint64(0xFFFFFFFFFFFFFFFF)


class Block(NamedTuple):
    """Rows ``first`` to ``last`` of a batch: their bytes, padded, and where each text starts."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray


class Words(NamedTuple):
    """Byte starts and ends of all words of a block, and the first word of each text (one more at the end)."""

    starts: np.ndarray
    ends: np.ndarray
    firsts: np.ndarray

    def text_of(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.firsts) - 1), np.diff(self.firsts))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, null as empty, and the offsets of its values."""
    column = pc.fill_null(column, "") if column.null_count else column
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def blocks(column: pa.Array, lower: bool = False, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """``column`` in runs of whole texts of at most ``limit`` bytes, or of one text that is longer."""
    data, offsets = text_buffer(column)
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        part = data[offsets[first] : offsets[last]]
        part = np.concatenate([LOWER[part] if lower else part, np.zeros(PAD, np.uint8)])
        yield Block(first, last, part, offsets[first : last + 1] - offsets[first])
        first = last


def find_words(block: Block) -> Words:
    """The words of every text of ``block``; none crosses the end of a text."""
    size = int(block.offsets[-1])
    if not size:
        return Words(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(block.offsets), np.int64))
    blank = SPACE[block.data[:size]]
    before, after = np.empty(size, bool), np.empty(size, bool)
    before[0], before[1:] = True, blank[:-1]
    after[-1], after[:-1] = True, blank[1:]
    before[block.offsets[:-1][block.offsets[:-1] < size]] = True
    after[block.offsets[1:][block.offsets[1:] > 0] - 1] = True
    starts = np.flatnonzero(~blank & before)
    return Words(starts, np.flatnonzero(~blank & after) + 1, np.searchsorted(starts, block.offsets))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * MIX_B
    x = (x ^ (x >> np.uint64(27))) * MIX_C
    return x ^ (x >> np.uint64(31))


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span of the padded array ``data``."""
    lengths = ends - starts
    result = mix(lengths.astype(np.uint64) * MIX_A)
    if not len(starts):
        return result
    eights = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    left, at = np.arange(len(starts)), starts
    done = 0
    while len(left):
        got = eights[at + done] & _TAIL[np.minimum(lengths[left] - done, 8)]
        result[left] = mix((result[left] ^ got) * MIX_A + np.uint64(done + 1))
        done += 8
        more = lengths[left] > done
        left, at = left[more], at[more]
    return result


def window_hash(hashes: np.ndarray, at: np.ndarray, size: int, factor: np.uint64 = MIX_A) -> np.ndarray:
    """A hash of the ``size`` consecutive word hashes from each position of ``at``; one for each ``factor``."""
    result = np.zeros(len(at), np.uint64)
    for step in range(size):
        result = result * factor + hashes[at + step]
    return mix(result + np.uint64(size))


class Shingles(NamedTuple):
    """Hashes of the distinct word windows of each text, sorted within it, and the first of each text."""

    hashes: np.ndarray
    firsts: np.ndarray


def shingle_positions(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows of ``size`` words, and the text of each; texts with fewer words have none."""
    owner = words.text_of()
    at = np.flatnonzero(words.firsts[1:][owner] - np.arange(len(owner)) >= size)
    return at, owner[at]


def all_shingles(block: Block, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of every window of ``size`` words; a text with one to ``size - 1`` words has one, all of it."""
    words = find_words(block)
    hashes = span_hash(block.data, words.starts, words.ends)
    at, owner = shingle_positions(words, size)
    found = window_hash(hashes, at, size)
    counts = np.diff(words.firsts)
    for length in range(1, size):
        short = np.flatnonzero(counts == length)
        if len(short):
            found = np.concatenate([found, window_hash(hashes, words.firsts[:-1][short], length)])
            owner = np.concatenate([owner, short])
    return found, owner


def shingle_sets(block: Block, size: int) -> Shingles:
    """The distinct shingles of every text."""
    found, owner = all_shingles(block, size)
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    keep = np.ones(len(found), bool)
    keep[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    found, owner = found[keep], owner[keep]
    return Shingles(found, np.searchsorted(owner, np.arange(len(block.offsets))))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The integers of all runs ``starts[i] ... starts[i] + lengths[i] - 1``, one run after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) - np.repeat(ends - lengths - starts, lengths)


def strings(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A string column whose values are the consecutive runs of ``data``."""
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    whole = pa.Array.from_buffers(pa.large_string(), len(lengths), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])
    return whole.cast(pa.string())


def lists(values: pa.Array, firsts: np.ndarray) -> pa.Array:
    """A list column over ``values``; ``firsts`` has the offsets."""
    return pa.ListArray.from_arrays(pa.array(firsts.astype(np.int32)), values)


def list_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column; null counts as empty."""
    lengths = np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64)
    offsets = np.zeros(len(column) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    return np.asarray(column.flatten()), offsets


def pieces(batch: pa.RecordBatch, rows: int = 65536) -> Iterable[pa.RecordBatch]:
    """``batch`` in parts of at most ``rows`` rows."""
    for first in range(0, batch.num_rows, rows):
        yield batch.slice(first, rows)


def sized(batch: pa.RecordBatch, name: str, limit: int = 4 * BLOCK_BYTES) -> Iterable[pa.RecordBatch]:
    """``batch`` in parts of whole rows whose column ``name`` has at most ``limit`` bytes, or one longer row."""
    for block in blocks(batch.column(name), limit=limit):
        yield batch.slice(block.first, block.last - block.first)
