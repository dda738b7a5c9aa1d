"""Document fingerprints: MinHash signatures of five-word shingles, bands joined in Spark, Jaccard verified.

A signature has ``PERMUTATIONS`` components; component i is the smallest value of the universal hash
``a_i * x + b_i`` (modulo 2**64) over a document's shingle hashes, cut to 16 bits. Two signatures agree in a
component with a probability equal to the Jaccard similarity of the shingle sets (2**-16 more for the cut).

A band is a run of ``BAND_ROWS`` components. Documents with an equal band are candidates; at a similarity of 0.8 two
share one of the 21 bands with a probability of 0.998. In a group of documents that are alike, but less than that,
nearly all pairs would be candidates. So the documents that share a band with any other go through the exact join of
:mod:`gaugewell.llm.jaccard_join` on their whole shingle sets, which loses no link among them and does not form those pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewell.llm import words as W
from gaugewell.llm.copies import whole_copies
from gaugewell.llm.jaccard_join import PERCENT, linked_sets
from gaugewell.llm.ordered import descending_with_next
from gaugewell.llm.packed import opened
from gaugewell.llm.session import cut, keyed, named
from gaugewell.llm.spread import join_unique

SHINGLE = 5
PERMUTATIONS = 128
BAND_ROWS = 6
#: Ids of copies up to which they are broadcast; past that Spark joins by shuffle.
BROADCAST_IDS = 1_000_000
_STEP = np.arange(1, PERMUTATIONS + 1, dtype=np.uint64)
FACTORS = W.mix(_STEP * W.MIX_A) | np.uint64(1)
SHIFTS = W.mix(_STEP * W.MIX_B)


def signatures(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The signature of each text (rows of 16-bit components) and whether it has any word; null is empty."""
    parts, some = [np.zeros((0, PERMUTATIONS), np.uint16)], [np.zeros(0, bool)]
    for block in W.blocks(column):
        found, owner = W.all_shingles(block, SHINGLE)
        if len(owner) and (owner[1:] < owner[:-1]).any():
            order = np.argsort(owner, kind="stable")
            found, owner = found[order], owner[order]
        rows = block.last - block.first
        full = np.bincount(owner, minlength=rows) > 0
        signature = np.full((rows, PERMUTATIONS), 0xFFFF, np.uint16)
        if len(found):
            firsts = np.searchsorted(owner, np.flatnonzero(full))
            least = np.empty((len(firsts), PERMUTATIONS), np.uint64)
            value = np.empty_like(found)
            for i in range(PERMUTATIONS):
                np.multiply(found, FACTORS[i], out=value)
                np.add(value, SHIFTS[i], out=value)
                least[:, i] = np.minimum.reduceat(value, firsts)
            signature[full] = (W.mix(least) & np.uint64(0xFFFF)).astype(np.uint16)
        parts.append(signature)
        some.append(full)
    return np.concatenate(parts), np.concatenate(some)


def likeness(one: np.ndarray, other: np.ndarray, one_full: np.ndarray, other_full: np.ndarray) -> np.ndarray:
    """Share of equal components; 1 between two texts without words, 0 between one without and one with words."""
    share = (one == other).mean(axis=1) if len(one) else np.zeros(0)
    return np.where(one_full & other_full, share, (one_full == other_full).astype(float))


def _hex(signature: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes().hex() for row in signature.astype(">u2")], pa.string())


def band_keys(signature: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature: of its number and its components."""
    bands = signature[:, : PERMUTATIONS // BAND_ROWS * BAND_ROWS].reshape(len(signature), PERMUTATIONS // BAND_ROWS, BAND_ROWS).astype(np.uint64)
    keys = np.broadcast_to(np.arange(bands.shape[1], dtype=np.uint64) * W.MIX_B, bands.shape[:2])
    for i in range(BAND_ROWS):
        keys = W.mix(keys * W.MIX_A + bands[:, :, i])
    return keys.view(np.int64)


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        signature, full = signatures(batch.column(1))
        bands = band_keys(signature)
        bands = W.lists(pa.array(bands.ravel()), np.arange(len(bands) + 1) * bands.shape[1])
        yield pa.RecordBatch.from_arrays([batch.column(0), _hex(signature), pa.array(full), bands], names=["doc_id", "fingerprint", "has_words", "bands"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of every row: ``doc_id``, ``fingerprint`` (hexadecimal), ``has_words``, ``bands``.

    ``bands`` has the key of each run of :data:`BAND_ROWS` components. A null or blank text
    gets the fingerprint of the empty text (all ``f``) and ``has_words`` false. Equal texts have equal
    fingerprints. Ids may be null or repeat, other columns are ignored, an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_fingerprint, "doc_id long, fingerprint string, has_words boolean, bands array<long>")


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_chars", "edited_text", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    held: pa.RecordBatch | None = None
    for batch in batches:
        for part in opened(batch.select(["doc_id", "packed", "n_bytes", "ahead"])):
            part = part.select(["doc_id", "text", "ahead"])
            if held is not None:
                part = pa.Table.from_batches([held, part]).combine_chunks().to_batches()[0]
            held = part.slice(part.num_rows - 1)
            if part.num_rows < 2:
                continue
            texts = [x or "" for x in part.column(1).to_pylist()]
            plain, plain_full = signatures(part.column(1))
            own = np.flatnonzero(np.asarray(part.column(2))[:-1] == 0)
            edited = [texts[i][: len(texts[i]) - len(texts[i]) // 2] + texts[i + 1][: len(texts[i]) // 2] for i in own]
            changed, changed_full = signatures(pa.array(edited, pa.string()))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(pa.array(own)),
                    pa.array([len(texts[i]) for i in own], pa.int64()),
                    pa.array(edited, pa.string()),
                    _hex(plain[own]),
                    _hex(changed),
                    pa.array(likeness(plain[own], changed, plain_full[own], changed_full)),
                    pa.array(likeness(plain[own], plain[own + 1], plain_full[own], plain_full[own + 1])),
                ],
                names=names,
            )


def fingerprints_under_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """How fingerprints follow an edit: every text against itself with its second half taken from the next one.

    The next document is the one with the next smaller id, and for the smallest id the one with the largest. The
    last ``n_chars // 2`` code points give way to as many of the first of the next document, or to all it has.
    One row per row: ``doc_id``, ``n_chars``, ``edited_text``, ``fingerprint``, ``edited_fingerprint``,
    ``near_edited``, ``near_next`` (see :func:`likeness`). Null texts count as empty. If an id is null or occurs
    twice, rows count as separate documents in the order of id (null first) and text. Texts move once, compressed, by id range.
    """
    rows, given = keyed(docs, F.coalesce(F.col(text_col), F.lit("")).alias("text"), id_col=id_col)
    return named(_edited(rows), given, "doc_id")


def _edited(rows: DataFrame) -> DataFrame:
    schema = "doc_id long, n_chars long, edited_text string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return descending_with_next(rows).mapInArrow(_edits, schema)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in W.sized(batch, "text"):
            signature, full = signatures(part.column(1))
            docs = part.column(0).filter(pa.array(full))
            keys = band_keys(signature[full])
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(np.asarray(docs), keys.shape[1]))], names=["key", "doc_id"])


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in W.blocks(batch.column(1)):
            sets = W.shingle_sets(block, SHINGLE)
            sizes = np.diff(sets.firsts)
            docs = np.repeat(np.asarray(batch.column(0))[block.first : block.last], sizes)
            rows = [pa.array(sets.hashes.view(np.int64)), pa.array(docs), pa.array(np.repeat(sizes, sizes).astype(np.int32))]
            yield from W.pieces(pa.RecordBatch.from_arrays(rows, names=["token", "doc_id", "n"]))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Classes of near duplicates found by equal bands: ``doc_id`` and ``component_id`` of every row of ``docs``.

    Two documents are linked when each shares a band with some other text and their shingle sets have :data:`PERCENT`
    of their union in common; ``component_id`` is the smallest id that links reach. Copies of one text have one class. Documents
    without words are linked with nothing but their copies. Ids that are null or repeat are as in
    :func:`fingerprints_under_edits`.
    """
    rows, names = keyed(docs, F.coalesce(F.col(text_col), F.lit("")).alias("text"), id_col=id_col)
    return named(_classed(rows.select("doc_id"), rows), names, "doc_id", "component_id")


def documents_with_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`fingerprints_under_edits`, with the edited text's SHA-256 in its place, and :func:`near_duplicates` in one."""
    rows, names = keyed(docs, F.coalesce(F.col(text_col), F.lit("")).alias("text"), id_col=id_col)
    edited = _edited(rows).withColumn("edited_sha256", F.sha2("edited_text", 256)).drop("edited_text")
    return named(_classed(edited, rows), names, "doc_id", "component_id")


def _classed(every: DataFrame, rows: DataFrame) -> DataFrame:
    """``every`` (``doc_id`` and more) with the ``component_id`` of each document among ``rows``."""
    copies = cut(whole_copies(rows))
    few = copies.count() <= BROADCAST_IDS
    once = rows.join(F.broadcast(copies.select("doc_id")) if few else copies.select("doc_id"), "doc_id", "left_anti")
    bands = once.mapInArrow(_bands, "key long, doc_id long")
    shared = cut(bands.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("key"))
    wanted = cut(join_unique(bands, shared, "key", "left_semi", shared.count() <= BROADCAST_IDS).select("doc_id").distinct())
    near = wanted.count() <= BROADCAST_IDS
    tokens = once.join(F.broadcast(wanted) if near else wanted, "doc_id", "left_semi").mapInArrow(_tokens, "token long, doc_id long, n int")
    parts = linked_sets(tokens).select(F.col("doc_id").alias("first"), "component_id")
    firsts = every.join(F.broadcast(copies) if few else copies, "doc_id", "left").withColumn("first", F.coalesce("first", "doc_id"))
    found = join_unique(firsts, parts, "first", "left", parts.count() <= BROADCAST_IDS)
    return found.select(*every.columns, F.coalesce("component_id", "first").alias("component_id"))
