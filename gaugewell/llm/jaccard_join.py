"""Exact join of documents on the Jaccard similarity of their word shingles, by token-combination prefixes.

A document's set holds its distinct five-word shingles; ``t`` is the similarity. Two steps find all links.

The sieve orders each set by (class of the token, hash) and shuffles its first ``n - ceil(t * n) + k`` tokens,
``k = n // 5``. The first ``min(k)`` common tokens of a linked pair lie in both these prefixes, so a document that
has fewer tokens there which any other document has too is linked with nothing. Most documents go.

The join orders the tokens of the rest by their exact document frequency. Unique tokens come first and need no
index. The first common token of a linked pair is in both standard prefixes of ``n - ceil(t * n) + 1`` tokens; if
it is rare, the index on single rare tokens finds the pair. If it is frequent, no rare token is common; at most
``m = floor(n * (1 - t) / t)`` tokens of the union are not, and so its first ``2 * m + 2`` tokens hold two common
ones in a row, both frequent and neighbours in either set. Prefixes are extended to that length, and pairs of
neighbouring frequent tokens are indexed.

Equal texts are settled by hash. What the keys bring together is verified as :mod:`gaugewell.llm.linking` says, the
document with the fewest unique tokens under a key being its head, if length and position allow a link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugewell.llm import words as W
from gaugewell.llm.copies import whole_copies
from gaugewell.llm.linking import components_under_keys
from gaugewell.llm.session import cut, keyed, named, written
from gaugewell.llm.spread import HOT, join_unique

SHINGLE = 5
PERCENT = 80
SLOT_BITS = 16
SLOTS = 1 << SLOT_BITS
#: The sieve takes ``1 / SIEVE`` of a set beyond its standard prefix.
SIEVE = 5
#: Slots with more than so many times the mean are frequent; used by the sieve.
FREQUENT = 2
#: Tokens that more documents hold are frequent; used by the join.
FREQUENT_DF = 256
#: Bits of the slots in which tokens are counted to find those that very many rows have.
HOT_BITS = 13
#: Ids of sieved documents up to which they are broadcast; past that Spark joins by shuffle.
BROADCAST_IDS = 1_000_000
_CLASS_SHIFT = np.uint64(61)
HAS_WORDS = r"[^\x20\x09-\x0D]"


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(SLOTS, np.int64)
    for batch in batches:
        for block in W.blocks(batch.column(0), lower=True):
            found, _ = W.all_shingles(block, SHINGLE)
            counts += np.bincount((found >> np.uint64(64 - SLOT_BITS)).astype(np.int64), minlength=SLOTS)
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], names=["slot", "n"])


def token_classes(rows: DataFrame) -> np.ndarray:
    """Class of each slot: 0 for rare, 1 to 7 by the logarithm of its count over the frequency limit."""
    counts = np.zeros(SLOTS)
    for slot, n in rows.select("text").mapInArrow(_slots, "slot int, n long").groupBy("slot").agg(F.sum("n")).collect():
        counts[slot] = n
    over = counts / max(FREQUENT * counts.mean(), 1.0)
    return np.where(over > 1, np.minimum(1 + np.log2(np.maximum(over, 1)), 7), 0).astype(np.uint64)


def _prefixes(classes: np.ndarray):
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0))
            for block in W.blocks(batch.column(1), lower=True):
                found, owner = W.all_shingles(block, SHINGLE)
                kind = classes[(found >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]
                token = (kind << _CLASS_SHIFT) | (found >> np.uint64(3))
                order = np.lexsort((token, owner))
                token, owner = token[order], owner[order]
                keep = np.ones(len(token), bool)
                keep[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
                token, owner = token[keep], owner[keep]
                sizes = np.bincount(owner, minlength=block.last - block.first)
                rank = np.arange(len(token)) - (np.cumsum(sizes) - sizes)[owner]
                within = rank < (sizes - (PERCENT * sizes + 99) // 100 + np.maximum(sizes // SIEVE, 1))[owner]
                frequent = (token >> _CLASS_SHIFT) > 0
                # Frequent tokens count as common without a shuffle.
                hits = np.bincount(owner[within & frequent], minlength=len(sizes))
                at = np.flatnonzero(within & ~frequent)
                docs = ids[block.first : block.last]
                keys = np.concatenate([token[at], W.mix(docs.astype(np.uint64) + W.MIX_C)])
                # A row of its own tells the size of each set.
                size = np.concatenate([np.full(len(at), -1), sizes]).astype(np.int32)
                hits = np.concatenate([np.ones(len(at)), hits]).astype(np.int32)
                docs = np.concatenate([docs[owner[at]], docs])
                yield from W.pieces(pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(docs), pa.array(size), pa.array(hits)], names=["token", "doc_id", "n", "hits"]))

    return index


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by token: those that tell sizes, and those with an equal neighbour."""
    last, before = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        if last is not None:
            batch = pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
        token = np.asarray(batch.column(0))
        same = np.zeros(len(token) + 1, bool)
        same[0], same[1:-1] = before, token[1:] == token[:-1]
        keep = same[:-1] | same[1:] | (np.asarray(batch.column(2)) >= 0)
        keep[-1] = False
        last, before = batch.slice(batch.num_rows - 1), bool(same[-2])
        yield batch.filter(pa.array(keep))
    if last is not None and (before or last.column(2)[0].as_py() >= 0):
        yield last


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in W.blocks(batch.column(1), lower=True):
            sets = W.shingle_sets(block, SHINGLE)
            sizes = np.diff(sets.firsts)
            docs = np.repeat(np.asarray(batch.column(0))[block.first : block.last], sizes)
            rows = [pa.array(sets.hashes.view(np.int64)), pa.array(docs), pa.array(np.repeat(sizes, sizes).astype(np.int32))]
            yield from W.pieces(pa.RecordBatch.from_arrays(rows, names=["token", "doc_id", "n"]))


def _least_shared(n: str):
    """The smallest common number of tokens that a set of ``n`` needs for a link."""
    return F.floor((F.col(n) * PERCENT + 99) / 100)


def sieved(rows: DataFrame) -> DataFrame:
    """``doc_id``, ``n`` (set size) and ``open`` (whether it may be linked) of every row."""
    schema = "token long, doc_id long, n int, hits int"
    tokens = rows.mapInArrow(_prefixes(token_classes(rows)), schema).repartition("token").sortWithinPartitions("token")
    found = tokens.mapInArrow(_shared, schema).groupBy("doc_id").agg(F.max("n").alias("n"), F.sum("hits").alias("hits"))
    return found.select("doc_id", F.col("n").cast("long").alias("n"), (F.col("hits") >= F.greatest(F.floor(_least_shared("n") / SIEVE), F.lit(1))).alias("open"))


def hot_tokens(tokens: DataFrame) -> DataFrame:
    """``token`` and ``df`` of the tokens that more than one row in ``HOT`` of ``tokens`` has: fewer than ``HOT`` rows.

    Rows are counted by slot first, and by token only in slots that hold so many.
    """
    slotted = tokens.select("token", F.shiftrightunsigned("token", 64 - HOT_BITS).alias("slot"))
    slots = cut(slotted.groupBy("slot").agg(F.count(F.lit(1)).alias("rows")))
    total = slots.agg(F.sum("rows")).first()[0] or 0
    full = cut(slots.where(F.col("rows") * HOT > total).select("slot"))
    counts = slotted.join(F.broadcast(full), "slot", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    return cut(counts.where(F.col("df") * HOT > total))


def frequency_ordered(tokens: DataFrame) -> DataFrame:
    """Sets with enough shared tokens for a link: ``doc_id``, ``n``, ``ranked`` (df, token) ascending.

    ``tokens`` has ``token``, ``doc_id`` and ``n``, the size of its set. They move once by token and once by document:
    the rows of a token are counted where they meet. A hot token's are counted before and dealt out by document.
    """
    rows = tokens.join(F.broadcast(hot_tokens(tokens)), "token", "left").withColumn("dealt", F.when(F.col("df").isNotNull(), F.col("doc_id")))
    met = F.count(F.lit(1)).over(Window.partitionBy("token", "dealt"))
    shared = rows.withColumn("df", F.least(F.coalesce("df", met), F.lit(2**31 - 1)).cast("int")).where("df > 1")
    # Two lists, filled row by row alike, take fewer bytes in a shuffle than one list of structs.
    sets = shared.groupBy("doc_id", "n").agg(F.collect_list("df").alias("df"), F.collect_list("token").alias("token"))
    return sets.where(F.size("token") >= _least_shared("n")).select("doc_id", "n", F.array_sort(F.arrays_zip("df", "token")).alias("ranked"))


def indexed(sets: DataFrame) -> DataFrame:
    """The keys of every set: single rare tokens and pairs of neighbouring frequent ones.

    Columns ``key``, ``doc_id``, ``n``, ``alone`` (the set's unique tokens), ``at`` (place past these), ``pair``.
    """
    alone, plain = F.col("n") - F.size("ranked"), F.col("n") - _least_shared("n") + 1
    extended = F.least(F.col("n"), 2 * F.floor(F.col("n") * (100 - PERCENT) / PERCENT) + 2)
    frame = sets.select("doc_id", "n", alone.cast("int").alias("alone"), "ranked", (plain - alone).cast("int").alias("plain"), (extended - alone).cast("int").alias("extended"))
    frame = frame.withColumn("mixed", F.col("ranked")[F.col("plain") - 1]["df"] > FREQUENT_DF)
    width = F.when(F.col("mixed"), F.greatest("plain", "extended")).otherwise(F.col("plain"))
    near = frame.select("doc_id", "n", "alone", "plain", "extended", "mixed", "ranked", F.posexplode(F.slice("ranked", 1, width)).alias("at", "own"))
    near = near.withColumn("following", F.get("ranked", F.col("at") + 1)).drop("ranked")
    single = (F.col("at") < F.col("plain")) & ((F.col("own.df") <= FREQUENT_DF) | (F.col("n") == 1))
    pair = F.col("mixed") & (F.col("own.df") > FREQUENT_DF) & (F.col("at") + 1 < F.col("extended"))
    key = F.when(single, F.xxhash64("own.token")).when(pair, F.xxhash64("own.token", "following.token"))
    return near.select(key.alias("key"), "doc_id", "n", "alone", "at", (~single).alias("pair")).where("key is not null")


def _reachable(one: str, other: str):
    """Whether two sets that meet at a key can reach the similarity, by length and position.

    What precedes their first common key holds no common token if the key is single. If it is a pair, no two
    common tokens in a row precede it past the unique tokens, so at most a third of the places there are common.
    """
    column = lambda side, name: F.col(f"{side}.{name}")
    left = F.least(*[column(side, "n") - column(side, "alone") - column(side, "at") for side in (one, other)])
    before = F.when(column(one, "pair"), F.floor((column(one, "at") + column(other, "at") + 1) / 3)).otherwise(F.lit(0))
    return (left + before) * (100 + PERCENT) >= (column(one, "n") + column(other, "n")) * PERCENT


def linked_sets(tokens: DataFrame) -> DataFrame:
    """``doc_id`` and ``component_id`` of the sets of ``tokens`` (see :func:`frequency_ordered`) that have a link."""
    sets = written(frequency_ordered(tokens), "sets")
    groups = written(indexed(sets), "index")
    # The set with the fewest unique tokens is the likeliest centre of the copies under a key.
    members = groups.select("key", F.struct("alone", "doc_id", "n", "at", "pair").alias("own"))
    return components_under_keys(members, sets.select("doc_id", "n", F.col("ranked.token").alias("tokens")), PERCENT, _reachable)


def jaccard_links(rows: DataFrame, copies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sizes (``doc_id``, ``n``) of all rows and components of the linked ones that are no copies."""
    sizes = written(sieved(rows), "sizes")
    wanted = cut(sizes.where("open").select("doc_id").join(copies, "doc_id", "left_anti"))
    few = wanted.count() <= BROADCAST_IDS
    tokens = rows.join(F.broadcast(wanted) if few else wanted, "doc_id", "left_semi").mapInArrow(_tokens, "token long, doc_id long, n int")
    return sizes.select("doc_id", "n"), linked_sets(tokens)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Near-duplicate components: ``doc_id``, ``n_shingles``, ``component_id`` for every row of ``docs``.

    A-Z are lower-cased; a word is a run of characters other than space and 0x09-0x0D. A document's set holds its
    distinct shingles of :data:`SHINGLE` words, or all its words as one when it has fewer. Two documents are
    linked when ``100 * shared >= 80 * united``; ``component_id`` is the smallest id that links reach. A document
    without words, or with a null text, has an empty set and is linked with nothing. If an id is null or occurs
    twice, rows count as separate documents in the order of id (null first) and text. Other columns are ignored,
    and an empty table gives an empty result.
    """
    rows, given = keyed(docs, F.coalesce(F.col(text_col), F.lit("")).alias("text"), id_col=id_col)
    copies = cut(whole_copies(rows.where(F.col("text").rlike(HAS_WORDS))))
    sizes, parts = jaccard_links(rows, copies)
    few = parts.count() <= BROADCAST_IDS
    parts = parts.select(F.col("doc_id").alias("first"), "component_id")
    every = sizes.join(copies, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("first", "doc_id").alias("first"))
    found = join_unique(every, parts, "first", "left", few).select("doc_id", "n_shingles", F.coalesce("component_id", "first").alias("component_id"))
    return named(found, given, "doc_id", "component_id")
