"""Links between documents that meet under keys: candidates, exact verification, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugewell.llm import words as W
from gaugewell.llm.components import connected
from gaugewell.llm.session import cut
from gaugewell.llm.spread import hot_keys, join_unique

#: Rows up to which the smaller side of a join is broadcast.
BROADCAST_ROWS = 1_000_000
#: Copies of the set that many documents are held against, so that no task holds it against all of them.
COPIES = 64
#: Members past which those of one key carry a bitmap; under smaller keys there are few pairs for each member.
CROWD = 64
#: Bitmaps that are broadcast at most.
BROADCAST_BITS = 20_000
#: Largest number of bits of a bitmap.
MOST_BITS = 4096


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose ``sets`` (``doc_id``, ``n``, ``tokens``) have ``percent`` of their union in common.

    A set that stands as b in more than a small share of the pairs, the centre of a large group, is dealt out in
    copies, and the pairs with it over them.
    """
    hot = hot_keys(pairs, "b").withColumn("hot", F.lit(True))
    few = F.broadcast if pairs.count() <= BROADCAST_ROWS else lambda frame: frame
    salted = pairs.join(F.broadcast(hot), "b", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("a"), F.lit(COPIES)).cast("int")).otherwise(F.lit(0))).select("a", "b", "salt")
    one = sets.select(F.col("doc_id").alias("a"), F.col("n").alias("n_a"), F.col("tokens").alias("tokens_a"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("n").alias("n_b"), F.col("tokens").alias("tokens_b"))
    two = two.join(few(pairs.select("b").distinct()), "b", "left_semi").join(F.broadcast(hot), "b", "left")
    two = two.withColumn("salt", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(COPIES - 1))).otherwise(F.array(F.lit(0))))).drop("hot")
    both = one.join(few(salted), "a").join(two, ["b", "salt"]).withColumn("shared", F.size(F.array_intersect("tokens_a", "tokens_b")))
    return both.where(F.col("shared") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("shared")) * percent).select("a", "b", "shared")


def star_links(members: DataFrame, sets: DataFrame, percent: int, reachable: Callable[[str, str], Column]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members with the head and the size of each of their keys, the pairs of members and heads, and those verified.

    ``members`` has ``key`` and ``own``, a struct with ``doc_id``; the smallest struct under a key is its head.
    ``reachable`` is a condition on two such structs, without which a pair cannot be linked. Heads reach the members of
    a common key without a shuffle by it.
    """
    heads = cut(members.groupBy("key").agg(F.min("own").alias("head"), F.count(F.lit(1)).alias("size")).where("size > 1"))
    few = heads.count() <= BROADCAST_ROWS
    met = join_unique(members, heads, "key", few=few)
    if not few:
        met = cut(met)
    stars = met.where((F.col("own.doc_id") != F.col("head.doc_id")) & reachable("own", "head"))
    stars = cut(stars.select(F.col("own.doc_id").alias("a"), F.col("head.doc_id").alias("b")).distinct())
    return met, stars, cut(verified(stars, sets, percent).select("a", "b"))


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in W.pieces(batch, 512):
            tokens, firsts = W.list_parts(part.column("tokens"))
            sizes = np.diff(firsts)
            width = np.minimum(1 << np.ceil(np.log2(np.maximum(2 * sizes, 64))).astype(np.int64), MOST_BITS)
            starts = np.cumsum(width) - width
            slots = np.repeat(starts, sizes) + (tokens & np.repeat(width - 1, sizes))
            odd = (np.bincount(slots, minlength=int(width.sum())) & 1).astype(np.uint8)
            words = np.packbits(odd, bitorder="little").view("<i8")
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), W.lists(pa.array(words), np.append(starts, width.sum()) // 64)], names=["doc_id", "bits"])


def bitmaps(sets: DataFrame) -> DataFrame:
    """``doc_id`` and ``bits`` of ``sets``: a bit for each slot of token hashes, set where the set has an odd number of tokens.

    There are two to four times as many bits as tokens, a power of two, from 64 to :data:`MOST_BITS`, in 64-bit words.
    Common tokens cancel out: bits that differ between two sets are at most as many as tokens that only one of them has.
    """
    return sets.select("doc_id", "tokens").mapInArrow(_bitmaps, "doc_id long, bits array<long>")


def least_difference(one: Column, other: Column) -> Column:
    """How many tokens at least only one of two sets has, by their :func:`bitmaps`; 0 where one is null.

    The wider bitmap is folded once to the other's width; 0 where they differ by more.
    """
    half = lambda x: F.floor(F.size(x) / 2).cast("int")
    folded = lambda x: F.zip_with(F.slice(x, 1, half(x)), F.slice(x, half(x) + 1, half(x)), lambda p, q: p.bitwiseXOR(q))
    narrow = lambda x, y: F.when(F.size(x) > F.size(y), folded(x)).otherwise(x)
    differing = F.zip_with(narrow(one, other), narrow(other, one), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    return F.coalesce(F.aggregate(differing, F.lit(0), lambda total, n: total + n), F.lit(0))


def torn_members(met: DataFrame, parts: DataFrame, sets: DataFrame) -> DataFrame:
    """All members under keys with more than one component.

    Columns ``key``, ``own``, ``part`` (its component), ``away`` (whether that is not the component of the key's head) and
    ``bits`` (see :func:`bitmaps`; null under keys with at most :data:`CROWD` members).
    """
    labels = parts.select("doc_id", "component_id")
    labelled = met.select("key", "own", "size", (F.col("own.doc_id") == F.col("head.doc_id")).alias("heads"), F.col("own.doc_id").alias("doc_id")).join(F.broadcast(labels) if labels.count() <= BROADCAST_ROWS else labels, "doc_id", "left")
    labelled = labelled.select("doc_id", "key", "own", "size", "heads", F.coalesce("component_id", "doc_id").alias("part"))
    home = F.max(F.when(F.col("heads"), F.col("part"))).alias("home")
    torn = cut(labelled.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high"), home).where("low < high").select("key", "home"))
    torn = cut(join_unique(labelled, torn, "key", few=torn.count() <= BROADCAST_ROWS).select("doc_id", "key", "own", "size", "part", (F.col("part") != F.col("home")).alias("away")))
    crowded = cut(torn.where(F.col("size") > CROWD).select("doc_id").distinct())
    n = crowded.count()
    bits = cut(bitmaps(sets.join(F.broadcast(crowded) if n <= BROADCAST_ROWS else crowded, "doc_id", "left_semi")))
    return join_unique(torn, bits, "doc_id", "left", n <= BROADCAST_BITS).select("key", "own", "part", "away", F.when(F.col("size") > CROWD, F.col("bits")).alias("bits"))


def components_under_keys(members: DataFrame, sets: DataFrame, percent: int, reachable: Callable[[str, str], Column]) -> DataFrame:
    """``doc_id`` and ``component_id`` of the documents with a verified link to another that has a key in common.

    Every member (``own`` has ``n`` and ``alone``, the tokens that no other set has) is held against the heads of its keys
    first, see :func:`star_links`; links make components. Then the pairs under one key that lie in different components are
    compared, at least one of which is away from the head's component, so that a large group and a few others cost their
    product. Only pairs whose bitmaps allow a link are verified: left out are those that are connected already or
    differ by too many tokens, and no link between components is lost.
    """
    met, stars, links = star_links(members, sets, percent, reachable)
    parts = connected(links)
    torn = cut(torn_members(met, parts, sets))
    right = torn.where("away").select("key", F.col("own").alias("other"), F.col("part").alias("apart"), F.col("bits").alias("other_bits"))
    once = ~F.col("away") | (F.col("own.doc_id") < F.col("other.doc_id"))
    differ = F.col("own.alone") + F.col("other.alone") + least_difference(F.col("bits"), F.col("other_bits"))
    near = differ * (100 + percent) <= (F.col("own.n") + F.col("other.n")) * (100 - percent)
    across = torn.join(right, "key").where((F.col("part") != F.col("apart")) & once & reachable("own", "other") & near)
    across = across.select(F.least("own.doc_id", "other.doc_id").alias("a"), F.greatest("own.doc_id", "other.doc_id").alias("b")).distinct()
    across = across.join(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    more = cut(verified(cut(across), sets, percent).select("a", "b"))
    return parts if more.isEmpty() else connected(links.unionByName(more))
