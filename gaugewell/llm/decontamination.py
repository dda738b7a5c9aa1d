"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

Words are runs of digits, a-z (A-Z lower-cased) and characters past ASCII. A window has as many words as the
benchmark item it is held against; its 64-bit SimHash sums the signs of the hash bits of its five-word shingles,
each weighted by the number of times it occurs. Fingerprints within ``RADIUS`` bits of each other differ in at most
``RADIUS // BLOCKS`` bits of one of ``BLOCKS`` disjoint blocks. The index holds every item under all values of each
block that are so near to its own, and a window looks its own four blocks up: all items within the radius are found,
and about one item in 24 by chance. What is within the radius is verified by the weighted Jaccard similarity of the
shingle multisets.

A window that reaches the similarity ``t`` with an item holds at least ``t * (m + w) / (1 + t)`` shingles of items of
that size, where m and w are the shingles of window and item; windows are formed only where a document holds that
many so near to each other. Fingerprints slide: a run of windows costs its first window and two shingles a step, and
so does the count of common shingles, so that the work grows with the lengths of items and passages, not with their
square. Everything is Spark SQL functions; sides are broadcast only after a count.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugewell.llm.licenses import lowered, words_of
from gaugewell.llm.session import cut, keyed, named, written

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 15
BLOCKS = 4
#: Rows of the benchmark's shingles, of its index and of small results up to which they are broadcast.
BROADCAST_ROWS = 1_000_000
#: Each sum counts the bits j and j + 32, in fields of 32 bits.
_FIELDS = (1 << 32) + 1
_FIELD = (1 << 32) - 1


def shingle_hashes(words: Column, size: int) -> Column:
    """Hashes of the windows of ``size`` words of an array column; empty when it has fewer words."""
    last = F.size(words) - size
    hashes = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)]))
    return F.when(last >= 0, hashes).otherwise(F.array().cast("array<long>"))


def bit_counts(h: Column, sign: Column | None = None) -> list[Column]:
    """32 sums over the hashes ``h``, each with the counts of two bits; hashes with ``sign`` -1 are taken away."""
    fields = [F.shiftrightunsigned(h, j).bitwiseAND(F.lit(_FIELDS)) for j in range(32)]
    return [F.sum(x if sign is None else x * sign).alias(f"s{j}") for j, x in enumerate(fields)]


def fingerprint(n: Column) -> Column:
    """The SimHash of the sums ``s0`` to ``s31`` over ``n`` hashes: a bit is set where more than half have it."""
    one = F.lit(1).cast("long")
    bits = []
    for j in range(32):
        for count, bit in ((F.col(f"s{j}").bitwiseAND(F.lit(_FIELD)), j), (F.shiftrightunsigned(F.col(f"s{j}"), 32), j + 32)):
            bits.append(F.when(2 * count > n, F.shiftleft(one, bit)).otherwise(F.lit(0).cast("long")))
    return reduce(Column.bitwiseOR, bits)


def hamming_blocks(print_: Column, blocks: int = BLOCKS) -> Column:
    """The 64 bits in ``blocks`` disjoint blocks, each with its number."""
    width = 64 // blocks
    return F.array(*[F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(print_, width * i).bitwiseAND(F.lit((1 << width) - 1)).alias("bits")) for i in range(blocks)])


def near_masks(radius: int = RADIUS, blocks: int = BLOCKS) -> list[int]:
    """The patterns of at most ``radius // blocks`` changed bits of a block."""
    width = 64 // blocks
    return [sum(1 << i for i in bits) for k in range(radius // blocks + 1) for bits in combinations(range(width), k)]


def least_common(m: Column, w: Column, similarity: float) -> Column:
    """How many shingles of a window of ``m`` must be an item's of ``w`` for the similarity."""
    return F.greatest(F.ceil(similarity * (m + w) / (1 + similarity) - 1e-9).cast("int"), F.lit(1))


def benchmark_items(words: DataFrame, size: int) -> DataFrame:
    """``item`` (a hash of the words), ``own`` (its shingles of ``size`` words) and ``width`` of every row of ``words``."""
    return words.select("item", shingle_hashes(F.col("words"), size).alias("own")).withColumn("width", F.size("own"))


def candidate_runs(hits: DataFrame, widths: DataFrame, similarity: float) -> DataFrame:
    """Runs of windows with enough shingles of items of their size: ``doc_id``, ``n``, ``width``, ``low``, ``high``.

    ``hits`` has ``doc_id``, ``n`` (shingles of the document), ``at`` and ``shingle``; ``widths`` has ``shingle`` and
    ``width``. ``low`` and ``high`` are the first and last start of a run.
    """
    near = F.broadcast(widths) if widths.count() <= BROADCAST_ROWS else widths
    placed = hits.join(near, "shingle").groupBy("doc_id", "n", "width").agg(F.array_sort(F.collect_set("at")).alias("at"))
    placed = placed.withColumn("m", F.least("n", "width")).withColumn("need", least_common(F.col("m"), F.col("width"), similarity))
    # Enough places from the i-th on lie in one window; it starts between the two bounds.
    spans = F.transform(F.sequence(F.lit(0), F.size("at") - F.col("need")), lambda i: F.struct(F.greatest(F.col("at")[i + F.col("need") - 1] - F.col("m") + 1, F.lit(0)).alias("low"), F.least(F.col("at")[i], F.col("n") - F.col("m")).alias("high")))
    spans = placed.where(F.size("at") >= F.col("need")).select("doc_id", "n", "width", F.inline(F.filter(spans, lambda s: s["low"] <= s["high"])))
    order = Window.partitionBy("doc_id", "width").orderBy("low", "high")
    fresh = (F.col("low") > F.coalesce(F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-2)) + 1).cast("int")
    numbered = spans.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(order))
    return numbered.groupBy("doc_id", "n", "width", "run").agg(F.min("low").alias("low"), F.max("high").alias("high")).drop("run")


def sliding_prints(texts: DataFrame, runs: DataFrame, size: int) -> DataFrame:
    """``doc_id``, ``n``, ``width``, ``first`` and ``print`` of every window of ``runs``."""
    by_doc = runs.groupBy("doc_id").agg(F.collect_list(F.struct("n", "width", "low", "high")).alias("runs"))
    by_doc = cut(by_doc)
    near = F.broadcast(by_doc) if runs.count() <= BROADCAST_ROWS else by_doc
    # Shingles are hashed again for the few documents with windows, not carried along from the search.
    joined = texts.select("doc_id", "text").join(near, "doc_id").withColumn("words", words_of(F.col("text")))
    joined = joined.select("doc_id", "runs", shingle_hashes(F.col("words"), size).alias("hashes")).select("doc_id", "hashes", F.inline("runs"))
    one = F.lit(1).cast("long")
    whole = F.transform(F.slice("hashes", F.col("low") + 1, F.least("n", "width")), lambda h: F.struct(F.col("low").alias("first"), h.alias("h"), one.alias("sign")))
    steps = F.when(F.col("high") > F.col("low"), F.sequence(F.col("low") + 1, F.col("high"))).otherwise(F.array().cast("array<int>"))
    came = F.transform(steps, lambda s: F.struct(s.alias("first"), F.get("hashes", s + F.col("width") - 1).alias("h"), one.alias("sign")))
    left = F.transform(steps, lambda s: F.struct(s.alias("first"), F.get("hashes", s - 1).alias("h"), F.lit(-1).cast("long").alias("sign")))
    kept = ["doc_id", "n", "width", "low"]
    steps = joined.select(*kept, F.inline(F.concat(whole, came, left)))
    counted = steps.groupBy(*kept, "first").agg(*bit_counts(F.col("h"), F.col("sign")))
    order = Window.partitionBy("doc_id", "width", "low").orderBy("first").rowsBetween(Window.unboundedPreceding, 0)
    sums = counted.select(*kept, "first", *[F.sum(f"s{j}").over(order).alias(f"s{j}") for j in range(32)])
    return sums.select("doc_id", "n", "width", "first", fingerprint(F.least("n", "width")).alias("print"))


def near_items(prints: DataFrame, items: DataFrame, radius: int) -> DataFrame:
    """``width``, ``print`` and ``item`` of all different prints of windows within ``radius`` of an item of their size."""
    own = items.select("item", "width", F.explode("own").alias("h")).groupBy("item", "width").agg(F.count("h").alias("n"), *bit_counts(F.col("h")))
    own = own.select("item", "width", fingerprint(F.col("n")).alias("own_print"))
    masks = F.array(*[F.lit(x).cast("long") for x in near_masks(radius)])
    index = own.select("item", "width", "own_print", F.inline(hamming_blocks(F.col("own_print")))).withColumn("mask", F.explode(masks))
    index = cut(index.select("width", "block", F.col("bits").bitwiseXOR(F.col("mask")).alias("bits"), "item", "own_print"))
    near = F.broadcast(index) if index.count() <= BROADCAST_ROWS else index
    distinct = prints.select("width", "print").distinct()
    pairs = distinct.select("width", "print", F.inline(hamming_blocks(F.col("print")))).join(near, ["width", "block", "bits"])
    return pairs.where(F.bit_count(F.col("print").bitwiseXOR(F.col("own_print"))) <= radius).select("width", "print", "item").distinct()


def similarities(windows: DataFrame, hits: DataFrame, items: DataFrame) -> DataFrame:
    """``windows`` (``doc_id``, ``n``, ``width``, ``first``, ``item``) with the weighted Jaccard ``similarity`` of window and item.

    The k-th place of a shingle that an item holds c times is common to the windows that reach it but not the place c
    before it: so the common count is a running sum over starts of what begins and ends there.
    """
    counts = items.select("item", "width", F.explode("own").alias("shingle")).groupBy("item", "width", "shingle").agg(F.count(F.lit(1)).cast("int").alias("given"))
    wanted = windows.select("doc_id", "n", "item", "width").distinct()
    met = wanted.join(counts, ["item", "width"]).join(hits.select("doc_id", "shingle", "at"), ["doc_id", "shingle"])
    places = met.groupBy("doc_id", "n", "item", "width", "shingle", "given").agg(F.array_sort(F.collect_list("at")).alias("at"))
    # From the start after the place that many before (or one window back) up to the place itself.
    begin = lambda p, i: F.greatest(p - F.col("width"), F.coalesce(F.get("at", i - F.col("given")), F.lit(-1)), F.lit(-1)) + 1
    events = F.flatten(F.transform("at", lambda p, i: F.array(F.struct(begin(p, i).alias("first"), F.lit(1).alias("change")), F.struct((p + 1).alias("first"), F.lit(-1).alias("change")))))
    keys = ["doc_id", "n", "item", "width"]
    events = places.select(*keys, F.inline(events)).withColumn("asked", F.lit(False))
    asked = windows.select(*keys, "first", F.lit(0).alias("change"), F.lit(True).alias("asked"))
    steps = events.unionByName(asked).groupBy(*keys, "first").agg(F.sum("change").alias("change"), F.max("asked").alias("asked"))
    both = F.sum("change").over(Window.partitionBy(*keys).orderBy("first").rowsBetween(Window.unboundedPreceding, 0))
    found = steps.withColumn("both", both).where("asked")
    return found.withColumn("similarity", F.col("both") / (F.least("n", "width") + F.col("width") - F.col("both"))).drop("change", "asked", "both")


def _found(texts: DataFrame, words: DataFrame, size: int, similarity: float, radius: int) -> DataFrame:
    """Best windows of the items whose shingles have ``size`` words."""
    items = cut(benchmark_items(words, size))
    known = cut(items.select(F.explode("own").alias("shingle")).distinct())
    few = known.count() <= BROADCAST_ROWS
    shingled = texts.withColumn("words", words_of(F.col("text"))).select("doc_id", shingle_hashes(F.col("words"), size).alias("hashes"))
    places = shingled.select("doc_id", F.size("hashes").alias("n"), F.posexplode_outer("hashes").alias("at", "shingle"))
    hits = written(places.join(F.broadcast(known) if few else known, "shingle", "left_semi"), "hits")
    widths = cut(items.select(F.explode("own").alias("shingle"), "width").distinct())
    runs = cut(candidate_runs(hits, widths, similarity))
    prints = written(sliding_prints(texts, runs, size), "prints")
    near = cut(near_items(prints, items, radius))
    windows = prints.join(F.broadcast(near) if near.count() <= BROADCAST_ROWS else near, ["width", "print"]).drop("print")
    scored = similarities(cut(windows), hits, items).where(F.col("similarity") >= similarity)
    # Of several windows with one similarity the first.
    best = scored.groupBy("doc_id", "item", "width").agg(F.max(F.struct("similarity", (-F.col("first")).alias("back"))).alias("best"))
    return best.select("doc_id", "item", "best.similarity", (-F.col("best.back")).cast("long").alias("first_word"), (F.col("width") + size - 1).cast("long").alias("n_words"))


def contaminated(
    docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """Passages of ``benchmark`` in ``docs``: the best window of every document and item that reach the similarity.

    Columns ``doc_id``, ``item_id``, ``similarity``, ``first_word`` and ``n_words`` (the window; of several with
    one similarity the first). Items of fewer than five words are held against windows of as many words, as one
    shingle; a document with fewer words than an item is one window; items and documents without words, or null,
    match nothing. An item may match many documents and a document many items. Items are told apart by their words:
    rows of the benchmark with one id and different texts are tried each, and the best counts; rows with one text and
    different ids (null is one) all match. If a document id is null or occurs twice, rows count as separate
    documents. Items and documents may have any length.
    """
    rows, names = keyed(docs, F.col(text_col).alias("text"), id_col=id_col)
    texts = rows.select("doc_id", lowered(F.col("text")).alias("text"))
    items = benchmark.select(F.col(item_col).alias("item_id"), words_of(lowered(F.col(item_text_col))).alias("words")).where(F.size("words") > 0)
    items = cut(items.withColumn("item", F.sha2(F.array_join("words", " "), 256)))
    size = F.least(F.size("words"), F.lit(SHINGLE))
    words, ids = items.select("item", "words", size.alias("size")).dropDuplicates(["item"]), items.select("item", "item_id").distinct()
    found = None
    for row in sorted(items.select(size.alias("size")).distinct().collect()) or [(SHINGLE,)]:
        part = _found(texts, words.where(F.col("size") == row[0]), row[0], similarity, radius)
        found = part if found is None else found.unionByName(part)
    found = found.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, "item").withColumn("back", -F.col("first_word"))
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", "back", "n_words")).alias("best"))
    best = best.select("doc_id", "item_id", "best.similarity", (-F.col("best.back")).alias("first_word"), "best.n_words")
    return named(best, names, "doc_id")
