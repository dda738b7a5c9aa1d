"""Knowledge-tracing views as tables: response-limited and cold-start sequences, and the scalars attached to items.

Rows are interactions (learner, item, event_id, correct, split and the columns of ``order``, which must end in a unique
one). Sequences are cut to ``max_len`` rows by a rank filter, which Spark applies before the shuffle too, so that a task
meets at most ``max_len`` rows of a learner from each map task, however long the history is. Rows of items that the
table of items does not hold are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugewell.functions.hashing import hash_number, hash_rank, hashed
from gaugewell.operators.rates import beta_smoothed

MAX_LEN = 80
#: Item index of an item that training must not know; 0 is left for padding.
UNKNOWN = 1
#: Most train rows that an item keeps; "warm" keeps all.
EXPOSURES = (0, 1, 3, 5, 10, 20, "warm")
DROPOUT = 0.1
SEED = 2024
TIME = ("ts", "event_id")
VIEW = ("split", "learner", "position", "event_id", "item", "item_index", "correct")


def exposure_ranks(rows: DataFrame, largest: int, seed: int = SEED) -> DataFrame:
    """Train rows of each item by a hash of learner, event and seed, up to ``largest``: learner, item, event_id, correct, exposure_rank."""
    order = Window.partitionBy("item").orderBy("_h", "event_id")
    train = rows.where("split = 'train'").withColumn("_h", hashed("learner", "event_id", seed))
    kept = train.withColumn("exposure_rank", F.row_number().over(order)).where(F.col("exposure_rank") <= largest)
    return kept.select("learner", "item", "event_id", "correct", "exposure_rank")


def per_item(table: DataFrame) -> DataFrame:
    """``table``, a row or more per item, for joins by shuffle: it grows with the input, and what Spark takes from compressed files for a small table may be too large to broadcast."""
    return table.hint("merge")


def caps(exposures: tuple) -> list[int]:
    """The numeric exposures."""
    return [e for e in exposures if e != "warm"]


def _truncated(rows: DataFrame, order: tuple[str, ...], max_len: int, *by: str) -> DataFrame:
    """The first ``max_len`` rows of each group by ``order``, with their 0-based ``position``."""
    placed = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return placed.where(F.col("_r") <= max_len).withColumn("position", F.col("_r") - 1).drop("_r")


def response_limited_view(rows: DataFrame, items: DataFrame, exposures: tuple = EXPOSURES, order: tuple[str, ...] = TIME, max_len: int = MAX_LEN, seed: int = SEED) -> DataFrame:
    """Sequences under every exposure: exposure, split, learner, position, event_id, item, item_index, correct.

    Under a numeric exposure a learner keeps all train rows of each pair (learner, item) that has one of the item's first so
    many rows by hash. Held-out rows are the same under each and stand once, with exposure ``any``. ``item_index`` is from 1
    in hash order of all ``items`` (item).
    """
    index = hash_rank(items.select("item").distinct(), hashed("item"), "item").select("item", (F.col("rank") + 1).alias("item_index"))
    known = rows.join(per_item(index), "item")
    train = known.where("split = 'train'")
    parts = [_truncated(known.where("split <> 'train'").withColumn("exposure", F.lit("any")), order, max_len, "exposure", "split", "learner")]
    numbers = caps(exposures)
    if numbers and max(numbers) > 0:
        pairs = exposure_ranks(rows, max(numbers), seed).groupBy("learner", "item").agg(F.min("exposure_rank").alias("exposure_rank"))
        under = F.explode(F.filter(F.array(*[F.lit(c) for c in numbers]), lambda c: c >= F.col("exposure_rank")).cast("array<string>"))
        masked = train.join(pairs, ["learner", "item"]).withColumn("exposure", under)
        parts.append(_truncated(masked, order, max_len, "exposure", "split", "learner"))
    if "warm" in exposures:
        parts.append(_truncated(train.withColumn("exposure", F.lit("warm")), order, max_len, "exposure", "split", "learner"))
    whole = parts[0].select("exposure", *VIEW)
    for part in parts[1:]:
        whole = whole.unionByName(part.select("exposure", *VIEW))
    return whole


def fold_index(folds: DataFrame, n_folds: int) -> DataFrame:
    """``folds`` (item, fold; one row an item) as item, ``own`` fold and ``indices``, the item's index in each other fold.

    Indices are from 2 in hash order of the items that a fold may train on; the fold's own items have none.
    """
    others = folds.select("item", "fold", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))).alias("other")).where("other <> fold")
    ranked = hash_rank(others, hashed("item"), "item", cell=("other",))
    by_fold = ranked.groupBy("item").agg(F.map_from_entries(F.collect_list(F.struct("other", F.col("rank") + 2))).alias("indices"))
    return folds.select("item", F.col("fold").alias("own")).join(per_item(by_fold), "item", "left")


def dropped(index: Column, share: float, seed: int) -> Column:
    """``index`` or, for a share of learners' positions that hangs on their hash alone, the unknown index."""
    draw = hash_number(hashed("learner", "position", index, seed, F.lit("dropout")), 12) % 10000 / 10000.0
    return F.when(draw < share, F.lit(UNKNOWN).cast("long")).otherwise(index)


def cold_start_view(rows: DataFrame, folds: DataFrame, n_folds: int, order: tuple[str, ...] = TIME, max_len: int = MAX_LEN, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """Sequences of every item fold: fold, the columns of the limited view, eval_first and eval_all.

    Train and val rows of a fold's own items are removed before sequences are cut, and some indices of the rest become the
    unknown one. Test learners keep their whole cut sequence, own items under the unknown index; ``eval_all`` marks
    these and ``eval_first`` each one's first place. Test learners without one are not in the fold. Both marks are true
    in train and val.
    """
    known = rows.join(per_item(fold_index(folds, n_folds)), "item")
    index = F.coalesce(F.try_element_at("indices", "fold"), F.lit(UNKNOWN).cast("long"))
    # A row that has max_len rows of its own item fold before it is in no fold's cut sequence.
    fit = _truncated(known.where("split <> 'test'"), order, max_len, "split", "learner", "own")
    others = F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1)))
    fit = _truncated(fit.withColumn("fold", others).where("fold <> own"), order, max_len, "fold", "split", "learner")
    fit = fit.withColumn("item_index", dropped(index, dropout, seed)).withColumn("eval_first", F.lit(True)).withColumn("eval_all", F.lit(True))
    test = _truncated(known.where("split = 'test'"), order, max_len, "split", "learner")
    test = test.withColumn("_first", F.row_number().over(Window.partitionBy("split", "learner", "item").orderBy(*order)) == 1)
    test = test.withColumn("_owns", F.collect_set("own").over(Window.partitionBy("split", "learner"))).withColumn("fold", F.explode("_owns"))
    test = test.withColumn("item_index", index).withColumn("eval_all", F.col("own") == F.col("fold"))
    test = test.withColumn("eval_first", F.col("eval_all") & F.col("_first"))
    names = ("fold", *VIEW, "eval_first", "eval_all")
    return fit.select(*names).unionByName(test.select(*names))


def cold_start_proof(rows: DataFrame, folds: DataFrame, view: DataFrame, n_folds: int) -> DataFrame:
    """Per fold, counted in the view itself: that no own item is trained on or has an index of its own.

    fold, target_items, seen_items, removed_rows (train and val rows of own items in ``rows``), target_fit_rows (such rows
    left in the view), target_largest_index (1 unless an own item has an index), largest_index, first_rows and all_rows
    (test rows under either mark), clean.
    """
    own = per_item(folds.select("item", F.col("fold").alias("own")))
    every = F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))).alias("fold")
    sizes = own.groupBy("own").agg(F.count(F.lit(1)).alias("target_items"))
    total = own.agg(F.count(F.lit(1)).alias("n"))
    removed = rows.where("split <> 'test'").groupBy("item").agg(F.count(F.lit(1)).alias("n")).join(own, "item").groupBy("own").agg(F.sum("n").alias("removed_rows"))
    target, fit = F.col("own") == F.col("fold"), F.col("split") != "test"
    seen = view.groupBy("fold", "split", "item").agg(F.count(F.lit(1)).alias("n"), F.max("item_index").alias("index"), F.count_if("eval_first").alias("first"), F.count_if("eval_all").alias("every"))
    seen = seen.join(own, "item").groupBy("fold").agg(
        F.coalesce(F.sum(F.when(target & fit, F.col("n"))), F.lit(0)).alias("target_fit_rows"), F.max(F.when(target, F.col("index"))).alias("target_largest_index"), F.max("index").alias("largest_index"),
        F.coalesce(F.sum(F.when(~fit, F.col("first"))), F.lit(0)).alias("first_rows"), F.coalesce(F.sum(F.when(~fit, F.col("every"))), F.lit(0)).alias("all_rows"),
    )
    base = total.select("n", every)  # one row a fold
    found = base.join(sizes.withColumnRenamed("own", "fold"), "fold", "left").join(removed.withColumnRenamed("own", "fold"), "fold", "left").join(seen, "fold", "left")
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("target_items", "removed_rows", "target_fit_rows", "first_rows", "all_rows")}
    clean = (zero["target_fit_rows"] == 0) & (F.coalesce(F.col("target_largest_index"), F.lit(UNKNOWN)) == UNKNOWN)
    return found.select("fold", zero["target_items"].alias("target_items"), (F.col("n") - zero["target_items"]).alias("seen_items"), *[zero[c].alias(c) for c in ("removed_rows", "target_fit_rows", "first_rows", "all_rows")], "target_largest_index", "largest_index", clean.alias("clean"))


def train_errors(rows: DataFrame, items: DataFrame, exposures: tuple = EXPOSURES, seed: int = SEED) -> DataFrame:
    """item, exposure, value: the (1, 1)-smoothed error of an item's train rows under each exposure.

    The mean of all items' smoothed train errors where it has none, null if no item has any.
    """
    train = rows.where("split = 'train'")
    whole = train.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.sum(1 - F.col("correct")).alias("k"))
    mean = whole.agg(F.avg(beta_smoothed("k", "n")).alias("_mean"))
    numbers = caps(exposures)
    cells = []
    if "warm" in exposures:
        cells.append(whole.select("item", F.lit("warm").alias("exposure"), "n", "k"))
    if numbers and max(numbers) > 0:
        under = F.filter(F.array(*[F.lit(c) for c in numbers]), lambda c: c >= F.col("exposure_rank")).cast("array<string>")
        capped = exposure_ranks(rows, max(numbers), seed).select("item", "correct", F.explode(under).alias("exposure"))
        cells.append(capped.groupBy("item", "exposure").agg(F.count(F.lit(1)).alias("n"), F.sum(1 - F.col("correct")).alias("k")))
    grid = items.select("item").distinct().select("item", F.explode(F.array(*[F.lit(str(e)) for e in exposures])).alias("exposure"))
    for n, cell in enumerate(cells):
        own = cell.select("item", "exposure", beta_smoothed("k", "n").alias(f"_own{n}"))
        grid = grid.join(per_item(own), ["item", "exposure"], "left")
    owns = [F.col(f"_own{n}") for n in range(len(cells))]
    return grid.crossJoin(F.broadcast(mean)).select("item", "exposure", F.coalesce(*owns, F.col("_mean")).alias("value"))  # one row


def resampled(values: DataFrame) -> DataFrame:
    """``values`` (item, value) with each value drawn anew, with replacement, by a hash of its item."""
    ranked = hash_rank(values, hashed("item"), "item").select("value", "rank")
    n = values.agg(F.count(F.lit(1)).alias("_n"))
    drawn = values.crossJoin(F.broadcast(n)).select("item", F.pmod(hash_number(hashed(F.lit("draw"), "item")), F.col("_n")).alias("rank"))  # one row
    return drawn.join(per_item(ranked), "rank").select("item", "value")


def permuted(values: DataFrame) -> DataFrame:
    """``values`` (item, value) dealt to the items anew, each once."""
    left = hash_rank(values, hashed("item"), "item").select("item", "rank")
    right = hash_rank(values, hashed(F.lit("p"), "item"), "item").select("value", "rank")
    return left.join(per_item(right), "rank").select("item", "value")


def scaled_length(items: DataFrame) -> DataFrame:
    """item, value: length of ``text`` between the least and the largest, 0.5 where all are alike."""
    sized = items.select("item", F.length("text").cast("double").alias("_len"))
    edge = sized.agg(F.min("_len").alias("_low"), F.max("_len").alias("_high"))
    scaled = F.when(F.col("_high") > F.col("_low"), (F.col("_len") - F.col("_low")) / (F.col("_high") - F.col("_low"))).otherwise(0.5)
    return sized.crossJoin(F.broadcast(edge)).select("item", scaled.alias("value"))  # one row


def scalar_maps(items: DataFrame, scores: DataFrame, rows: DataFrame, control: str, exposures: tuple = EXPOSURES, seed: int = SEED) -> DataFrame:
    """Long table of every scalar of an item: item, exposure, source, value.

    Sources: the models of ``scores`` (item, model, score), ``resampled`` and ``permuted`` from the model ``control``,
    ``length``, ``oracle_error`` from all rows, all with exposure ``any``, and ``train_error`` under each exposure. Items
    without a score or a response have no row of that source.
    """
    own = scores.where(F.col("model") == control).select("item", F.col("score").alias("value")).join(per_item(items.select("item")), "item", "left_semi")
    oracle = rows.groupBy("item").agg(beta_smoothed(F.sum(1 - F.col("correct")), F.count(F.lit(1))).alias("value")).join(per_item(items.select("item")), "item", "left_semi")
    named = {"resampled": resampled(own), "permuted": permuted(own), "length": scaled_length(items), "oracle_error": oracle}
    long = scores.join(per_item(items.select("item")), "item", "left_semi").select("item", F.lit("any").alias("exposure"), F.col("model").alias("source"), F.col("score").alias("value"))
    for name, values in named.items():
        long = long.unionByName(values.select("item", F.lit("any").alias("exposure"), F.lit(name).alias("source"), "value"))
    return long.unionByName(train_errors(rows, items, exposures, seed).select("item", "exposure", F.lit("train_error").alias("source"), "value"))
