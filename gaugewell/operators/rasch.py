"""One-parameter logistic item response model, fitted by alternating Newton steps over ranges of learners.

Responses stay where they are: each range of learners counts its own per learner and item and keeps them as arrays. Items
are dealt to blocks by hash. In a step a block sends each range the difficulties of the items that occur there, and gets
back two sums for each; learners' abilities stay with their range. All are plain numbers in an order that both sides know,
so that 24 bytes move for an item and range, and neither keys nor responses; only the estimates are checkpointed.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugewell.sources.files import cut

#: Ranges of learners for each core at least, and about how many responses a range may have; a task holds one range at a time.
RANGES, RESPONSES = 2, 4_000_000
#: What is sent ``to`` a range or block ``frm`` another: difficulties, sums, abilities and items, as doubles in ``a``, ``b`` and ``n``.
SENT = {"to": pa.int32(), "frm": pa.int32(), "kind": pa.string(), "a": pa.binary(), "b": pa.binary(), "n": pa.binary(), "total": pa.float64(), "count": pa.int64(), "low": pa.float64(), "high": pa.float64()}
SENT_SQL = "to int, frm int, kind string, a binary, b binary, n binary, total double, count long, low double, high double"
#: In place of a range, where responses name no learner: they count in ``n`` and ``k`` of an item only.
NO_LEARNER = -1


def _rows(found: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(found, schema=pa.schema(SENT.items()))


def _small(counts: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest needs."""
    return counts.astype(np.min_scalar_type(int(counts.max(initial=0)))).tobytes()


def _large(small: bytes, size: int) -> np.ndarray:
    return np.frombuffer(small, f"u{len(small) // max(size, 1) or 1}").astype(float)


def _unusable(n: np.ndarray, k: np.ndarray, least: int) -> np.ndarray:
    """Where counts have no finite estimate: too few, all right or all wrong."""
    return (n < least) | (k <= 0) | (k >= n)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range's counts per item, and one row with its cells: learners' numbers of cells, and each cell's item and counts."""
    if not (batches := [x for x in batches if x.num_rows]):
        return
    table = pa.Table.from_batches(batches)
    del batches
    if len(own := table.column("range").unique()) != 1:
        raise ValueError(f"a task has the ranges {own.to_pylist()}")
    own, n, k = own[0].as_py(), np.asarray(table.column("n")), np.asarray(table.column("k"))
    learners, items = (table.column(c).combine_chunks().dictionary_encode(null_encoding="encode") for c in ("learner", "item"))
    place = np.empty(len(learners.dictionary), np.int32)
    place[np.asarray(pc.sort_indices(learners.dictionary))] = np.arange(len(place))
    learner = place[np.asarray(learners.indices)]  # in order of the keys, as abilities are kept
    code, items, size = np.asarray(items.indices), items.dictionary, len(items.dictionary)
    seen = np.empty(size, np.int64)
    seen[code] = np.arange(len(code))
    found = pa.table({"to": table.column("to").take(pa.array(seen)), "item": items})
    del table, seen, learners
    order = pc.sort_indices(found, sort_keys=[("to", "ascending"), ("item", "ascending")])
    found, place = found.take(order).combine_chunks(), np.empty(size, np.int32)
    place[np.asarray(order)] = np.arange(size, dtype=np.int32)
    code = place[code]
    sums = [np.bincount(code, what, size).astype(np.int64) for what in (n, k)]
    cell = learner.astype(np.int64) * size + code
    cell[np.asarray(pc.is_null(found.column("item")))[code]] = -1
    del learner, code
    order = np.argsort(cell)
    order = order[np.searchsorted(cell, 0, sorter=order) :]
    cell = cell[order]
    packed = [np.bincount(cell // size).astype(np.int32).tobytes(), (cell % size).astype(np.int32).tobytes(), _small(n[order]), _small(k[order])]
    blank = lambda kind, rows=1: pa.nulls(rows, kind)
    kinds, names = [items.type, pa.int64(), pa.int64(), *[pa.binary()] * 4], ["range", "to", "item", "n", "k", "learners", "items", "times", "right"]
    yield pa.RecordBatch.from_arrays([pa.array([own], pa.int32()), blank(pa.int32()), *map(blank, kinds[:3]), *[pa.array([x], pa.binary()) for x in packed]], names)
    each = pa.Table.from_arrays([pa.array(np.full(size, own), pa.int32()), found.column("to"), found.column("item"), *map(pa.array, sums), *[blank(x, size) for x in kinds[3:]]], names)
    yield from each.combine_chunks().to_batches(max_chunksize=100_000)


def _block(least: int) -> Callable[[pa.Table], pa.Table]:
    """A block's items in order, their counts, and the places of those that occur in each range."""

    def run(table: pa.Table) -> pa.Table:
        items = pc.unique(table.column("item"))
        items = items.take(pc.sort_indices(items))
        code, ranges = np.asarray(pc.index_in(table.column("item"), value_set=items)).astype(np.int32), np.asarray(table.column("range"))
        sums = lambda name, some=slice(None): np.bincount(code[some], np.asarray(table.column(name))[some], len(items))
        n, k, known = sums("n"), sums("k"), ranges != NO_LEARNER
        start = np.where(_unusable(sums("n", known), sums("k", known), least) | np.asarray(pc.is_null(items)), np.nan, 0.0)
        code, ranges = code[known], ranges[known]
        to, sizes = np.unique(ranges, return_counts=True)
        arrays = {"n": n, "k": k, "start": start, "ranges": to.astype(np.int32), "sizes": sizes.astype(np.int32), "places": code[np.lexsort((code, ranges))]}
        ids = pa.ListArray.from_arrays(pa.array([0, len(items)], pa.int32()), items)
        return pa.table({"block": pa.array([table.column("to")[0].as_py()], pa.int32()), "items": ids} | {name: pa.array([x.tobytes()], pa.binary()) for name, x in arrays.items()})

    return run


def _array(table: pa.Table, name: str, kind: type = float) -> np.ndarray:
    return np.frombuffer(table.column(name)[0].as_py(), kind)


def _places(block: pa.Table) -> list[tuple[int, np.ndarray]]:
    """For each range, the places of its items in the block."""
    ends = np.cumsum(_array(block, "sizes", np.int32))
    if not len(ends):
        return []
    return list(zip(_array(block, "ranges", np.int32).tolist(), np.split(_array(block, "places", np.int32), ends[:-1]), strict=True))


def _difficulties(block: pa.Table, state: list[dict], mean: float) -> np.ndarray:
    """A block's centred difficulties; none for items that are left out."""
    return np.frombuffer(state[0]["a"]) - mean if state else _array(block, "start")


def _of(rows: pa.Table, kind: str) -> list[dict]:
    return rows.filter(pc.equal(rows.column("kind"), kind)).to_pylist()


def _sending(mean: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """To each range the difficulties of a block's items there."""

    def run(block: pa.Table, state: pa.Table) -> pa.Table:
        b, own = _difficulties(block, state.to_pylist(), mean), block.column("block")[0].as_py()
        return _rows([{"to": to, "frm": own, "kind": "difficulties", "a": b[places].tobytes()} for to, places in _places(block)])

    return run


def _learning(first: bool, least: int, limit: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A range's new abilities, and with them the sums that its responses give to its items; at first, who is left out."""

    def run(cells: pa.Table, sent: pa.Table) -> pa.Table:
        sizes, item = _array(cells, "learners", np.int32), _array(cells, "items", np.int32)
        learner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        blocks = sorted(_of(sent, "difficulties"), key=lambda x: x["frm"])
        parts, state, own = [np.frombuffer(x["a"]) for x in blocks], _of(sent, "ability"), cells.column("range")[0].as_py()
        b, ability = np.concatenate(parts), np.frombuffer(state[0]["a"]) if state else np.zeros(len(sizes))
        out = np.isnan(b)[item] | np.isnan(ability)[learner]
        n, k = (np.where(out, 0.0, _large(cells.column(c)[0].as_py(), len(item))) for c in ("times", "right"))
        b, old = np.nan_to_num(b), np.nan_to_num(ability)
        of_learner, of_item = (lambda what, by=by, size=size: np.bincount(by, what, size) for by, size in ((learner, len(sizes)), (item, len(b))))
        if first:
            lost = _unusable(of_learner(n), of_learner(k), least)
            ability, kept = np.where(lost, np.nan, 0.0), ~lost[learner]
            sums = of_item(k * kept), of_item(n * kept)
        else:
            chance = lambda x: 1 / (1 + np.exp(b[item] - x[learner]))
            p = chance(old)
            step = of_learner(k - n * p) / np.maximum(of_learner(n * p * (1 - p)), 1e-9)
            new = np.clip(old + np.clip(step, -1, 1), -limit, limit)
            p = chance(new)
            sums, ability = (of_item(k - n * p), of_item(n * p * (1 - p))), np.where(np.isnan(ability), np.nan, new)
        ends = np.cumsum([len(x) for x in parts])[:-1]
        back = zip(blocks, *[np.split(x, ends) for x in sums], strict=True)
        return _rows([{"to": x["frm"], "frm": own, "kind": "sums", "a": g.tobytes(), "b": h.tobytes()} for x, g, h in back] + [{"to": own, "kind": "ability", "a": ability.tobytes()}])

    return run


def _moving(first: bool, mean: float, least: int, limit: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A block's new difficulties, not yet centred, and how far they moved; abilities go through to the next step."""

    def run(block: pa.Table, sent: pa.Table) -> pa.Table:
        abilities = _of(sent, "ability")
        if not block.num_rows:
            return _rows(abilities)
        state = _of(sent, "item")
        old, sums = _difficulties(block, state, mean), {x["frm"]: x for x in _of(sent, "sums")}
        g, h = np.zeros(len(old)), np.zeros(len(old))
        for frm, places in _places(block):
            g[places] += np.frombuffer(sums[frm]["a"])
            h[places] += np.frombuffer(sums[frm]["b"])
        if first:
            new, n = np.where(np.isnan(old) | _unusable(h, g, least), np.nan, 0.0), h
        else:
            new, n = np.clip(old - np.clip(g / np.maximum(h, 1e-9), -1, 1), -limit, limit), np.frombuffer(state[0]["n"])
        some = ~np.isnan(new)
        moved = (new - old)[some].tolist()
        return _rows([*abilities, {"to": block.column("block")[0].as_py(), "kind": "item", "a": new.tobytes(), "b": h.tobytes(), "n": n.tobytes(), "total": float(new[some].sum()), "count": len(moved), "low": min(moved, default=None), "high": max(moved, default=None)}])

    return run


def _unpacked(mean: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A row per item of a block."""

    def run(block: pa.Table, state: pa.Table) -> pa.Table:
        state = state.to_pylist()
        b, n, h = _difficulties(block, state, mean), np.frombuffer(state[0]["n"]), np.frombuffer(state[0]["b"])
        out = np.isnan(b)
        counts = {name: pa.array(_array(block, name).astype(np.int64)) for name in ("n", "k")}
        return pa.table({"item": block.column("items").combine_chunks().flatten()} | counts | {"fitted": pa.array(n.astype(np.int64), mask=out), "difficulty": pa.array(b, mask=out), "h": pa.array(h, mask=out)})

    return run


def item_flags(responses: DataFrame, least: int = 5) -> DataFrame:
    """``item``, ``n``, ``perfect`` and ``zero``: whether an item with ``least`` responses has only right, or only wrong ones."""
    counts = responses.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.sum("correct").alias("k"))
    return counts.select("item", "n", *flags(least))


def flags(least: int = 5) -> tuple[Column, Column]:
    """The flags of :func:`item_flags` from an item's ``n`` and ``k``."""
    enough = F.col("n") >= least
    return (enough & (F.col("k") == F.col("n"))).alias("perfect"), (enough & (F.col("k") == 0)).alias("zero")


def _packed(responses: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """The ranges of learners and the blocks of items, a row each; kept until unpersisted."""
    spark, kind = responses.sparkSession, responses.schema["item"].dataType.simpleString()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = responses.select("learner", "item", "correct").persist()
    ranges = max(RANGES * spark.sparkContext.defaultParallelism, math.ceil(rows.count() / RESPONSES))
    counts = F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("correct"), F.lit(0)).cast("long").alias("k")
    to = F.pmod(F.hash("item"), F.lit(ranges)).alias("to")
    dealt = rows.where("learner is not null").repartitionByRange(ranges, "learner").withColumn("range", F.spark_partition_id())
    cells = dealt.groupBy("range", "learner", "item").agg(*counts).select("range", "learner", to, "item", "n", "k")  # where they lie
    counted = cells.mapInArrow(_counted, f"range int, to int, item {kind}, n long, k long, learners binary, items binary, times binary, right binary").persist()
    learners = counted.where("learners is not null").select("range", "learners", "items", "times", "right").repartition(parts, "range").persist()
    unnamed = rows.where("learner is null").groupBy("item").agg(*counts).select(F.lit(NO_LEARNER).alias("range"), to, "item", "n", "k")
    per_range = counted.where("learners is null").select("range", "to", "item", "n", "k").unionByName(unnamed)
    blocks = per_range.groupBy("to").applyInArrow(_block(least), f"block int, items array<{kind}>, n binary, k binary, start binary, ranges binary, sizes binary, places binary")
    blocks = blocks.repartition(parts, "block").persist()
    for kept in (learners, blocks):
        kept.count()
    for done in (rows, counted):
        done.unpersist()
    return learners, blocks


def fit_items(responses: DataFrame, steps: int = 80, least: int = 5, limit: float = 6.0, tolerance: float = 1e-4) -> DataFrame:
    """Every ``item`` with its ``n`` responses and ``k`` right ones; where it has a finite estimate, also as in :func:`fit_rasch` how many were ``fitted``, its ``difficulty`` and information ``h``."""
    learners, blocks = _packed(responses, least)
    state, mean, moved_by = responses.sparkSession.createDataFrame([], SENT_SQL), 0.0, None
    for step in range(steps + 1):  # the first leaves out learners, then items, without a finite estimate
        item, ability, by = state.where("kind = 'item'"), state.where("kind = 'ability'"), blocks.groupBy("block")
        sent = by.cogroup(item.groupBy("to")).applyInArrow(_sending(mean), SENT_SQL)
        back = learners.groupBy("range").cogroup(sent.unionByName(ability).groupBy("to")).applyInArrow(_learning(step == 0, least, limit), SENT_SQL)
        state = cut(by.cogroup(back.unionByName(item).groupBy("to")).applyInArrow(_moving(step == 0, mean, least, limit), SENT_SQL))
        found = state.where("kind = 'item'").agg(F.sum("total").alias("total"), F.sum("count").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).first()
        if not found.n:
            break
        mean = found.total / found.n
        moved_by = max(abs(found.low - mean), abs(found.high - mean))
        if step and moved_by < tolerance:
            break
    else:
        warnings.warn(f"difficulties still moved by {moved_by:.2g} after {steps} steps", stacklevel=2)
    kind = responses.schema["item"].dataType.simpleString()
    fitted = cut(blocks.groupBy("block").cogroup(state.where("kind = 'item'").groupBy("to")).applyInArrow(_unpacked(mean), f"item {kind}, n long, k long, fitted long, difficulty double, h double"))
    for kept in (learners, blocks):
        kept.unpersist()
    return fitted


def fit_rasch(responses: DataFrame, steps: int = 80, least: int = 5, limit: float = 6.0, tolerance: float = 1e-4) -> DataFrame:
    """``item``, ``n``, ``difficulty``, ``se``: Newton steps for abilities and centred difficulties in turn.

    They end when no difficulty moves by ``tolerance`` or more, or after ``steps`` (with a warning).

    ``responses`` has learner, item and 0/1 correct. Items and learners that are all right or all wrong, or have
    fewer than ``least`` responses, have no finite estimate and are left out before the first step.
    """
    found = fit_items(responses, steps, least, limit, tolerance).where("difficulty is not null")
    return found.select("item", F.col("fitted").alias("n"), "difficulty", (1 / F.sqrt("h")).alias("se"))
