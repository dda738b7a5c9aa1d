"""Correlations of all replicates of a bootstrap at once: a row holds its counts in every replicate, packed into one array.

Ranks differ between replicates, but which values lie below a value does not. So counts are summed as arrays by value,
running totals are taken of arrays, in buckets as in :mod:`gaugewell.operators.ranking`, and no row is written per
replicate. Keys with the same cells and values are one row from the start.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, StructField, StructType

from gaugewell.operators.ranking import BUCKETS, bucket_of
from gaugewell.sources.files import cut

#: Numbers of 32 bits in a digest, each for one replicate.
PER_DIGEST = 8
#: A count is how many of these a number reaches: Poisson(1)'s distribution function at 0, 1, ... in steps of 2**-32.
EDGES = tuple(int(2**32 * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(10))
#: Rows that are unpacked at once, and about how many rows a bucket has.
ROWS = 1024
#: Sums that make a correlation: of weights, and of their products with x, y, xy, xx and yy.
MOMENTS = ("n", "_x", "_y", "_xy", "_xx", "_yy")


def packed(numbers: np.ndarray) -> pa.Array:
    """Each row of whole numbers as bytes, in the narrowest type that holds all."""
    most = int(np.abs(numbers).max(initial=0))
    kind = next(k for k in ("<i1", "<i2", "<i4", "<i8") if most <= np.iinfo(k).max)
    return pa.array([row.tobytes() for row in numbers.astype(kind)], pa.binary())


def unpacked(column: pa.Array, replicates: int) -> np.ndarray:
    """The numbers of :func:`packed`, as 64-bit integers."""
    found = np.empty((len(column), replicates), np.int64)
    width = np.asarray(pc.binary_length(column)) // replicates
    for size in np.unique(width):
        at = width == size
        found[at] = np.frombuffer(b"".join(column.filter(pa.array(at)).to_pylist()), f"<i{size}").reshape(-1, replicates)
    return found


def _groups(batch: pa.RecordBatch, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The rows of ``batch`` in the order of the groups of ``keys``, in that of their first rows, and where each group starts."""
    table = pa.Table.from_batches([batch.select(keys)]).append_column("_row", pa.array(np.arange(batch.num_rows)))
    lists = table.group_by(keys, use_threads=False).aggregate([("_row", "list")]).column("_row_list").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    rows, sizes = np.asarray(lists.flatten()), np.asarray(pc.list_value_length(lists))
    firsts = np.minimum.reduceat(rows, np.cumsum(sizes) - sizes)
    # Arrow does not promise the groups' order.
    order = np.lexsort([rows, np.repeat(firsts, sizes)])
    sizes = sizes[np.argsort(firsts)]
    return rows[order], np.cumsum(sizes) - sizes


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _summed(keys: list[str], replicates: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums ``w`` of neighbouring rows with equal ``keys``, all of them where rows are sorted; other columns are the first row's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in _sliced(batches):
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            order, starts = _groups(batch, keys)
            sums = packed(np.add.reduceat(unpacked(batch.column("w"), replicates)[order], starts, axis=0))
            firsts = pa.array(order[starts])
            found = pa.RecordBatch.from_arrays([sums if name == "w" else batch.column(name).take(firsts) for name in batch.schema.names], schema=batch.schema)
            yield found.slice(0, found.num_rows - 1)
            held = found.slice(found.num_rows - 1)
        if held is not None:
            yield held

    return run


def merged(rows: DataFrame, keys: list[str], replicates: int) -> DataFrame:
    """``rows`` with the arrays ``w`` of equal ``keys`` summed, in each task before the shuffle too."""
    step = _summed(keys, replicates)
    return rows.mapInArrow(step, rows.schema).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(step, rows.schema)


def _drawn(replicates: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds how often each row counts in each replicate, by digests of ``_seed`` and the replicates' group."""
    edges = np.array(EDGES, np.uint32)
    ends = [f"|{g}".encode() for g in range(-(-replicates // PER_DIGEST))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            seeds = [seed.encode() for seed in batch.column("_seed").to_pylist()]
            digests = b"".join(hashlib.sha256(seed + end).digest() for seed in seeds for end in ends)
            numbers = np.frombuffer(digests, ">u4").reshape(len(seeds), -1)[:, :replicates].astype(np.uint32)
            counts = packed(np.searchsorted(edges, numbers, side="right"))
            yield pa.RecordBatch.from_arrays([batch.column("_profile_id"), batch.column("_profile"), counts], names=["_profile_id", "_profile", "w"])

    return run


def counted_pairs(rows: DataFrame, x: str, y: str, key: str, *cell: str, replicates: int, stream: str = "boot") -> DataFrame:
    """Pairs of values ``_x`` and ``_y`` of each cell with ``w``, how often they occur in each replicate; checkpointed.

    What a key has in all cells is its profile; counts are drawn once a key and summed by profile. Pairs may occur again.
    """
    number = lambda name: (F.col(name).cast("double") + 0.0)  # noqa: E731  # no negative zero
    both = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(key, F.struct(*cell, number(x).alias("_x"), number(y).alias("_y")).alias("_one"))
    profiles = both.groupBy(key).agg(F.sort_array(F.collect_list("_one")).alias("_profile"))
    seeds = profiles.select(F.concat_ws("|", F.lit(stream), F.col(key).cast("string")).alias("_seed"), F.sha2(F.to_json("_profile"), 256).alias("_profile_id"), "_profile")
    schema = StructType([*(f for f in seeds.schema.fields if f.name != "_seed"), StructField("w", BinaryType())])
    summed = merged(seeds.mapInArrow(_drawn(replicates), schema), ["_profile_id"], replicates)
    return cut(summed.select(F.explode("_profile").alias("_one"), "w").select("_one.*", "w"))


def _before(replicates: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("_bucket").combine_chunks()
        w = unpacked(table.column("w").combine_chunks(), replicates)
        whole = np.broadcast_to(w.sum(axis=0), w.shape)
        return table.drop_columns(["w"]).append_column("below", packed(np.cumsum(w, axis=0) - w)).append_column("whole", packed(whole))

    return run


def _inside(value: str, name: str, replicates: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(values: pa.Table, bucket: pa.Table) -> pa.Table:
        values = values.sort_by(value).combine_chunks()
        w = unpacked(values.column("w").combine_chunks(), replicates)
        below, whole = (unpacked(bucket.column(c).combine_chunks(), replicates) for c in ("below", "whole"))
        return values.drop_columns(["w", "_bucket"]).append_column(name, packed(2 * (below + np.cumsum(w, axis=0) - w) + w - whole))

    return run


def centred_ranks(pairs: DataFrame, value: str, name: str, replicates: int, *cell: str) -> DataFrame:
    """Cell, value and ``name``: in each replicate twice the value's average rank less the cell's mean rank. Cells must not be null."""
    values = cut(merged(pairs.select(*cell, value, "w"), [*cell, value], replicates))
    keyed = cut(bucket_of(values, value, max(BUCKETS, values.count() // ROWS)))  # the same buckets for totals and ranks
    fields = {f.name: f for f in keyed.schema.fields}
    key = [fields[c] for c in (*cell, "_bucket")]
    totals = merged(keyed.select(*cell, "_bucket", "w"), [*cell, "_bucket"], replicates)
    before = totals.groupBy(*cell).applyInArrow(_before(replicates), StructType([*key, StructField("below", BinaryType()), StructField("whole", BinaryType())]))
    groups = [frame.groupBy(*cell, "_bucket") for frame in (keyed, before)]
    return groups[0].cogroup(groups[1]).applyInArrow(_inside(value, name, replicates), StructType([*(fields[c] for c in (*cell, value)), StructField(name, BinaryType())]))


def _totals(keys: list[str], names: tuple[str, ...], replicates: int, products: Callable[[pa.RecordBatch], list[np.ndarray]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums of ``products``, one array per name with a row per row, by ``keys``: a row for each replicate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in _sliced(batches):
            order, starts = _groups(batch, keys)
            found = np.stack([np.add.reduceat(p[order], starts, axis=0) for p in products(batch)], axis=1)
            owners = zip(*[batch.column(k).take(pa.array(order[starts])).to_pylist() for k in keys], strict=True)
            for owner, part in zip(owners, found, strict=True):
                sums[owner] = sums[owner] + part if owner in sums else part
        types = {k: batch.schema.field(k).type for k in keys} if sums else {}
        for owner, part in sums.items():
            own = [pa.array([v] * replicates, types[k]) for k, v in zip(keys, owner, strict=True)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(np.arange(replicates, dtype=np.int32)), *[pa.array(p) for p in part]], names=[*keys, "b", *names])

    return run


def _per_replicate(rows: DataFrame, names: tuple[str, ...], replicates: int, products: Callable, *cell: str) -> DataFrame:
    fields = {f.name: f for f in rows.schema.fields}
    schema = StructType([*(fields[c] for c in cell), StructField("b", IntegerType()), *(StructField(n, DoubleType()) for n in names)])
    parts = rows.mapInArrow(_totals(list(cell), names, replicates, products), schema)
    return parts.groupBy(*cell, "b").agg(*[F.sum(n).alias(n) for n in names])


def moments(pairs: DataFrame, replicates: int, *cell: str) -> DataFrame:
    """:data:`MOMENTS` of each cell and replicate ``b``."""

    def products(batch: pa.RecordBatch) -> list[np.ndarray]:
        w = unpacked(batch.column("w"), replicates).astype(float)
        x, y = (np.asarray(batch.column(c))[:, None] for c in ("_x", "_y"))
        return [w, w * x, w * y, w * x * y, w * x * x, w * y * y]

    return _per_replicate(pairs, MOMENTS, replicates, products, *cell)


def rank_correlations(pairs: DataFrame, replicates: int, *cell: str, least: float = 5) -> DataFrame:
    """n and ``rho`` of each cell and replicate ``b``, with average ranks for ties; null with fewer than ``least`` rows or a constant side."""

    def products(batch: pa.RecordBatch) -> list[np.ndarray]:
        w, rx, ry = (unpacked(batch.column(c), replicates).astype(float) for c in ("w", "_rx", "_ry"))
        return [w, w * rx * ry, w * rx * rx, w * ry * ry]

    ranked = pairs.join(centred_ranks(pairs, "_x", "_rx", replicates, *cell), [*cell, "_x"]).join(centred_ranks(pairs, "_y", "_ry", replicates, *cell), [*cell, "_y"])
    sums = _per_replicate(ranked, ("n", "_c", "_vx", "_vy"), replicates, products, *cell)
    usable = (F.col("n") >= least) & (F.col("_vx") > 0) & (F.col("_vy") > 0)
    return sums.select(*cell, "b", "n", F.when(usable, F.col("_c") / F.sqrt(F.col("_vx") * F.col("_vy"))).alias("rho"))
