"""Merkle manifest of a table by a SHA-256 midstate tree.

Every row is a leaf, the SHA-256 of its fields. Leaves of one group stand in key order; runs of ``fanout`` consecutive
nodes become their parent, until one node, the group's subroot, is left. Subroots in the order of the groups form one
more such tree, whose last node is the root. Nodes are hashed as 64 hexadecimal digits, which is one SHA-256 block: so
the state of a hash between two children is eight words, and a parent keeps a copy of it before each child's slot.
Folding a changed child upwards resumes the state before its slot and reads only the new digest and the siblings to
its right. The copies are columns of a table, which the objects of ``hashlib`` cannot be; hence the numpy rounds.

A tree is cut into blocks of at most :data:`BLOCK` consecutive nodes. A tier of blocks is one grouped pass, whose
roots are the nodes of the next tier: a billion leaves take three tiers, and no group holds more than a block. Paths
from each block to the root are composed downwards, a row for each block, and meet the block's leaves in one pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugewell.llm.session import shuffle_width, written
from gaugewell.llm.spread import join_unique

FANOUT = 2
#: Most leaves of a block; its levels are as many as keep within.
BLOCK = 1024
#: Rows of offsets, a group and a range each, up to which they are broadcast; past that Spark joins by shuffle.
BROADCAST_OFFSETS = 100_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _roots(power: float, primes: int) -> np.ndarray:
    """The first 32 bits of the fractional parts of roots of the first primes: the constants of SHA-256."""
    found, n = [], 2
    while len(found) < primes:
        if all(n % p for p in found):
            found.append(n)
        n += 1
    # Integer roots of the primes, shifted so that 32 fractional bits are exact.
    return np.array([_integer_root(p << (32 * power), power) & 0xFFFFFFFF for p in found], np.uint32)


def _integer_root(x: int, power: int) -> int:
    low, high = 0, 1 << (x.bit_length() // power + 1)
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if middle**power <= x else (low, middle - 1)
    return low


INITIAL, ROUND = _roots(2, 8), _roots(3, 64)
_HEX = np.frombuffer("".join(f"{i:02x}" for i in range(256)).encode(), np.uint16)


def compress(states: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """SHA-256 states (n x 8 words) after one more block each (n x 16 words)."""
    turn = lambda x, k: (x >> np.uint32(k)) | (x << np.uint32(32 - k))
    w = list(np.ascontiguousarray(blocks.T))
    a, b, c, d, e, f, g, h = before = list(np.ascontiguousarray(states.T))
    for i in range(64):
        if i >= 16:
            x, y = w[i - 15], w[i - 2]
            w.append(w[i - 16] + (turn(x, 7) ^ turn(x, 18) ^ (x >> np.uint32(3))) + w[i - 7] + (turn(y, 17) ^ turn(y, 19) ^ (y >> np.uint32(10))))
        one = h + (turn(e, 6) ^ turn(e, 11) ^ turn(e, 25)) + (g ^ (e & (f ^ g))) + ROUND[i] + w[i]
        two = (turn(a, 2) ^ turn(a, 13) ^ turn(a, 22)) + ((a & b) | (c & (a | b)))
        h, g, f, e, d, c, b, a = g, f, e, d + one, c, b, a, one + two
    return np.stack([x + y for x, y in zip(before, (a, b, c, d, e, f, g, h), strict=True)], axis=1)


def _hex_blocks(digests: np.ndarray) -> np.ndarray:
    """Digests (n x 8 words) as the block of their hexadecimal digits."""
    raw = digests.astype(">u4").view(np.uint8).reshape(len(digests), 32)
    return _HEX[raw].view(np.uint8).reshape(len(digests), 64).view(">u4").astype(np.uint32)


def _ended(states: np.ndarray, children: np.ndarray) -> np.ndarray:
    """Digests of states that have taken in so many blocks each."""
    pad = np.zeros((len(states), 16), np.uint32)
    pad[:, 0], pad[:, 15] = 1 << 31, children * 512
    return compress(states, pad)


def parents(nodes: np.ndarray, fanout: int) -> tuple[np.ndarray, np.ndarray]:
    """Digests of the runs of ``fanout`` nodes (the last may be shorter), and the states before each slot (n x fanout x 8)."""
    runs = -(-len(nodes) // fanout)
    counts = np.full(runs, fanout)
    counts[-1] = len(nodes) - fanout * (runs - 1)
    blocks = _hex_blocks(nodes)
    now = np.tile(INITIAL, (runs, 1))
    states = np.zeros((runs, fanout, 8), np.uint32)
    for slot in range(fanout):
        states[:, slot] = now
        some = np.flatnonzero(counts > slot)
        now[some] = compress(now[some], blocks[some * fanout + slot])
    return _ended(now, counts), states


class Tree(NamedTuple):
    """Levels of a block from its nodes up, and of each level above the first the states before its parents' slots."""

    levels: list[np.ndarray]
    states: list[np.ndarray]


def grow(nodes: np.ndarray, fanout: int, height: int | None) -> Tree:
    """The tree over ``nodes``, ``height`` levels high, or as high as to leave one node."""
    levels, states = [nodes], []
    while len(levels[-1]) > 1 if height is None else len(states) < height:
        above, slots = parents(levels[-1], fanout)
        levels.append(above)
        states.append(slots)
    return Tree(levels, states)


class Path(NamedTuple):
    """What folding reads, for m nodes over h levels: slots and sizes of their runs (m x h), the states before the slots
    (m x h x 8), and the nodes right of them (m x h x fanout - 1 x 8; as many count as the run has)."""

    slots: np.ndarray
    sizes: np.ndarray
    states: np.ndarray
    rights: np.ndarray


def path_of(tree: Tree, places: np.ndarray, fanout: int) -> Path:
    """The paths of nodes in ``places`` to the root of ``tree``."""
    m, height = len(places), len(tree.states)
    path = Path(np.zeros((m, height), np.uint8), np.zeros((m, height), np.uint8), np.zeros((m, height, 8), np.uint32), np.zeros((m, height, fanout - 1, 8), np.uint32))
    for level, (nodes, states) in enumerate(zip(tree.levels, tree.states, strict=False)):
        run, slot = places // fanout, places % fanout
        path.slots[:, level], path.sizes[:, level] = slot, np.minimum(fanout, len(nodes) - run * fanout)
        path.states[:, level] = states[run, slot]
        for right in range(1, fanout):
            path.rights[:, level, right - 1] = nodes[np.minimum(places + right, len(nodes) - 1)]
        places = run
    return path


def fold(digests: np.ndarray, path: Path) -> np.ndarray:
    """The last node for each of ``digests`` put alone into its place: states resume before it, then right siblings follow."""
    for level in range(path.slots.shape[1]):
        slots, sizes = path.slots[:, level].astype(np.int64), path.sizes[:, level].astype(np.int64)
        now = compress(path.states[:, level], _hex_blocks(digests))
        for right in range(1, int((sizes - slots).max(initial=0))):
            some = np.flatnonzero(slots + right < sizes)
            now[some] = compress(now[some], _hex_blocks(path.rights[some, level, right - 1]))
        digests = _ended(now, sizes)
    return digests


def siblings(tree: Tree, places: np.ndarray, fanout: int) -> list[str]:
    """The other digests of the runs of each place as hexadecimal text, level by level, left to right."""
    found = [[] for _ in places]
    for nodes in tree.levels[:-1]:
        texts = _hex_blocks(nodes).astype(">u4").tobytes().decode()
        for i, place in enumerate(places.tolist()):
            first = place - place % fanout
            found[i] += [texts[64 * j : 64 * j + 64] for j in range(first, min(first + fanout, len(nodes))) if j != place]
        places = places // fanout
    return ["".join(x) for x in found]


def field_text(*values: Column) -> Column:
    """What a leaf hashes: each value as ``-`` where null, else its length in bytes, a colon and itself."""
    texts = [v.cast("string") for v in values]
    return F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def leaf(*values: Column) -> Column:
    """The digest of a row's fields as 32 bytes."""
    return F.unhex(F.sha2(field_text(*values), 256))


BLOCKS = "grp string, block long, last boolean, levels array<binary>, states array<binary>, digest binary"
PATH = "slots binary, sizes binary, states binary, rights binary, siblings string"
NODE_PATHS = f"grp string, place long, block long, {PATH}"
_STEPS = ("slots", "sizes", "states", "rights", "siblings")


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``place``, their 0-based place in ``grp`` by ``order`` (nulls first), and ``n``, how many ``grp`` has.

    No task has all rows of a group: rows are dealt into ranges of group and order and written once; a group's ranges
    follow each other, so that the counts of those before give each range its first place.
    """
    parts = shuffle_width(rows.sparkSession)
    dealt = rows.repartitionByRange(parts, "grp", *order).sortWithinPartitions("grp", *order)
    dealt = written(dealt.withColumn("_at", F.monotonically_increasing_id()), "places")
    part = F.shiftright("_at", 33).alias("_part")
    runs = dealt.groupBy("grp", part).agg(F.count(F.lit(1)).alias("c"), F.min("_at").alias("first"))
    group = Window.partitionBy("grp")
    before = F.sum("c").over(group.orderBy("_part")) - F.col("c")
    offsets = written(runs.select("grp", "_part", (before - F.col("first")).alias("_shift"), F.sum("c").over(group).alias("n")), "offsets")
    near = F.broadcast(offsets) if offsets.count() <= BROADCAST_OFFSETS else offsets
    met = dealt.withColumn("_part", part).join(near, ["grp", "_part"])
    return met.withColumn("place", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def _words(raw: bytes, *shape: int) -> np.ndarray:
    return np.frombuffer(raw, ">u4").reshape(-1, *shape).astype(np.uint32)


def _raw(words: np.ndarray) -> bytes:
    return words.astype(">u4").tobytes()


def _stored(row: pd.Series, fanout: int) -> Tree:
    """The tree of a row of :data:`BLOCKS`."""
    return Tree([_words(x, 8) for x in row.levels], [_words(x, fanout, 8) for x in row.states])


def tiers(nodes: DataFrame, fanout: int, height: int) -> list[DataFrame]:
    """:data:`BLOCKS` of every tier over ``nodes`` (``grp``, ``place``, ``n``, ``digest``), each tier written once."""
    width, found = fanout**height, []

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("place")
        last = bool(frame["n"].iloc[0] <= width)
        tree = grow(_words(b"".join(frame["digest"]), 8), fanout, None if last else height)
        levels = [_raw(x) for x in tree.levels]
        row = [frame["grp"].iloc[0], int(frame["place"].iloc[0]) // width, last, levels, [_raw(x) for x in tree.states], levels[-1]]
        return pd.DataFrame([row], columns=["grp", "block", "last", "levels", "states", "digest"])

    while True:
        rows = nodes.withColumn("block", F.floor(F.col("place") / width))
        counts = nodes.select("grp", F.floor(F.col("place") / width).alias("block"), F.ceil(F.col("n") / width).alias("n")).distinct()
        found.append(written(rows.groupBy("grp", "block").applyInPandas(build, BLOCKS), "tier"))
        rest = found[-1].where(~F.col("last"))
        if rest.isEmpty():
            return found
        nodes = rest.join(counts, ["grp", "block"]).select("grp", F.col("block").alias("place"), "n", "digest")


def node_paths(blocks: DataFrame, fanout: int) -> DataFrame:
    """:data:`NODE_PATHS`: of each node of ``blocks`` the path to its block's root."""
    size = fanout ** block_height(fanout)

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for row in frame.itertuples():
                tree = _stored(row, fanout)
                places = np.arange(len(tree.levels[0]))
                path = path_of(tree, places, fanout)
                columns = {name: [x.tobytes() for x in part] for name, part in zip(_STEPS, (path.slots, path.sizes, path.states.astype(">u4"), path.rights.astype(">u4")), strict=False)}
                yield pd.DataFrame({"grp": row.grp, "place": row.block * size + places, "block": row.block, **columns, "siblings": siblings(tree, places, fanout)})

    return blocks.mapInPandas(emit, NODE_PATHS)


def _joined(lower: DataFrame, upper: DataFrame, on: list[str], *keep: str) -> DataFrame:
    """Paths of ``lower`` continued by those of ``upper``."""
    more = upper.select(*on, *[F.col(c).alias(f"_{c}") for c in _STEPS], *[c for c in keep if c not in lower.columns])
    return lower.join(more, on).select(*keep, *[F.concat(c, f"_{c}").alias(c) for c in _STEPS])


def block_paths(found: list[DataFrame], fanout: int) -> DataFrame:
    """Of each block of the lowest tier the path from its root to its group's subroot, and that: ``grp``, ``block``, path, ``subroot``.

    Composed from the highest tier down; a tier has a row for each block of the one below.
    """
    none = [F.lit(b"").alias(c) for c in _STEPS[:4]] + [F.lit("").alias("siblings")]
    paths = None
    for tier in range(len(found) - 1, -1, -1):
        own = found[tier].where("last").select("grp", "block", *none, F.col("digest").alias("subroot"))
        if paths is not None:
            steps = node_paths(found[tier + 1], fanout)
            below = _joined(steps, paths, ["grp", "block"], "grp", "place", "subroot").withColumnRenamed("place", "block")
            own = own.unionByName(below)
        paths = written(own, "paths")
    return paths


def block_height(fanout: int, block: int | None = None) -> int:
    """Levels of a block of at most ``block`` nodes; at least one."""
    height = 1
    while fanout ** (height + 1) <= (block or BLOCK):
        height += 1
    return height


class Manifest(NamedTuple):
    """``rows``: the given columns with ``grp``, ``place`` and ``block`` of each leaf; ``blocks``: :data:`BLOCKS` of the leaves with
    the path from the block to the root, ``subroot`` and ``root``."""

    rows: DataFrame
    blocks: DataFrame
    fanout: int


def build_manifest(rows: DataFrame, order: str, fanout: int = FANOUT) -> Manifest:
    """The manifest of ``rows`` (``grp``, ``order``, ``leaf``, others), which must read the same again.

    Groups are ordered by ``grp`` bytewise. Rows of one ``order`` value, null first, are ordered by their leaf; equal
    leaves stand side by side. An empty table gives an empty manifest.
    """
    height = block_height(fanout)
    width = fanout**height
    leaves = written(rows.withColumn("_row", F.monotonically_increasing_id()), "leaves")
    leaves = placed(leaves, order, "leaf", "_row").withColumn("block", F.floor(F.col("place") / width))
    found = tiers(leaves.select("grp", "place", "n", F.col("leaf").alias("digest")), fanout, height)
    paths = block_paths(found, fanout)
    groups = paths.where("block = 0").select(F.lit("").alias("grp"), F.col("grp").alias("member"), F.col("subroot").alias("digest"))
    groups = placed(groups, "member")
    top = tiers(groups.select("grp", "place", "n", "digest"), fanout, height)
    steps = _joined(node_paths(top[0], fanout), block_paths(top, fanout), ["grp", "block"], "place", "subroot")
    heads = written(groups.select("place", "member").join(steps, "place").withColumnRenamed("subroot", "root").withColumnRenamed("member", "grp"), "heads")
    more = heads.select("grp", "root", *[F.col(c).alias(f"_{c}") for c in _STEPS])
    met = join_unique(paths, more, "grp", few=heads.count() <= BROADCAST_OFFSETS)
    above = met.select("grp", "block", "subroot", "root", *[F.concat(c, f"_{c}").alias(f"up_{c}") for c in _STEPS])
    return Manifest(leaves, written(found[0].join(above, ["grp", "block"]), "manifest"), fanout)


def verify(manifest: Manifest, key: str, changed: str) -> DataFrame:
    """Of every row: ``key``, ``leaf``, ``subroot``, ``root``, ``proof`` (siblings as text) and ``folded_root``.

    The last is the root with the digest in column ``changed`` in the leaf's place, and nothing else changed. A block
    meets its rows in one group. Digests are lower-case hexadecimal text.
    """
    fanout = manifest.fanout
    width = fanout ** block_height(fanout)

    def run(frame: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        row = block.iloc[0]
        tree, places = _stored(row, fanout), (frame["place"] % width).to_numpy()
        inner = fold(_words(b"".join(frame["changed"]), 8), path_of(tree, places, fanout))
        # Above the block only its root matters, which unchanged leaves leave as it is.
        kinds, back = np.unique(inner, axis=0, return_inverse=True)
        m, high = len(kinds), len(row.up_slots)
        flat = lambda raw, *shape: np.broadcast_to(_words(raw, *shape)[None], (m, high, *shape))
        byte = lambda raw: np.broadcast_to(np.frombuffer(raw, np.uint8)[None], (m, high))
        up = Path(byte(row.up_slots), byte(row.up_sizes), flat(row.up_states, 8), flat(row.up_rights, fanout - 1, 8))
        folded = [_raw(x).hex() for x in fold(kinds, up)]
        proofs = [s + row.up_siblings for s in siblings(tree, places, fanout)]
        return pd.DataFrame({"key": frame["key"], "leaf": [x.hex() for x in frame["leaf"]], "subroot": row.subroot.hex(), "root": row.root.hex(), "proof": proofs, "folded_root": [folded[i] for i in back.ravel()]})

    kind = dict(manifest.rows.dtypes)[key]
    rows = manifest.rows.select("grp", "block", "place", F.col(key).alias("key"), "leaf", F.col(changed).alias("changed"))
    met = rows.groupBy("grp", "block").cogroup(manifest.blocks.groupBy("grp", "block"))
    found = met.applyInPandas(run, f"key {kind}, leaf string, subroot string, root string, proof string, folded_root string")
    return found.withColumnRenamed("key", key)


def document_manifest(docs: DataFrame) -> DataFrame:
    """Leaf, roots and proof of every document, and whether its row still folds to the root after tampering.

    Tampering adds 1 to ``n_chars`` where 7 divides the CRC-32 of the decimal id. One row per row of ``docs``: null
    fields hash as ``-``; a null id or ``n_chars`` is not tampered with; a null language is a group, the first; rows that
    repeat are leaves of their own, side by side. Other columns are ignored. An empty table gives no rows.
    """
    fields = [F.col(c) for c in FIELDS]
    more = [F.col(c).cast("decimal(20,0)") + 1 if c == "n_chars" else F.col(c) for c in FIELDS]
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False)) & F.col("n_chars").isNotNull()
    own = leaf(*fields)
    rows = docs.select(
        F.coalesce(F.concat(F.lit("1"), F.col("lang")), F.lit("0")).alias("grp"), F.col("doc_id").alias("doc_id"), own.alias("leaf"), F.when(tampered, leaf(*more)).otherwise(own).alias("changed")
    )
    found = verify(build_manifest(rows, "doc_id"), "doc_id", "changed")
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
