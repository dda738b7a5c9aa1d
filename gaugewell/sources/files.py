"""Sources and sinks: wide rows, projections by name, files written and read back, registries."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, also set for checkpoints; a fresh local one where none is set.

    The latter only on a local master, as in tests: elsewhere executors would not see it, and ValueError is raised.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="gaugewell-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def cut(rows: DataFrame) -> DataFrame:
    """``rows`` checkpointed in the shared folder, so that their lineage ends there."""
    shared_folder(rows.sparkSession)
    return rows.checkpoint(eager=True)


def explode_wide(rows: DataFrame, key: str, lists: dict[str, str]) -> DataFrame:
    """One row per 0-based ``pos`` of parallel comma lists, cut to the shortest; values stay text."""
    split = {name: F.split(column, ",") for name, column in lists.items()}
    size = F.least(*[F.size(x) for x in split.values()]) if len(split) > 1 else F.size(next(iter(split.values())))
    zipped = F.arrays_zip(*[F.slice(x, 1, size).alias(name) for name, x in split.items()])
    return rows.select(key, F.posexplode(zipped).alias("pos", "z")).select(key, "pos", *[F.col(f"z.{name}").alias(name) for name in split])


#: A nested item; types are read as text, so that 1 and "1" are one.
NESTED = "map<string, struct<content: string, type: string, options: map<string, string>, kc_routes: array<string>, answer: string>>"


def nested_items(rows: DataFrame, column: str) -> DataFrame:
    """Items of JSON objects keyed by item: item, text, item_format, answer_options, answer, concept_ids, primary_concept.

    A missing or null key gives empty text, no concepts, null options and the format ``fill_in``; the type 1, ``"1"`` or
    ``"multiple_choice"`` gives ``multiple_choice``; the last of an item's routes is its primary concept. A text that is no such
    object gives no rows. Keys must be whole numbers: others give a null item.
    """
    each = rows.select(F.explode(F.from_json(column, NESTED)).alias("_key", "_q")).select(F.expr("try_cast(_key AS BIGINT)").alias("item"), "_q.*")
    routes = F.filter(F.coalesce("kc_routes", F.array().cast("array<string>")), lambda r: r.isNotNull())
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return each.select(
        "item", F.regexp_replace(blank("content"), r"^\s+|\s+$", "").alias("text"), F.when(F.col("type").isin("1", "multiple_choice"), "multiple_choice").otherwise("fill_in").alias("item_format"),
        F.when(F.size("options") > 0, F.to_json("options")).alias("answer_options"), blank("answer").alias("answer"), F.array_join(routes, "|").alias("concept_ids"), F.coalesce(F.try_element_at(routes, F.lit(-1)), F.lit("")).alias("primary_concept"),
    )


def allowed(rows: DataFrame, names: tuple[str, ...], denied: tuple[str, ...] = ()) -> DataFrame:
    """Exactly the columns ``names``; ValueError if one is missing or a denied one is present."""
    missing, present = set(names) - set(rows.columns), set(denied) & set(rows.columns)
    if missing or present:
        raise ValueError(f"missing columns {sorted(missing)}, denied columns {sorted(present)}")
    return rows.select(*names)


def crosswalk(rows: DataFrame, names: dict[str, tuple[str, ...]]) -> DataFrame:
    """Canonical columns from the first source name that is present, in any case; ValueError if none is."""
    there = {c.lower(): c for c in rows.columns}
    found = {name: next((there[s.lower()] for s in sources if s.lower() in there), None) for name, sources in names.items()}
    if None in found.values():
        raise ValueError(f"no source for {sorted(k for k, v in found.items() if v is None)}")
    return rows.select(*[F.col(c).alias(name) for name, c in found.items()])


def round_trip(rows: DataFrame, kind: str, name: str, *partition: str, **options: str) -> DataFrame:
    """``rows`` written in a format under the shared folder and read back with their schema."""
    path = f"{shared_folder(rows.sparkSession)}/{name}"
    rows.write.options(**options).partitionBy(*partition).format(kind).save(path)
    return rows.sparkSession.read.schema(rows.schema).options(**options).format(kind).load(path)


def upsert(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Both registries, one row per ``key``: that with the largest ``order``."""
    both = old.unionByName(new)
    return both.groupBy(key).agg(F.max_by(F.struct(*[c for c in both.columns if c != key]), order).alias("last")).select(key, "last.*")
