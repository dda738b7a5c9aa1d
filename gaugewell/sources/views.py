"""Canonical views over the given tables, each as a DataFrame and as SQL for the oracles.

``ix`` are learner-item interactions from ``events``, ``ix_big`` the same shape from ``lineitem``, ``split`` assigns
learners to train, val and test, ``scores`` are two difficulty scores per item, ``pred`` a prediction table.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugewell.functions.hashing import hash_rank, hash_unit, hashed

SEED = 2024
TRAIN, VAL = 0.7, 0.1
CONDITIONS = ("base", "score", "random", "length")
SEEDS = (1, 2, 3, 4, 5)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interactions: learner, item, event_id, ts, correct, response_time, hint_used."""
    e = table(spark, sf_dir, "events")
    item = F.regexp_extract("props", r"([0-9]+)", 1).cast("long")
    correct = F.when(F.col("event_type") == "error", 0).otherwise(1)
    return e.select(F.col("user_id").alias("learner"), item.alias("item"), "event_id", "ts", correct.alias("correct"), F.col("value").alias("response_time"), (F.col("event_type") == "view").alias("hint_used"))


def ix_big(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large interactions: learner, item, correct; without a row key."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    both = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    return both.select(F.col("o_custkey").alias("learner"), F.col("l_partkey").alias("item"), F.when(F.col("l_returnflag") == "R", 0).otherwise(1).alias("correct"))


def learner_split(learners: DataFrame, seed: int = SEED, train: float = TRAIN, val: float = VAL) -> DataFrame:
    """``learner`` and ``split``: hash order, the first floor(train * n) train, the next floor(val * n) val, the rest test."""
    ranked = hash_rank(learners.select("learner").distinct(), hashed(seed, "learner"), "learner")
    n = learners.select("learner").distinct().agg(F.count(F.lit(1)).alias("n"))
    # Exact decimals: 90,000 * 0.7 is 62,999.99... as a double.
    first, second = (F.floor(F.col("n") * F.lit(Decimal(str(share)))) for share in (train, val))
    second = first + second
    split = F.when(F.col("rank") < first, "train").when(F.col("rank") < second, "val").otherwise("test")
    return ranked.crossJoin(F.broadcast(n)).select("learner", split.alias("split"))  # one row is broadcast


def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split of the learners of ``ix``."""
    return learner_split(ix(spark, sf_dir))


def ixs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ix`` with the split of its learner."""
    return ix(spark, sf_dir).join(split(spark, sf_dir), "learner")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difficulty scores in [0, 1]: item, model, score."""
    p = table(spark, sf_dir, "part")
    edge = p.agg(F.min("p_retailprice").alias("low"), F.max("p_retailprice").alias("high"))
    both = p.crossJoin(F.broadcast(edge)).select(F.col("p_partkey").alias("item"), (F.col("p_size") / 50.0).alias("a"), ((F.col("p_retailprice") - F.col("low")) / (F.col("high") - F.col("low"))).alias("b"))
    return both.select("item", F.expr("stack(2, 'model_a', a, 'model_b', b) AS (model, score)"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items: item, text, domain, format, size, price."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("item"), F.col("p_name").alias("text"), F.col("p_type").alias("domain"), F.col("p_brand").alias("format"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"))


def concept(item: str = "item"):
    """The concept of an item: c0 to c8, blank for items that end in 9."""
    return F.when(F.pmod(F.col(item), F.lit(10)) == 9, "").otherwise(F.concat(F.lit("c"), F.pmod(F.col(item), F.lit(10)).cast("string")))


def pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions: condition, seed, fold, learner, item, event_id, y, p."""
    rows = ixs(spark, sf_dir).where("split = 'test'").select("learner", "item", "event_id", F.col("correct").alias("y"), "response_time")
    a = scores(spark, sf_dir).where("model = 'model_a'").select("item", "score")
    grid = F.array(*[F.struct(F.lit(c).alias("condition"), F.lit(s).alias("seed")) for c in CONDITIONS for s in SEEDS])
    rows = rows.join(a, "item").select("*", F.inline(grid))
    u, v = hash_unit(hashed("item")), hash_unit(hashed("event_id", "condition", "seed"))
    mean = F.when(F.col("condition") == "base", 0.8).when(F.col("condition") == "score", 0.9 - 0.2 * F.col("score")).when(F.col("condition") == "random", 0.7 + 0.2 * u).otherwise(0.7 + 0.2 * (F.col("response_time") / 500.0))
    p = F.least(F.greatest(mean + (v - 0.5) / 100.0, F.lit(0.0)), F.lit(1.0))
    return rows.select("condition", "seed", F.pmod("item", F.lit(5)).cast("int").alias("fold"), "learner", "item", "event_id", "y", p.alias("p"))


_HEX = "CAST('0x' || substr({}, 1, 8) AS BIGINT) % 1000 / 1000.0::DOUBLE"
#: SQL of the views; each may use those before it.
SQL = {
    "ix": "SELECT user_id AS learner, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS item, event_id, ts, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS correct, value AS response_time, event_type = 'view' AS hint_used FROM events",
    "ix_big": "SELECT o_custkey AS learner, l_partkey AS item, CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS correct FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "split": f"SELECT learner, CASE WHEN r < floor(n * {TRAIN}) THEN 'train' WHEN r < floor(n * {TRAIN}) + floor(n * {VAL}) THEN 'val' ELSE 'test' END AS split FROM (SELECT learner, row_number() OVER (ORDER BY sha256('{SEED}|' || learner), learner) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT learner FROM ix))",
    "ixs": "SELECT ix.*, split FROM ix JOIN split USING (learner)",
    "scores": "SELECT p_partkey AS item, 'model_a' AS model, p_size / 50.0::DOUBLE AS score FROM part UNION ALL SELECT p_partkey, 'model_b', (p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()) FROM part",
    "items": "SELECT p_partkey AS item, p_name AS text, p_type AS domain, p_brand AS format, p_size AS size, p_retailprice AS price FROM part",
    "pred": "SELECT condition, seed, CAST(item % 5 AS INT) AS fold, learner, item, event_id, y, least(greatest(mean + (v - 0.5) / 100.0::DOUBLE, 0.0), 1.0)::DOUBLE AS p FROM (SELECT *, CASE condition WHEN 'base' THEN 0.8::DOUBLE WHEN 'score' THEN 0.9::DOUBLE - 0.2::DOUBLE * score WHEN 'random' THEN 0.7::DOUBLE + 0.2::DOUBLE * u ELSE 0.7::DOUBLE + 0.2::DOUBLE * (response_time / 500.0::DOUBLE) END AS mean "
    + f"FROM (SELECT ixs.learner, ixs.item, event_id, correct AS y, response_time, score, condition, seed, {_HEX.format('sha256(ixs.item::VARCHAR)')} AS u, {_HEX.format(chr(115) + 'ha256(event_id || ' + repr('|') + ' || condition || ' + repr('|') + ' || seed)')} AS v "
    + "FROM ixs JOIN scores ON ixs.item = scores.item AND model = 'model_a', (SELECT unnest(['base', 'score', 'random', 'length']) AS condition), (SELECT unnest([1, 2, 3, 4, 5]) AS seed) WHERE split = 'test'))",
}


def sql(body: str, *views: str, **more: str) -> str:
    """``body`` after the definitions of ``views`` and all that they use, and of ``more``."""
    needs = {"split": ("ix",), "ixs": ("ix", "split"), "pred": ("ix", "split", "ixs", "scores")}
    wanted = {v for name in views for v in (*needs.get(name, ()), name)}
    parts = [f"{name} AS (SELECT * FROM ({text}))" for name, text in SQL.items() if name in wanted] + [f"{name} AS ({text})" for name, text in more.items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body
