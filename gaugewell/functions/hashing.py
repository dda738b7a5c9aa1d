"""Hash keys, hash-ordered ranks and hash draws: every random choice is a documented hash of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hashed(*parts: Column | str | int) -> Column:
    """SHA-256 of the parts, cast to text and joined by ``|``; strings name columns, other values are literals."""
    cols = [p if isinstance(p, Column) else F.col(p) if isinstance(p, str) else F.lit(p) for p in parts]
    return F.sha2(F.concat_ws("|", *[c.cast("string") for c in cols]), 256)


def hash_number(digest: Column, digits: int = 8) -> Column:
    """The first hexadecimal digits of a digest as a number."""
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("long")


def hash_unit(digest: Column, steps: int = 1000) -> Column:
    """A number in [0, 1) in so many steps."""
    return (hash_number(digest) % steps) / F.lit(float(steps))


def hash_rank(rows: DataFrame, digest: Column, *ties: str, name: str = "rank", cell: tuple[str, ...] = ()) -> DataFrame:
    """0-based rank of every row by ``digest``, then ``ties``, over the whole table or each cell, and without one task for all.

    Rows are cut into 4096 buckets by the digest's first digits; bucket counts give offsets, a window in each
    bucket the rest. The only window over a whole table or cell is over the bucket counts.
    """
    keyed = rows.withColumn("_digest", digest).withColumn("_bucket", F.substring("_digest", 1, 3))
    counts = keyed.groupBy(*cell, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select(*cell, "_bucket", (F.sum("_n").over(Window.partitionBy(*cell).orderBy("_bucket")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*cell, "_bucket").orderBy("_digest", *ties)) - 1
    return keyed.withColumn("_inside", inside).join(before, [*cell, "_bucket"]).withColumn(name, F.col("_before") + F.col("_inside")).drop("_digest", "_bucket", "_inside", "_before")


def table_fingerprint(rows: DataFrame) -> DataFrame:
    """Row count and an order-free content hash: the sum of 48-bit numbers of each row's SHA-256, modulo 2**60."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in rows.columns])
    number = F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("decimal(38,0)")
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), (F.coalesce(F.sum(number), F.lit(0)) % F.lit(1 << 60).cast("decimal(38,0)")).cast("long").alias("content"))
