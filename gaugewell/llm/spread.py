"""Joins with a side whose keys may be as uneven as it likes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewell.llm.session import cut

#: A key is hot when more than one row in so many has it; so there are fewer hot keys than that.
HOT = 1000


def hot_keys(rows: DataFrame, key: str) -> DataFrame:
    """The keys of more than one row in :data:`HOT`: fewer than :data:`HOT` rows, whatever the input."""
    counts = cut(rows.groupBy(key).count())
    total = counts.agg(F.sum("count")).first()[0] or 0
    return counts.where((F.col("count") * HOT > total) & F.col(key).isNotNull()).select(key)


def join_unique(left: DataFrame, right: DataFrame, key: str, how: str = "inner", few: bool = False) -> DataFrame:
    """``left`` joined with ``right``, which has each ``key`` at most once and whose plan is cut.

    Where ``few`` says that ``right`` is small it is broadcast whole. Else what it has for the hot keys of ``left`` is
    broadcast (under :data:`HOT` rows), and the rows of all other keys meet theirs by shuffle, so that no task gets
    more than a small share of ``left``, whatever its largest key. ``how`` is inner, left or left_semi.
    """
    if few:
        return left.join(F.broadcast(right), key, how)
    hot = cut(hot_keys(left, key))
    own = cut(right.join(F.broadcast(hot), key, "left_semi"))
    often = left.join(F.broadcast(hot), key, "left_semi").join(F.broadcast(own), key, how)
    rest = left.join(F.broadcast(hot), key, "left_anti").join(right, key, how)
    return often.unionByName(rest)
