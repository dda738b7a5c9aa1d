"""Connected components of links between documents, as DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewell.llm.session import cut
from gaugewell.llm.spread import join_unique

#: Labels up to which they are broadcast; past that only those that many rows ask for are.
BROADCAST_LABELS = 1_000_000


def connected(links: DataFrame) -> DataFrame:
    """``doc_id`` and ``component_id`` (the smallest id it reaches) of every end of ``links`` (columns a, b).

    Every round takes the smallest label among the neighbours and then that label's own label; rounds end when no
    label changes. Labels are asked for by neighbour and by label, where the centre of a large group is asked for by
    all of it: see :func:`join_unique`. Each round's labels are checkpointed in the shared folder. Only counts reach
    the driver.
    """
    ends = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(ends.groupBy(F.col("a").alias("doc_id")).agg(F.least(F.min("b"), F.first("a")).alias("component_id")))
    few = labels.count() <= BROADCAST_LABELS
    while True:
        of_b = labels.select(F.col("doc_id").alias("b"), F.col("component_id").alias("label"))
        least = join_unique(ends, of_b, "b", few=few).groupBy(F.col("a").alias("doc_id")).agg(F.min("label").alias("label"))
        near = labels.join(least, "doc_id").select("doc_id", F.col("component_id").alias("was"), F.least("component_id", "label").alias("now"))
        near = near if few else cut(near)
        own = near.select(F.col("doc_id").alias("now"), F.col("now").alias("further"))
        stepped = cut(join_unique(near, own, "now", few=few).select("doc_id", "was", F.col("further").alias("component_id")))
        labels = stepped.select("doc_id", "component_id")
        if stepped.where(F.col("was") != F.col("component_id")).isEmpty():
            return labels
