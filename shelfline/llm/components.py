"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.session import stage


def components(links: DataFrame) -> DataFrame:
    """`node, root` of every node of `links` (columns `a`, `b`): the smallest node it can reach.

    Every round takes the smallest label among a node's neighbours, then the label of the label, so that long
    chains halve. Rounds end when no label changes; each is a written table.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stage(both.filter("a <> b").distinct(), "links")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        low = labels.join(near, "node").select("node", F.least("root", "near").alias("next"), F.col("root").alias("was"))
        up = labels.select(F.col("node").alias("next"), F.col("root").alias("jump"))
        labels = stage(low.join(up, "next").select("node", F.least("next", "jump").alias("root"), "was"), "labels")
        if labels.filter("root <> was").isEmpty():
            return labels.select("node", "root")
