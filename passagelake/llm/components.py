"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagelake.session import materialise


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) of every node of the links ``a, b``.

    Every round takes the smallest label among the neighbours and then follows the label's own label, so the
    rounds grow with the logarithm of the longest path. Each round is stored, which cuts the lineage; a node with
    very many links is met by a partial minimum before the shuffle, and joins run against stored tables, whose
    hot keys Spark can split. The files of a round follow the number of links, not of shuffle partitions.
    """
    ways = [F.struct(F.col(x).alias("node"), F.col(y).alias("other")) for x, y in ("ab", "ba")]
    both = materialise(links.select(F.inline(F.array(*ways))), "links")
    rows = both.count()
    labels = materialise(both.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("component")), "labels", rows)
    while True:
        near = materialise(
            both.join(labels.select(F.col("node").alias("other"), "component"), "other").groupBy("node").agg(F.min("component").alias("near")), "labels-near", rows
        )
        lower = materialise(labels.join(near, "node", "left").select("node", F.col("component").alias("before"), F.least("component", "near").alias("component")), "labels-lower", rows)
        # The label's own label, where it has one: a label is always a node of the same component.
        own = lower.select(F.col("node").alias("_label"), F.col("component").alias("_next"))
        labels = materialise(
            lower.join(own, F.col("component") == F.col("_label"), "left").select("node", "before", F.least("component", "_next").alias("component")), "labels", rows
        )
        if labels.where("component <> before").isEmpty():
            return labels.select("node", "component")
        labels = labels.select("node", "component")
