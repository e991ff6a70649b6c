"""Components of link tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessera.session import discard, is_empty, stored


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each node of the links reaches. Links with a null end are no links; none give no rows.

    Each round a node takes the smallest label around it, then the label of that node, so labels travel twice as far as the round
    before. A round's labels are written; nothing of the graph goes to the driver.
    """
    ends = links.select(F.col(a).alias("node"), F.col(b).alias("other")).where("node IS NOT NULL AND other IS NOT NULL")
    ends = stored(ends.union(ends.select("other", "node")).distinct(), "graph-ends")
    labels = stored(ends.groupBy("node").agg(F.min("other").alias("low")).select("node", F.least("node", "low").alias("component")), "graph-labels")
    while True:
        around = ends.join(labels.select(F.col("node").alias("other"), F.col("component").alias("near")), "other").groupBy("node").agg(F.min("near").alias("near"))
        nearer = stored(labels.join(around, "node").select("node", F.least("component", "near").alias("component"), F.col("component").alias("before")), "graph-nearer")
        jump = nearer.select(F.col("node").alias("component"), F.col("component").alias("far"))
        new = stored(nearer.join(jump, "component").select("node", F.least("component", "far").alias("component"), "before"), "graph-labels")
        discard(labels, nearer)
        labels = new.select("node", "component")
        if is_empty(new.where("component <> before")):
            discard(ends)
            return labels
