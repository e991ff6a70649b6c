"""Connected components of an edge table, as joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessera.session import discard, is_empty, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, of every node in edges (a long, b long).

    Rounds of: each node takes the smallest label among its own and its neighbours', then the
    label of its label (pointer jumping), until nothing changes. A round's table is written to the
    shared folder. No link or label goes to the driver. No edges give no rows.
    """
    both = stored(edges.selectExpr("a AS node", "b AS other").union(edges.selectExpr("b AS node", "a AS other")).distinct(), "cc-edges")
    labels = stored(both.groupBy("node").agg(F.least("node", F.min("other")).alias("component")), "cc-labels")
    while True:
        offered = both.join(labels.selectExpr("node AS other", "component AS theirs"), "other").groupBy("node").agg(F.min("theirs").alias("theirs"))
        spread = stored(labels.join(offered, "node").select("node", F.least("component", "theirs").alias("component"), F.col("component").alias("was")), "cc-spread")
        jumped = spread.join(spread.selectExpr("node AS component", "component AS beyond"), "component").select("node", F.least("component", "beyond").alias("component"), "was")
        new = stored(jumped, "cc-labels")
        discard(spread, labels)
        if is_empty(new.where("component < was")):
            discard(both)
            return new.select("node", "component")
        labels = new.select("node", "component")
