"""Connected components of a table of links, by label passing with pointer jumping over shuffles."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tramorisk.llm.store import stored


def components(links: DataFrame) -> DataFrame:
    """Links (``a``, ``b``: long, one or both directions) to (``node``, ``label``: smallest node reachable).

    Each round takes the smallest label next door and then the label of the
    label. Rounds end when none changes; a long chain needs about the logarithm of its length.
    """
    edges = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    labels = stored(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")))
    while True:
        near = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("_near"))
        stepped = labels.join(near, "node", "left").select("node", F.col("label").alias("_old"), F.least("label", F.coalesce("_near", "label")).alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("_jump"))
        now = stored(stepped.join(jump, "label", "left").select("node", "_old", F.least("label", F.coalesce("_jump", "label")).alias("label")))
        labels = now.select("node", "label")
        if now.filter("label <> _old").isEmpty():
            return labels
