"""Connected components of a graph given as links, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from towline.llm.common import staged


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component``: for every node of the links the smallest node it is connected with.

    Each round gives a node the smallest label among its neighbours and then the label of that label, so the rounds grow
    with the logarithm of a component's width. Only minima are aggregated: a node with very many links is no hot group.
    Labels are written to the shared folder after each round. Links with a null end are ignored.
    """
    clean = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    both = staged(clean.unionByName(clean.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(
            F.min("component").alias("near")
        )
        lower = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("component").alias("farther"))
        step = staged(
            lower.join(jump, "new", "left").select("node", "old", F.least("new", F.coalesce("farther", "new")).alias("component"))
        )
        changed = step.where("component <> old").limit(1).count()
        labels = step.select("node", "component")
        if not changed:
            return labels
