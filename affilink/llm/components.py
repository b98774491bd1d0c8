"""Connected components of a table of links, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affilink.llm.shared import dropped, written


def connected(spark: SparkSession, links: DataFrame) -> tuple[DataFrame, str]:
    """(node, component): component is the smallest node reachable over links (a, b). Nodes without a link are left out.

    Each round lets a node take the smallest label among its neighbours and then its label's label, so a component of
    diameter d needs about log d rounds. A round is written to the shared folder; nothing is collected but a count.
    Sums over a node's links are pre-aggregated, so a node with very many links is no burden to one task.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both, both_path = written(spark, both, "links")
    labels, path = written(spark, both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("m"))
        best = labels.join(near, labels.node == near.a).select("node", F.col("component").alias("old"), F.least("component", "m").alias("up"))
        jump = labels.select(F.col("node").alias("up"), F.col("component").alias("over"))
        step = best.join(jump, "up").select("node", "old", F.least("up", "over").alias("component"))
        step, step_path = written(spark, step, "labels")
        changed = step.filter("old <> component").limit(1).count()
        dropped(spark, path)
        labels, path = step.select("node", "component"), step_path
        if not changed:
            dropped(spark, both_path)
            return labels, path
