"""Connected components of a graph given as pairs of ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfold.llm.frames import emptied, written


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in edges (a, b): the smallest id that can be reached.

    Every node takes the smallest label among its neighbours, then the label of its label, until
    nothing changes; paths halve, so rounds grow with the logarithm of the diameter. Labels are
    written to the shared folder after each step, which keeps the two sides of every join separate
    (a node with very many links is split by adaptive execution) and the lineage short. Repeated
    edges and loops change nothing; without edges there are no rows.
    """
    edges = written(edges.select("a", "b").filter("a <> b").distinct())
    nodes = edges.select(F.explode(F.array("a", "b")).alias("id"))
    labels = written(nodes.groupBy("id").agg(F.col("id").alias("component")))
    while True:
        from_a = edges.join(labels.withColumnRenamed("id", "a"), "a").select(F.col("b").alias("id"), "component")
        from_b = edges.join(labels.withColumnRenamed("id", "b"), "b").select(F.col("a").alias("id"), "component")
        least = written(from_a.unionByName(from_b).unionByName(labels).groupBy("id").agg(F.min("component").alias("near")))
        up = labels.select(F.col("id").alias("near"), F.col("component").alias("far"))
        jumped = written(least.join(up, "near").select("id", F.least("near", "far").alias("component")))
        old = labels.select("id", F.col("component").alias("old"))
        done = jumped.join(old, "id").filter("component <> old").isEmpty()
        emptied(labels, least)
        labels = jumped
        if done:
            emptied(edges)
            return labels
