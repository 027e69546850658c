"""Connected components of an undirected graph held in a DataFrame of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, settled


def connected(edges: DataFrame) -> DataFrame:
    """(a, b) edges to (id, component): each vertex with the smallest id reachable from it.

    Rounds of taking the smallest label around a vertex and then that label's own label (pointer jumping), each
    written to the shared folder; edges and labels stay distributed. No edges give no rows.
    """
    both = settled(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = settled(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("component")).select("id", "component"))
    while True:
        around = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("component").alias("least"))
        lower = settled(labels.join(around, labels["id"] == around["a"]).select("id", F.least("component", "least").alias("component"), F.col("component").alias("old")))
        of = lower.select(F.col("id").alias("label"), F.col("component").alias("its"))
        before, labels = labels, settled(lower.join(of, lower["component"] == of["label"]).select("id", F.col("its").alias("component"), (F.col("its") != F.col("old")).alias("moved")))
        forget(before, lower)
        if not labels.where("moved").limit(1).count():
            forget(both)
            return labels.select("id", "component")
