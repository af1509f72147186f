"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gradeloom.session import cut


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every end of a link (a, b); label is the smallest node of its component.

    Each round every node takes the smallest label among its neighbours, then the label of its label, so
    labels cross long chains in few rounds. Minima are aggregated before the shuffle; no group is ever
    gathered. The tables of each round are written to the shared folder.
    """
    pairs = links.where(F.col("a") != F.col("b")).select("a", "b")
    edges = cut(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(edges.groupBy("a").agg(F.min("b").alias("least")).select(
        F.col("a").alias("node"), F.least("a", "least").alias("label")))
    while True:
        near = edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        lower = cut(labels.join(near, labels["node"] == near["a"]).select(
            "node", "label", F.least("label", "near").alias("new")))
        jump = lower.select(F.col("node").alias("via"), F.col("new").alias("far"))
        following = cut(lower.join(jump, lower["new"] == jump["via"], "left").select(
            "node", "label", F.least("new", "far").alias("new")))
        if not following.where(F.col("new") != F.col("label")).head(1):
            return labels
        labels = following.select("node", F.col("new").alias("label"))
