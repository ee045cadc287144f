"""Connected components of a link table, as joins: min-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitgrid.plans.ordered import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges(a, b)``: the smallest node it reaches.

    Every round takes the smallest label among a node's neighbours and then the label of its
    label, so the rounds grow with the logarithm of the longest path on most graphs. Rounds are
    written tables. A node with very many links only lengthens the side that Spark can split.
    """
    both = materialize(edges.where(F.col("a") != F.col("b")).select("a", "b")
                       .union(edges.where(F.col("a") != F.col("b")).select("b", "a")).distinct())
    labels = materialize(both.groupBy(F.col("a").alias("node"))
                         .agg(F.least(F.col("node"), F.min("b")).alias("label")))
    while True:
        near = (both.join(labels, both["b"] == labels["node"]).groupBy(both["a"])
                .agg(F.min("label").alias("near")))
        hooked = materialize(labels.join(near, labels["node"] == near["a"])
                             .select("node", F.least("label", "near").alias("label"), F.col("label").alias("old")))
        up = hooked.select(F.col("node").alias("up"), F.col("label").alias("top"))
        jumped = materialize(hooked.join(up, hooked["label"] == up["up"])
                             .select("node", F.col("top").alias("label"), (F.col("top") != F.col("old")).alias("moved")))
        labels = jumped.select("node", "label")
        if jumped.where("moved").isEmpty():
            return labels
