"""Connected components by minimum labels and pointer jumping; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import written


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges: a, b (bigint). For each node: node, root (the smallest node it is connected with).

    A round gives each node the smallest label among its neighbours' and then its label's label, so the
    rounds grow with the logarithm of a component's width; each is written before the next.
    """
    edges = edges.select("a", "b").where("a <> b").distinct()
    both = written(edges.union(edges.select("b", "a")), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    for _ in range(most_rounds):
        seen = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("n")).agg(F.min("root").alias("near"))
        closer = labels.join(seen, labels["node"] == seen["n"]).select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        closer = written(closer, "closer")
        jump = closer.select(F.col("node").alias("at"), F.col("root").alias("further"))
        after = written(closer.join(jump, closer["root"] == jump["at"], "left").select("node", "old", F.least("root", F.coalesce("further", "root")).alias("root")), "labels")
        labels = after.select("node", "root")
        if after.where("root <> old").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
