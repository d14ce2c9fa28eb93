"""Which entity each merged one has become, after all decisions in their order.

A decision (a, b) that is accepted makes `b` an alias of what `a` is by then. `b` is gone from then on, so a later decision about it
changes nothing; nor does one by which an entity would become its own alias. Rejected decisions change nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scratch import kept


def _followed(steps: DataFrame, nodes: int) -> DataFrame:
    """steps: node, up, step, one row a node. For each node: up (the end of its way, if it has one), late (the latest step on it), done (false on and before circles).

    Ways are followed by doubling, so rounds grow with the logarithm of their length.
    """
    ways = kept(steps.select("node", "up", F.col("step").alias("late"), F.lit(False).alias("done")), "ways")
    for rounds in range(nodes.bit_length() + 1):
        going = ways.where("not done")
        if going.isEmpty():
            break
        further = ways.select(F.col("node").alias("_n"), F.col("up").alias("_u"), F.col("late").alias("_l"), F.col("done").alias("_d"))
        # many ways may meet in one node, whose row is one: adaptive execution splits such a join
        moved = going.join(further, F.col("up") == F.col("_n"), "left").select("node", F.coalesce("_u", "up").alias("up"), F.greatest("late", F.coalesce("_l", "late")).alias("late"), F.coalesce("_d", F.lit(True)).alias("done"))
        ways = kept(moved.unionByName(ways.where("done")), "ways")
    return ways


def roots(decisions: DataFrame) -> DataFrame:
    """decisions: a, b, state and, if they have an order, decided_at. For each entity that is gone: id, root (never gone itself)."""
    if "decided_at" not in decisions.columns:
        decisions = decisions.withColumn("decided_at", F.lit(0))
    accepted = decisions.where("state = 'merged' and a <> b").select(F.col("b").alias("node"), F.col("a").alias("up"), F.struct("decided_at", "a", "b").alias("step")).distinct()
    turns = kept(accepted.withColumn("turn", F.row_number().over(Window.partitionBy("node").orderBy("step"))), "turns")
    steps = turns.where("turn = 1")
    nodes = steps.count()
    while True:
        ways = _followed(steps, nodes)
        # after so many rounds a way that has not ended stands on a circle; the circle's latest step was the one without effect
        circle = ways.where("not done").select(F.col("up").alias("_c")).distinct()
        if circle.isEmpty():
            return ways.select(F.col("node").alias("id"), F.col("up").alias("root"))
        latest = ways.join(circle, F.col("node") == F.col("_c"), "left_semi").select(F.col("node").alias("_c"), F.col("late").alias("_l"))
        void = steps.join(latest, (F.col("node") == F.col("_c")) & (F.col("step") == F.col("_l")), "left_semi").select(F.col("node").alias("_v"), F.col("turn").alias("_t"))
        rest = steps.join(void, F.col("node") == F.col("_v"), "left_anti")
        again = turns.join(void, (F.col("node") == F.col("_v")) & (F.col("turn") == F.col("_t") + 1)).drop("_v", "_t")
        steps = kept(rest.unionByName(again), "steps")


def renamed(rows: DataFrame, found: DataFrame | None, column: str) -> DataFrame:
    """Ids of a column as what they have become. found: as of `roots`, or None."""
    if found is None:
        return rows
    to = found.select(F.col("id").alias("_id"), F.col("root").alias("_root"))
    return rows.join(to, rows[column] == to["_id"], "left").withColumn(column, F.coalesce("_root", column)).drop("_id", "_root")


def renamed_edges(edges: DataFrame, found: DataFrame | None, a: str = "src", b: str = "dst") -> DataFrame:
    """Both ends as what they have become; an edge whose ends became one is gone."""
    return edges if found is None else renamed(renamed(edges, found, a), found, b).where(F.col(a) != F.col(b))
