"""Connected components of large graphs by contraction: hook to the least neighbour, jump, relabel the edges - all in tables."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the least node reached.

    A round hooks each node to its least smaller neighbour (an aggregate with partial sums, so a hub costs one row for each
    task), follows hooks twice, and moves the edges on to the new labels; loops and repeats fall away.  At least half of a
    component's nodes are hooked in a round, so rounds are logarithmic, and edges shrink with them.  Tables of all rounds go
    to the shared folder; the driver learns only whether edges are left.
    """
    ordered = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    ordered = materialise(ordered, "edges")
    labels = ordered.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node"))
    left = ordered.filter("a < b")
    for _ in range(most_rounds):
        if left.isEmpty():
            return labels
        hooks = left.groupBy("b").agg(F.min("a").alias("to")).withColumnRenamed("b", "at")
        for _ in range(2):
            hooks = materialise(hooks, "hooks")
            ahead = hooks.select(F.col("at").alias("to"), F.col("to").alias("further"))
            hooks = hooks.join(ahead, "to", "left").select("at", F.coalesce("further", "to").alias("to"))
        hooks = materialise(hooks, "hooks")

        def moved(df: DataFrame, column: str) -> DataFrame:
            return df.join(hooks.withColumnRenamed("at", column), column, "left").withColumn(column, F.coalesce("to", column)).drop("to")

        labels = materialise(moved(labels, "component"), "labels")
        new = moved(moved(left, "a"), "b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        left = materialise(new.filter("a < b").distinct(), "edges")
    raise RuntimeError("edges are left: raise most_rounds")
