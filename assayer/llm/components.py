"""Connected components of an edge table, by contraction.

Each round, every node steps to its least neighbour, steps are followed to their end, and edges are
redrawn between the nodes that remain.  A round at least halves the nodes of a component that still
has edges, and nothing but counts comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.storage import materialize


def _follow(steps: DataFrame) -> DataFrame:
    """``steps(node, root)`` with every root followed until it steps no further."""
    while True:
        onward = steps.select(F.col("node").alias("root"), F.col("root").alias("next"))
        longer = materialize(steps.join(onward, "root", "left").select("node", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "steps")
        steps = longer.select("node", "root")
        if longer.filter("moved").isEmpty():
            return steps


def connected(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges(a, b)`` that is not its component's least: the root is."""
    left = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    found = None
    while not left.isEmpty():
        steps = _follow(materialize(left.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")), "steps"))
        if found is None:
            found = steps
        else:
            moved = found.join(steps.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left")
            found = materialize(moved.select("node", F.coalesce("next", "root").alias("root")).unionByName(steps), "roots")
        for end in ("a", "b"):
            left = left.join(steps.select(F.col("node").alias(end), "root"), end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
        left = materialize(left.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    return found if found is not None else edges.sparkSession.createDataFrame([], "node long, root long")
