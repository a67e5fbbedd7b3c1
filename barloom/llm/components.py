"""Connected components of an edge table by contraction, as DataFrame steps; nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): each node of an edge, with the smallest node that edges lead to.

    A step hooks every node to its smallest smaller neighbour, follows these hooks to their ends by doubling, and replaces
    nodes by where they end. Each step at least halves the nodes that still have a neighbour; stars (one hot node) end in
    one step and long paths in few. Nodes are compared by Spark's order.
    """
    edges = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    roots = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().select("node", F.col("node").alias("root"))
    while not edges.isEmpty():
        up = materialize(edges.groupBy("a").agg(F.min("b").alias("b")), "up")
        while True:
            over = up.select(F.col("a").alias("k"), F.col("b").alias("c"))
            deeper = materialize(up.join(over, F.col("b") == F.col("k"), "left").select("a", F.coalesce("c", "b").alias("b"), F.col("c").isNotNull().alias("deep")), "up")
            if deeper.where("deep").isEmpty():
                break
            up = deeper.select("a", "b")
        left, right = up.select(F.col("a").alias("k"), F.col("b").alias("c")), up.select(F.col("a").alias("k2"), F.col("b").alias("c2"))
        roots = materialize(roots.join(left, F.col("root") == F.col("k"), "left").select("node", F.coalesce("c", "root").alias("root")), "roots")
        moved = edges.join(left, F.col("a") == F.col("k"), "left").join(right, F.col("b") == F.col("k2"), "left").select(F.coalesce("c", "a").alias("x"), F.coalesce("c2", "b").alias("y"))
        edges = materialize(moved.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "edges")
    return roots
