"""Connected components by star hooking, pointer jumping and edge contraction, on DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import stage


def _jump(parent: DataFrame) -> DataFrame:
    """Follows parents to the roots; the path of each node halves in every pass."""
    while True:
        up = parent.select(F.col("node").alias("root"), F.col("root").alias("above"))
        nxt = stage(parent.join(up, "root").select("node", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved")), "jump")
        parent = nxt.select("node", "root")
        if nxt.filter("moved").isEmpty():
            return parent


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges(a, b)``; root is the smallest node that can be reached.

    Each round hooks every node to its smallest neighbour, collapses the trees to their roots and keeps the edges between
    different roots. Null ends and loops are left out; repeated edges count once.
    """
    edges = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), "edges")
    labels = None
    while True:
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
        hooks = stage(both.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("root")), "hooks")
        roots = _jump(hooks)
        if labels is None:
            labels = roots
        else:
            step = roots.select(F.col("node").alias("root"), F.col("root").alias("above"))
            labels = stage(labels.join(step, "root", "left").select("node", F.coalesce("above", "root").alias("root")), "labels")
        a = roots.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        b = roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        joined = edges.join(a, "a").join(b, "b").filter("ra != rb")
        edges = stage(joined.select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b")).distinct(), "edges")
        if edges.isEmpty():
            return labels
