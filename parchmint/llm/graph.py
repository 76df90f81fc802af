"""Connected components by contraction, on tables of links only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def _any(df: DataFrame) -> bool:
    return bool(df.limit(1).count())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a, b): root is the smallest node reachable.

    Each round every node hooks to its least neighbour, hooks are followed to their ends by doubling,
    and edges are mapped to those ends until none is left. Tables shrink from round to round and live
    in the shared folder. Neighbours are only ever reduced to a minimum, so a hub costs one row a task;
    joins go by a key that is unique on one side. Self links and repeats are ignored; nulls link nothing.
    """
    edges = saved(edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    roots = None
    while _any(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = saved(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("root")), "hooks")
        while True:
            next_ = hooks.select(F.col("node").alias("root"), F.col("root").alias("far"))
            jumped = saved(hooks.join(next_, "root").select("node", F.col("far").alias("root"), (F.col("far") != F.col("root")).alias("moved")), "hooks")
            hooks = jumped.select("node", "root")
            if not _any(jumped.where("moved")):
                break
        left, right = (hooks.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in "ab")
        mapped = edges.join(left, "a").join(right, "b").where(F.col("ra") != F.col("rb"))
        edges = saved(mapped.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        if roots is None:
            roots = hooks
        else:
            step = hooks.select(F.col("node").alias("root"), F.col("root").alias("far"))
            roots = saved(roots.join(step, "root", "left").select("node", F.coalesce("far", "root").alias("root")), "roots")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")) if roots is None else roots
