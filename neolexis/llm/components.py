"""Connected components by hooking and contraction, with no step that gathers links in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch


def components(spark: SparkSession, edges: DataFrame, scratch: Scratch | None = None, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable id of every node that has a link.

    edges: columns a, b (long), undirected, loops and repeats allowed. Returns node, component (long).
    Every round hooks each node to its smallest neighbour, jumps pointers twice and replaces the links by
    links between the new parents; the links shrink geometrically. Each round is written to the shared
    folder. A node of very many links meets only map-side combined minima and joins that Spark can split.
    Empty edges give an empty table.
    """
    scratch = scratch or Scratch(spark)
    live = scratch.save(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "links")
    hooks: list[DataFrame] = []
    for _ in range(max_rounds):
        if live.isEmpty():
            break
        both = live.select(F.col("a").alias("node"), F.col("b").alias("other")).union(live.select("b", "a"))
        parent = both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("parent"))
        parent = scratch.save(parent, "hooks")
        up = parent.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        jumped = scratch.save(parent.join(up, "parent").select("node", F.col("grand").alias("parent"), F.col("parent").alias("first")), "jumps")
        up = jumped.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        top = jumped.join(up, "parent").select("node", F.col("grand").alias("parent"), "first")
        top = scratch.save(top, "parents")
        scratch.drop(parent)
        scratch.drop(jumped)
        to = top.select("node", "parent")
        # a node that was hooked but whose parent is no root yet keeps that link
        kept = live.select("a", "b").union(top.where("node <> parent").select("node", "parent"))
        left = kept.join(to.select(F.col("node").alias("a"), F.col("parent").alias("pa")), "a")
        moved = left.join(to.select(F.col("node").alias("b"), F.col("parent").alias("pb")), "b")
        new = moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).where("a < b").distinct()
        new = scratch.save(new, "links")
        scratch.drop(live)
        live = new
        hooks.append(to)
    else:
        raise RuntimeError("components did not settle")
    if not hooks:
        return spark.createDataFrame([], "node long, component long")
    out = hooks[-1].select("node", F.col("parent").alias("component"))
    for to in reversed(hooks[:-1]):
        # what a node's parent of this round became in later rounds
        later = out.select(F.col("node").alias("parent"), F.col("component").alias("later"))
        out = scratch.save(to.join(later, "parent", "left").select("node", F.coalesce("later", "parent").alias("component")), "labels")
    return out
