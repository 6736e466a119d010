"""Connected components of an undirected graph by contraction, all in DataFrames.

Each round every node takes the least node within two steps (in an order that a hash deals anew each round), and edges
are drawn between the nodes taken. Stars and groups of copies shrink to one node in a round, so few edges go on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _apart(edges: DataFrame) -> DataFrame:
    """Both directions of each edge once; no loops."""
    e = edges.filter("a <> b").select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
    return checkpointed(e.select("e.a", "e.b").distinct())


def _taken(edges: DataFrame, salt: int) -> DataFrame:
    """(a, label) for each node. The groupings combine on the map side: a hub is one row a task, not a group."""
    rank = F.struct(F.xxhash64("b", F.lit(salt)).alias("rank"), F.col("b").alias("node"))
    own = F.struct(F.xxhash64("a", F.lit(salt)).alias("rank"), F.col("a").alias("node"))
    near = edges.groupBy("a").agg(F.min(rank).alias("low")).select("a", F.least("low", own).alias("low"))
    near = checkpointed(near)
    heard = edges.join(near.select(F.col("a").alias("b"), "low"), "b").groupBy("a").agg(F.min("low").alias("far"))
    return checkpointed(near.join(heard, "a").select("a", F.least("low", "far")["node"].alias("label")))


def components(edges: DataFrame) -> DataFrame:
    """(a, label) for the nodes of edges (a, b): two nodes have one label if and only if they are connected.

    Labels are nodes. A node whose edges are all loops isn't returned; no edges give no rows. Repeated edges do no
    harm; nodes are longs and not null.
    """
    left, labels, salt = _apart(edges), None, 0
    while labels is None or not left.isEmpty():
        to = _taken(left, salt)
        ends = left.join(to, "a").select(F.col("label").alias("x"), "b").join(to.select(F.col("a").alias("b"), F.col("label").alias("y")), "b")
        left = _apart(ends.filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
        labels = to if labels is None else relabelled(labels, to)
        salt += 1
    return checkpointed(labels)


def relabelled(labels: DataFrame, more: DataFrame) -> DataFrame:
    """labels whose labels have got labels themselves."""
    onward = more.select(F.col("a").alias("label"), F.col("label").alias("onward"))
    return labels.join(onward, "label", "left").select("a", F.coalesce("onward", "label").alias("label"))
