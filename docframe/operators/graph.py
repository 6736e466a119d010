"""The lineage of writes: nodes with id, parents (an array of ids) and op."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..storage import checkpointed

NODE = T.StructType(
    [T.StructField("id", T.StringType()), T.StructField("op", T.StringType()), T.StructField("collection", T.StringType()), T.StructField("record_id", T.StringType()), T.StructField("data", T.MapType(T.StringType(), T.StringType())), T.StructField("parents", T.ArrayType(T.StringType())), T.StructField("timestamp", T.DoubleType()), T.StructField("writer", T.StringType())]
)


def edges(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.col("id").alias("child"), F.explode("parents").alias("parent"))


def ancestors(nodes: DataFrame, start: DataFrame) -> DataFrame:
    """(root, id, depth) of all ancestors of the ids in `start`, themselves included; depth is the longest way.

    One join a generation, each written to the folder of checkpoints, so that a generation costs its own rows only. A
    lineage is without cycles; more generations than nodes mean one, and raise ValueError.
    """
    links = checkpointed(edges(nodes).distinct())
    front = checkpointed(start.select(F.col("id").alias("root"), F.col("id"), F.lit(0).alias("depth")).distinct())
    found, depth, most = [front], 0, None
    while True:
        depth += 1
        front = checkpointed(front.join(links, F.col("id") == F.col("child")).select("root", F.col("parent").alias("id"), F.lit(depth).alias("depth")).distinct())
        if front.isEmpty():
            break
        if depth % 64 == 0:
            most = nodes.count() if most is None else most
            if depth > most:
                raise ValueError("the lineage has a cycle")
            found = [checkpointed(_deepest(found))]
        found.append(front)
    return _deepest(found)


def _deepest(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).groupBy("root", "id").agg(F.max("depth").alias("depth"))


def replay(nodes: DataFrame, reached: DataFrame) -> DataFrame:
    """Ancestors that aren't merges, parents first: (root, step, id, op)."""
    order = Window.partitionBy("root").orderBy(F.col("depth").desc(), "id")
    rows = reached.join(nodes.select("id", "op"), "id").filter(F.col("op") != "merge")
    return rows.select("root", F.row_number().over(order).alias("step"), "id", "op")


def folded(nodes: DataFrame, reached: DataFrame) -> DataFrame:
    """The state that a replay leaves: (root, collection, record_id, data) of each record's last write, without deleted ones."""
    rows = reached.join(nodes.select("id", "op", "collection", "record_id", "data"), "id").filter(F.col("op") != "merge")
    w = Window.partitionBy("root", "collection", "record_id").orderBy("depth", F.col("id").desc())
    last = rows.withColumn("k", F.row_number().over(w)).filter("k = 1 AND op <> 'delete'")
    return last.select("root", "collection", "record_id", "data")


def tips(nodes: DataFrame) -> DataFrame:
    """Nodes that are no one's parent."""
    return nodes.join(edges(nodes).select(F.col("parent").alias("id")).distinct(), "id", "left_anti")


def stats(nodes: DataFrame) -> DataFrame:
    """One row: nodes, merges, roots (without parents) and edges."""
    many = F.coalesce(F.size("parents"), F.lit(0))
    return nodes.agg(F.count("*").alias("nodes"), F.count_if(F.col("op") == "merge").alias("merges"), F.count_if(many == 0).alias("roots"), F.coalesce(F.sum(many.cast("long")), F.lit(0)).alias("edges"))


def merges(branches: DataFrame, by: str) -> DataFrame:
    """A merge node for each group of tips (id, by) that has two or more: (by, parents), parents in order of id."""
    groups = branches.groupBy(by).agg(F.array_sort(F.collect_set("id")).alias("parents"))
    return groups.filter(F.size("parents") > 1)


class Lineage:
    """Branches and merges of writes; nodes are staged on the driver, one small row a write."""

    def __init__(self, spark: SparkSession):
        self.spark, self.staged, self.tips = spark, [], {}

    def branch(self, name: str) -> None:
        self.tips.setdefault(name, [])

    def write(self, branch: str, op: str, collection: str, record_id: str, data: dict, at: float, writer: str = "") -> str:
        node = uuid.uuid4().hex
        self.staged.append((node, op, collection, record_id, {k: str(v) for k, v in data.items()}, list(self.tips.get(branch, [])), at, writer))
        self.tips[branch] = [node]
        return node

    def merge(self, ids: list[str], at: float, writer: str = "") -> str:
        if len(ids) < 2:
            raise ValueError("a merge has two parents or more")
        node = uuid.uuid4().hex
        self.staged.append((node, "merge", "", "", {}, list(ids), at, writer))
        for name, tip in self.tips.items():
            if set(tip) & set(ids):
                self.tips[name] = [node]
        return node

    def tip(self, branch: str) -> list[str]:
        return list(self.tips.get(branch, []))

    def branches(self) -> list[str]:
        return sorted(self.tips)

    def nodes(self) -> DataFrame:
        return self.spark.createDataFrame(self.staged, NODE)
