"""Hash sharding as a derived column; partition pruning and shuffles do the rest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import shard_of


def routed(df: DataFrame, key: str, shards: int) -> DataFrame:
    return df.withColumn("shard", shard_of(F.col(key), shards))


def counts(df: DataFrame, key: str, shards: int) -> DataFrame:
    return routed(df, key, shards).groupBy("shard").agg(F.count("*").alias("n"))


def write(df: DataFrame, key: str, shards: int, path: str, tasks: int = 4, rows: int = 5_000_000) -> None:
    """One folder a shard; a read with the shard in its filter touches that folder only.

    A shard is written by up to `tasks` tasks, dealt by a hash of the row's key, in files of `rows` rows at most.
    """
    salt = F.pmod(F.xxhash64(key), F.lit(tasks))
    routed(df, key, shards).repartition(shards * tasks, "shard", salt).write.mode("overwrite").option("maxRecordsPerFile", rows).partitionBy("shard").parquet(path)


def rebalance(df: DataFrame, key: str, shards: int, path: str) -> None:
    """Writes rows anew for another number of shards; ids stay. path must not be where df is read from."""
    inside = path.rstrip("/").removeprefix("file:") + "/"
    if any(f.split("://")[-1].removeprefix("file:").find(inside.split("://")[-1].lstrip("/")) >= 0 for f in df.inputFiles()):
        raise ValueError(f"{path} is what the rows are read from")
    write(df.drop("shard"), key, shards, path)


def get(spark: SparkSession, path: str, key: str, value, shards: int) -> DataFrame:
    """The rows of one key, from its shard's folder only."""
    rows = spark.read.parquet(path)
    wanted = F.lit(value).cast(rows.schema[key].dataType)
    shard = spark.range(1).select(shard_of(wanted, shards)).first()[0]
    return rows.filter((F.col("shard") == shard) & (F.col(key) == wanted))


def gathered(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
