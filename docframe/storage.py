"""Where intermediate results go: the folder that driver and executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a local master has a default; a cluster must name one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = current.get() if current.isDefined() else None
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "/tmp/docframe-checkpoints"
    return at.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df computed once, its lineage cut at files in the shared folder."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def widened(df: DataFrame) -> DataFrame:
    """df over all cores where it has fewer partitions, as one file of one row group has; else df as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p
