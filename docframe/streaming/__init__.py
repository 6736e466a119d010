"""Structured Streaming: change streams, replication, live rollups."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import duration
from ..operators.temporal import snapshot
from ..storage import checkpointed, file_system, shared_dir


def change_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    """A change log that others append to, as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def on_change(stream: DataFrame, callback: Callable[[DataFrame, int], None], checkpoint: str, where=None, once: bool = True):
    """Calls callback(rows, batch id) with each batch of the changes that match."""
    rows = stream if where is None else stream.filter(where)
    writer = rows.writeStream.foreachBatch(callback).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def counts(stream: DataFrame, key: str) -> DataFrame:
    """Running counts by key."""
    return stream.groupBy(key).agg(F.count("*").alias("n"))


def downsample(stream: DataFrame, ts: str, metric: str, value: str, width: str, late: str = "1 hour") -> DataFrame:
    """Tumbling buckets of event time. Points that come later than `late` are left out; others update their bucket."""
    rows = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    bucket = F.window("_ts", f"{int(duration(width))} seconds")
    out = rows.groupBy(bucket.alias("w"), F.col(metric).alias("metric")).agg(F.avg(value).alias("value"), F.count("*").alias("n"))
    return out.select("metric", F.col("w.start").cast("timestamp_ntz").alias("bucket"), "value", "n")


#: Buckets of a replica by a hash of the id; a batch rewrites those that it touches.
REPLICA_BUCKETS = 64


def replicate(stream: DataFrame, target: str, checkpoint: str, id_col: str = "id", buckets: int = REPLICA_BUCKETS):
    """Applies a change log to a replica, each batch once: latest versions by id, ids kept.

    The replica lies in buckets. A batch reads and writes the buckets of its ids only, as files of its own under
    bucket=b/batch=n, and then commits by the list of the buckets it wrote; one that is tried again writes the same
    again. Of a bucket the newest committed batch counts; the one before is kept for readers, older ones are deleted.
    """

    def apply(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(id_col), F.lit(buckets)).cast("int"))
        rows = checkpointed(rows)
        touched = sorted(r[0] for r in rows.select("_bucket").distinct().collect())  # as many as there are buckets
        held = _newest(spark, target, batch - 1)
        old = [spark.read.parquet(f"{target}/bucket={b}/batch={held[b][-1]:010d}").withColumn("_bucket", F.lit(b)) for b in touched if b in held]
        every = reduce(DataFrame.unionByName, old, rows)
        latest = every.groupBy("_bucket", id_col).agg(F.max_by(F.struct(*(c for c in rows.columns if c not in (id_col, "_bucket"))), F.struct("at", "version")).alias("_r")).select("_bucket", id_col, "_r.*")
        latest = checkpointed(latest)
        for b in touched:
            latest.filter(F.col("_bucket") == b).drop("_bucket").write.mode("overwrite").parquet(f"{target}/bucket={b}/batch={batch:010d}")
        spark.createDataFrame([(b,) for b in touched], "bucket int").coalesce(1).write.mode("overwrite").json(f"{target}/_commits/{batch:010d}")
        for b in touched:
            for n in held.get(b, [])[:-1]:
                fs, p = file_system(spark, f"{target}/bucket={b}/batch={n:010d}")
                fs.delete(p, True)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _children(spark: SparkSession, path: str) -> list[str]:
    fs, p = file_system(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def _newest(spark: SparkSession, target: str, upto: int | None = None) -> dict[int, list[int]]:
    """Committed batches of each bucket that are still there, oldest first."""
    done = {int(n) for n in _children(spark, f"{target}/_commits") if not _is_open(spark, f"{target}/_commits/{n}")}
    out = {}
    for name in _children(spark, target):
        if name.startswith("bucket="):
            mine = [int(n.partition("=")[2]) for n in _children(spark, f"{target}/{name}")]
            if mine := [n for n in mine if n in done and (upto is None or n <= upto)]:
                out[int(name.partition("=")[2])] = mine
    return out


def _is_open(spark: SparkSession, path: str) -> bool:
    fs, p = file_system(spark, f"{path}/_SUCCESS")
    return not fs.exists(p)


def replica(spark: SparkSession, target: str) -> DataFrame | None:
    """The newest complete version of a replica, deleted rows included."""
    held = _newest(spark, target)
    return spark.read.parquet(*(f"{target}/bucket={b}/batch={n[-1]:010d}" for b, n in held.items())) if held else None


def current(spark: SparkSession, target: str, id_col: str = "id") -> DataFrame | None:
    rows = replica(spark, target)
    return None if rows is None else snapshot(rows, None, id_col)


def drained(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """All that a stream has now, written to the shared folder and read from there.

    In complete mode the last batch holds the whole result; in append mode all batches together do.
    """
    spark = stream.sparkSession
    at = f"{shared_dir(spark)}/docframe/stream-{name}"

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{at}/out/batch={batch:010d}")

    stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    held = _children(spark, f"{at}/out")
    if not held:
        return spark.createDataFrame([], stream.schema)
    parts = [f"{at}/out/{n}" for n in (held[-1:] if mode == "complete" else held)]
    return spark.read.schema(stream.schema).parquet(*parts)
