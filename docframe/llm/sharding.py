"""Sharding over fixed virtual slots: records are hashed into slots, and a small versioned map takes slots to shards.

Only the bytes of each slot are needed to balance: the map is made, or edited, on the driver from one number a slot,
and the number of slots is fixed. Rebalancing moves whole slots, as few as it can, and writes a new version of the map.
"""

from __future__ import annotations

import heapq
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed, shared_dir

SLOTS = 4096
#: How far the heaviest shard may stay above the mean when a stored map is edited.
SLACK = 0.0001


def spread(slot_bytes: dict[int, int], shards: int) -> dict[int, int]:
    """Slot to shard: heaviest slots first, each to the lightest shard so far. Ties go by number."""
    heap = [(0, k) for k in range(shards)]
    out = {}
    for slot in sorted(slot_bytes, key=lambda s: (-slot_bytes[s], s)):
        held, k = heapq.heappop(heap)
        out[slot] = k
        heapq.heappush(heap, (held + slot_bytes[slot], k))
    return out


def rebalanced(slot_map: dict[int, int], slot_bytes: dict[int, int], shards: int, slack: float = 0.01) -> dict[int, int]:
    """slot_map edited for new slot sizes or a new number of shards.

    Slots of shards that are no more, and new slots, go to the lightest shards; then slots move from the heaviest shard
    to the lightest, as long as the heaviest is more than slack above the mean and a move lowers it. Others stay.
    """
    out = {s: k for s, k in slot_map.items() if k < shards}
    load = [0] * shards
    for s, k in out.items():
        load[k] += slot_bytes.get(s, 0)
    for s in sorted(set(slot_bytes) - set(out), key=lambda s: (-slot_bytes[s], s)):
        k = min(range(shards), key=lambda k: (load[k], k))
        out[s] = k
        load[k] += slot_bytes[s]
    mean = sum(load) / shards
    of: list[set[int]] = [set() for _ in range(shards)]
    for s, k in out.items():
        of[k].add(s)
    for _ in range(len(out)):
        high, low = max(range(shards), key=lambda k: (load[k], -k)), min(range(shards), key=lambda k: (load[k], k))
        gap = load[high] - load[low]
        fit = [s for s in of[high] if 0 < slot_bytes.get(s, 0) < gap]
        if load[high] <= mean * (1 + slack) or not fit:
            break
        s = min(fit, key=lambda s: (abs(slot_bytes[s] - gap / 2), s))
        of[high].remove(s)
        of[low].add(s)
        out[s] = low
        load[high] -= slot_bytes[s]
        load[low] += slot_bytes[s]
    return out


def save_map(spark: SparkSession, path: str, version: int, slot_map: dict[int, int]) -> None:
    """Writes one version of a map; a version that is there already is written again, never another one."""
    rows = spark.createDataFrame(sorted(slot_map.items()), "vslot int, shard int")
    rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/version={version}")


def start_map(spark: SparkSession, path: str, shards: int = 8, slots: int = SLOTS) -> str:
    """Writes version 1 of a new map: all slots, dealt to the shards in turn, before anything is known of their bytes."""
    save_map(spark, path, 1, {s: s % shards for s in range(slots)})
    return path


def load_map(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, dict[int, int]]:
    """A version of a map, the latest by default. A map has as many rows as there are slots."""
    rows = spark.read.parquet(path)
    if version is None:
        version = rows.agg(F.max("version")).first()[0]
    return version, {r.vslot: r.shard for r in rows.filter(F.col("version") == version).collect()}


def has_map(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def new_map_path(spark: SparkSession) -> str:
    """Where in the shared folder a run keeps the versions of its map."""
    return f"{shared_dir(spark)}/docframe/slots-{uuid.uuid4().hex}"


def vslot(slots: int, *of):
    return F.pmod(F.xxhash64(*of), F.lit(slots)).cast("int")


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 8, slots: int = SLOTS, slot_map: dict[int, int] | None = None, map_path: str | None = None) -> DataFrame:
    """Shard and place of each row: (id_col, size, text_crc32, law, shard, slot, grown_shard, vslot, map_version).

    size: UTF-8 bytes of the text plus 1; null texts count as empty. slot numbers a shard's rows without gaps from 0.
    The law is `bytes`: sums of size are near equal, so grown_shard is null. Slots come from a hash of (id, size, crc32,
    number of the row among those that agree in all three), so that no group of repeated ids or texts fills a slot.

    With map_path, the latest map there, or slot_map if given, is edited by the bytes of the slots and written as the
    next version; where there is none, a map is made from the bytes alone. Other columns are not read. An empty table
    gives an empty table.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("crc"))
    grouped = rows.groupBy("id", "size", "crc").agg(F.count("*").alias("n"))
    units = grouped.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).drop("n")
    units = checkpointed(units.withColumn("vslot", vslot(slots, "id", "size", "crc", "repeat")))
    weighed = {r.vslot: (r.bytes, r.rows) for r in units.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()}
    version, edited = _edited(spark, {s: b for s, (b, _) in weighed.items()}, shards, slot_map, map_path)
    first, before = {}, [0] * shards
    for s in sorted(weighed):
        first[s] = before[edited[s]]
        before[edited[s]] += weighed[s][1]
    # as many rows as there are slots
    placed = spark.createDataFrame([(s, edited[s], first[s]) for s in sorted(weighed)], "vslot int, shard int, first long")
    number = F.row_number().over(Window.partitionBy("vslot").orderBy("id", "size", "crc", "repeat"))
    out = units.withColumn("number", number).join(F.broadcast(placed), "vslot")
    return out.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("number") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "vslot", F.lit(version).alias("map_version")
    )


def _edited(spark: SparkSession, held: dict[int, int], shards: int, slot_map: dict[int, int] | None, map_path: str | None) -> tuple[int, dict[int, int]]:
    """Version and map for slots that hold so many bytes; stored where map_path is given."""
    version, old = 0, slot_map
    if map_path is not None and has_map(spark, map_path):
        version, stored = load_map(spark, map_path)
        old = stored if slot_map is None else slot_map
    edited = spread(held, shards) if old is None else rebalanced(old, held, shards, SLACK)
    if map_path is not None:
        save_map(spark, map_path, version + 1, edited)
    return version + 1, edited


def with_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 8, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """docs with columns shard and vslot (which replace columns of these names); texts are never shuffled.

    Slots come from a hash of the id and the text. A group of rows that agree in both and are more than a mean slot has -
    fewer than `slots` groups are so large - is dealt to all slots by a number of each row. map_path: see shard().
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.drop("shard", "vslot").withColumn("_key", F.xxhash64(F.col(id_col), text))
    none = F.lit(None).cast("long")
    sizes = rows.groupBy("_key").agg(F.count("*").alias("n"), F.sum(F.octet_length(text).cast("long") + 1).alias("bytes"))
    sizes = checkpointed(sizes.withColumn("vslot", vslot(slots, "_key", none)))
    mean = (sizes.agg(F.sum("n")).first()[0] or 0) / slots
    is_large = F.col("n") > max(mean, 1)
    large = {r["_key"]: r["bytes"] for r in sizes.filter(is_large).select("_key", "bytes").collect()}
    held = {r.vslot: r.bytes for r in sizes.filter(~is_large).groupBy("vslot").agg(F.sum("bytes").alias("bytes")).collect()}
    held = {s: held.get(s, 0) + sum(large.values()) // slots for s in range(slots)}
    made = _edited(spark, held, shards, None, map_path)[1]
    salt = none
    if large:
        rows = rows.join(F.broadcast(spark.createDataFrame([(k,) for k in large], "_large long")), F.col("_key") == F.col("_large"), "left")
        salt = F.when(F.col("_large").isNotNull(), F.monotonically_increasing_id())
    placed = spark.createDataFrame(sorted(made.items()), "vslot int, shard int")
    rows = rows.withColumn("vslot", vslot(slots, "_key", salt)).join(F.broadcast(placed), "vslot")
    return rows.select(*[f"`{c}`" for c in docs.columns if c not in ("shard", "vslot")], "shard", "vslot")
