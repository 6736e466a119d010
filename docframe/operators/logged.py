"""Collections whose every write is a row of an append-only log: versions, tombstones and transaction ids.

The log has id, version, at, deleted, tx_id and the record's fields. Nothing is rewritten, and a plan doesn't grow with
the number of writes: each write appends files, each read starts from the folder. operators.temporal reads such a log at
any time.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import checkpointed, file_system
from . import temporal

ENVELOPE = [T.StructField("id", T.StringType()), T.StructField("version", T.IntegerType()), T.StructField("at", T.DoubleType()), T.StructField("deleted", T.BooleanType()), T.StructField("tx_id", T.StringType())]


class LoggedCollection:
    """fields: DDL of the record's own columns. One writer at a time; readers see whole writes."""

    def __init__(self, spark: SparkSession, path: str, fields: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.fields = T.StructType.fromDDL(fields)
        self.schema = T.StructType([*ENVELOPE, *self.fields.fields])

    @property
    def log(self) -> DataFrame:
        fs, p = file_system(self.spark, self.path)
        return self.spark.read.schema(self.schema).parquet(self.path) if fs.exists(p) else self.spark.createDataFrame([], self.schema)

    def current(self) -> DataFrame:
        return temporal.snapshot(self.log)

    def get(self, id_value: str) -> DataFrame:
        return temporal.record_at(self.log, id_value)

    def history(self, id_value: str) -> DataFrame:
        return temporal.history(self.log, id_value)

    def as_of(self, at: float) -> DataFrame:
        return temporal.snapshot(self.log, at)

    def _append(self, rows: DataFrame, at: float | None, tx_id: str | None) -> None:
        when = time.time() if at is None else at
        out = rows.withColumns({"at": F.lit(float(when)), "tx_id": F.lit(tx_id or uuid.uuid4().hex)})
        out.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema)).write.mode("append").parquet(self.path)

    def insert(self, *rows: dict, at: float | None = None, tx_id: str | None = None) -> list[str]:
        """Rows from the driver, with ids of their own or new ones."""
        ids = [r.get("id") or uuid.uuid4().hex for r in rows]
        kinds = T.StructType([T.StructField("id", T.StringType()), *self.fields.fields])
        self.insert_df(self.spark.createDataFrame([(i, *(r.get(f.name) for f in self.fields)) for i, r in zip(ids, rows, strict=True)], kinds), at, tx_id)
        return ids

    def insert_df(self, rows: DataFrame, at: float | None = None, tx_id: str | None = None) -> None:
        """Rows of a DataFrame, written by all its tasks at once. Without an id column, ids are made in the tasks.

        An id that is there (even deleted) goes on with its next version.
        """
        rows = checkpointed(rows if "id" in rows.columns else rows.withColumn("id", F.expr("replace(uuid(), '-', '')")))
        last = self.log.groupBy(F.col("id").alias("_id")).agg(F.max("version").alias("_v"))
        full = rows.join(last, F.col("id") == F.col("_id"), "left").withColumns({"version": F.coalesce("_v", F.lit(0)) + 1, "deleted": F.lit(False)})
        self._append(full.withColumns({f.name: F.lit(None) for f in self.fields if f.name not in rows.columns}), at, tx_id)

    def update_many(self, where: Column, values: dict, at: float | None = None, tx_id: str | None = None) -> None:
        """A new version of each current record that matches, with these fields set to values or Columns."""
        hit = self.current().filter(where)
        new = {k: v if isinstance(v, Column) else F.lit(v) for k, v in values.items()}
        self._append(hit.withColumns({**new, "version": F.col("version") + 1}), at, tx_id)

    def update(self, id_value: str, values: dict, at: float | None = None, tx_id: str | None = None) -> bool:
        """Merges fields into one record; False, and no row, if it isn't there."""
        if self.get(id_value).isEmpty():
            return False
        self.update_many(F.col("id") == id_value, values, at, tx_id)
        return True

    def delete_many(self, where: Column, at: float | None = None, tx_id: str | None = None) -> None:
        """A tombstone, with the last fields, for each current record that matches."""
        self._append(self.current().filter(where).withColumns({"version": F.col("version") + 1, "deleted": F.lit(True)}), at, tx_id)

    def delete(self, *ids: str, at: float | None = None, tx_id: str | None = None) -> None:
        self.delete_many(F.col("id").isin(list(ids)), at, tx_id)

    def restore(self, id_value: str, version: int, at: float | None = None, exact: bool = False) -> None:
        rows = temporal.restored(self.log, id_value, version, F.lit(0.0), [f.name for f in self.fields], exact)
        self._append(rows, at, None)

    def transaction(self, tx_id: str) -> DataFrame:
        """What one transaction wrote."""
        return self.log.filter(F.col("tx_id") == tx_id)
