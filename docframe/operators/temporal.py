"""Version logs, snapshots, transactions, change events and time series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import duration

# --- a version log has id, version, at, deleted and data columns ---------------------------------------------------


def history(log: DataFrame, id_value, id_col: str = "id") -> DataFrame:
    return log.filter(F.col(id_col) == id_value).orderBy("version")


def snapshot(log: DataFrame, at=None, id_col: str = "id") -> DataFrame:
    """The latest version of each id at a time, without deleted ones; partial aggregation by max_by."""
    seen = log if at is None else log.filter(F.col("at") <= F.lit(at))
    latest = seen.groupBy(id_col).agg(F.max_by(F.struct(*(c for c in log.columns if c != id_col)), F.struct("at", "version")).alias("_r"))
    return latest.select(id_col, "_r.*").filter(~F.col("deleted"))


def record_at(log: DataFrame, id_value, at=None, id_col: str = "id") -> DataFrame:
    """One record at a time; the filter comes before the aggregate."""
    return snapshot(log.filter(F.col(id_col) == id_value), at, id_col)


def diff(log: DataFrame, version_a: int, version_b: int, fields: list[str], id_col: str = "id") -> DataFrame:
    """(id, field, a, b) of the fields that differ between two versions, as text; ids without either are left out."""
    def one(v: int, side: str) -> DataFrame:
        return log.filter(F.col("version") == v).select(F.col(id_col), F.create_map(*(x for f in fields for x in (F.lit(f), F.col(f).cast("string")))).alias(side))

    both = one(version_a, "_a").join(one(version_b, "_b"), id_col)
    rows = both.select(id_col, F.explode(F.array(*map(F.lit, fields))).alias("field"), "_a", "_b")
    return rows.select(id_col, "field", F.col("_a")[F.col("field")].alias("a"), F.col("_b")[F.col("field")].alias("b")).filter(~F.col("a").eqNullSafe(F.col("b")))


def changes_between(log: DataFrame, start, end=None) -> DataFrame:
    out = log.filter(F.col("at") >= F.lit(start))
    return out if end is None else out.filter(F.col("at") <= F.lit(end))


def restored(log: DataFrame, id_value, version: int, at: Column, fields: list[str], exact: bool = False, id_col: str = "id") -> DataFrame:
    """The log row that restores a version: its fields over the current ones, or, exact, its fields alone.

    A log's columns can't tell a field that is null from one that isn't there: a merge takes null for not there and
    keeps the current value, exact restores the null. A deleted record isn't restored.
    """
    now = snapshot(log.filter(F.col(id_col) == id_value), None, id_col)
    old = log.filter((F.col(id_col) == id_value) & (F.col("version") == version)).select(F.col(id_col).alias("_id"), *(F.col(f).alias(f"_{f}") for f in fields))
    merged = [(F.col(f"_{f}") if exact else F.coalesce(f"_{f}", f)).alias(f) for f in fields]
    return now.join(old, F.col(id_col) == F.col("_id")).select(id_col, (F.col("version") + 1).alias("version"), at.alias("at"), F.lit(False).alias("deleted"), *merged)


def compacted(log: DataFrame, most: int = 100, last: int = 50, id_col: str = "id") -> DataFrame:
    """Ids with more than `most` versions keep the first one and the last `last`."""
    w = Window.partitionBy(id_col)
    rows = log.withColumns({"_up": F.row_number().over(w.orderBy("at", "version")), "_n": F.count("*").over(w)})
    return rows.filter((F.col("_n") <= most) | (F.col("_up") == 1) | (F.col("_up") > F.col("_n") - last)).drop("_up", "_n")


def collected(log: DataFrame, before, id_col: str = "id") -> DataFrame:
    """What garbage collection keeps: all of ids with two versions or fewer, the latest, and those at or after a time."""
    w = Window.partitionBy(id_col)
    rows = log.withColumns({"_down": F.row_number().over(w.orderBy(F.col("at").desc(), F.col("version").desc())), "_n": F.count("*").over(w)})
    return rows.filter((F.col("_n") <= 2) | (F.col("_down") == 1) | (F.col("at") >= F.lit(before))).drop("_down", "_n")


def compare_and_set(current: DataFrame, updates: DataFrame, id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """(applied, conflicts) of updates that carry expected_version; applied rows carry the next version."""
    now = current.select(F.col(id_col).alias("_id"), F.col("version").alias("_v"))
    joined = updates.join(now, F.col(id_col) == F.col("_id"), "left")
    fits = F.col("expected_version").eqNullSafe(F.col("_v"))
    return joined.filter(fits).withColumn("version", F.col("_v") + 1).drop("_id", "_v", "expected_version"), joined.filter(~fits).drop("_id", "_v")


class Transaction:
    """Log rows staged on the driver as plans and appended in one write; savepoints cut the list back."""

    def __init__(self):
        self.staged: list[DataFrame] = []
        self._marks: dict[str, int] = {}

    def add(self, rows: DataFrame) -> None:
        self.staged.append(rows)

    def savepoint(self, name: str) -> None:
        self._marks[name] = len(self.staged)

    def rollback_to(self, name: str) -> None:
        del self.staged[self._marks[name] :]

    def release(self, name: str) -> None:
        del self._marks[name]

    def rollback(self) -> None:
        self.staged.clear()

    def rows(self) -> DataFrame | None:
        from functools import reduce

        return reduce(DataFrame.unionByName, self.staged) if self.staged else None

    def commit(self, path: str) -> None:
        if (rows := self.rows()) is not None:
            rows.write.mode("append").parquet(path)
        self.staged.clear()


# --- change events -------------------------------------------------------------------------------------------------


def events_of(log: DataFrame, fields: list[str], id_col: str = "id") -> DataFrame:
    """Change events of a log: op, and the data before and after."""
    w = Window.partitionBy(id_col).orderBy("at", "version")
    data = F.struct(*fields)
    op = F.when(F.col("deleted"), "delete").when((F.lag("deleted").over(w)).eqNullSafe(False), "update").otherwise("insert")
    return log.select(id_col, "version", "at", op.alias("op"), data.alias("data"), F.lag(data).over(w).alias("old_data"))


def filtered(events: DataFrame, op: str | None = None, where: Column | None = None, limit: int | None = None, order: str = "at") -> DataFrame:
    """The first events, in order, of an operation and of what `where` holds for (a collection, say)."""
    out = events if op is None else events.filter(F.col("op") == op)
    out = out if where is None else out.filter(where)
    return out if limit is None else out.orderBy(order).limit(limit)


def recent(events: DataFrame, n: int, order: str = "at") -> DataFrame:
    return events.orderBy(F.col(order).desc()).limit(n).orderBy(order)


def since(events: DataFrame, at) -> DataFrame:
    return events.filter(F.col("at") >= F.lit(at))


# --- time series have metric, ts and value columns -----------------------------------------------------------------


def seconds(ts: Column) -> Column:
    """Seconds since the epoch of a timestamp with or without time zone, in UTC."""
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def ts_range(series: DataFrame, metric: str, start=None, end=None, last: str | None = None, limit: int | None = None) -> DataFrame:
    """Points in an inclusive range; `last` counts back from the metric's newest point; `limit` keeps the newest."""
    out = series.filter(F.col("metric") == metric)
    if last is not None:
        newest = out.agg(F.max("ts")).first()[0]
        from datetime import timedelta

        start = newest - timedelta(seconds=duration(last)) if newest else start
    out = out if start is None else out.filter(F.col("ts") >= F.lit(start))
    out = out if end is None else out.filter(F.col("ts") <= F.lit(end))
    return out if limit is None else out.orderBy(F.col("ts").desc()).limit(limit)


def ts_latest(series: DataFrame) -> DataFrame:
    return series.groupBy("metric").agg(F.max("ts").alias("ts"), F.max_by("value", "ts").alias("value"))


def ts_metrics(series: DataFrame) -> DataFrame:
    """(metric, points, since, upto) of each series."""
    return series.groupBy("metric").agg(F.count("*").alias("points"), F.min("ts").alias("since"), F.max("ts").alias("upto"))


def ts_totals(series: DataFrame) -> DataFrame:
    """One row: number of series and of points. Series are counted from partial sums by metric."""
    return series.groupBy("metric").agg(F.count("*").alias("n")).agg(F.count("*").alias("series"), F.coalesce(F.sum("n"), F.lit(0)).alias("points"))


def ts_aggregate(series: DataFrame) -> DataFrame:
    return series.groupBy("metric").agg(F.sum("value").alias("sum"), F.avg("value").alias("avg"), F.min("value").alias("min"), F.max("value").alias("max"), F.count("value").alias("count"))


def downsample(series: DataFrame, width: str, op: str = "avg") -> DataFrame:
    """(metric, bucket, value) of the buckets that hold points; buckets are aligned to the epoch."""
    w = duration(width)
    bucket = F.timestamp_seconds(F.floor(seconds(F.col("ts")) / w) * w).cast("timestamp_ntz")
    by = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": lambda c: F.count(c).cast("double")}
    agg = by[op]("value") if op in by else F.min_by("value", "ts")
    return series.groupBy("metric", bucket.alias("bucket")).agg(agg.alias("value"))


def rate(series: DataFrame) -> DataFrame:
    """Change a second from the first to the last point of each metric; 0 for fewer than two points or no time."""
    s = series.groupBy("metric").agg(F.min_by("value", "ts").alias("v0"), F.max_by("value", "ts").alias("v1"), F.min(seconds(F.col("ts"))).alias("t0"), F.max(seconds(F.col("ts"))).alias("t1"))
    return s.select("metric", F.when(F.col("t1") > F.col("t0"), (F.col("v1") - F.col("v0")) / (F.col("t1") - F.col("t0"))).otherwise(0.0).alias("rate"))


def retained(series: DataFrame, cutoff) -> DataFrame:
    return series.filter(F.col("ts") >= F.lit(cutoff))
