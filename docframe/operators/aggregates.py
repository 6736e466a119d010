"""Aggregates of the builder and of the column view."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import checksum
from ..storage import checkpointed

OPS = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count}


def _op(name: str):
    if name not in OPS:
        raise ValueError(f"unknown aggregate {name!r}; one of {', '.join(OPS)}")
    return OPS[name]


def scalar(df: DataFrame, field: str, op: str) -> DataFrame:
    """One row, value; 0 of no rows, null for avg."""
    v = _op(op)(field)
    return df.agg((v if op == "avg" else F.coalesce(v, F.lit(0))).alias("value"))


def grouped(df: DataFrame, key: str, field: str | None = None, op: str = "count", none_label: str | None = None, name: str = "value") -> DataFrame:
    """(key, value); null is a group, under none_label if given. A group without numbers has 0."""
    k = F.coalesce(F.col(key).cast("string"), F.lit(none_label)) if none_label is not None else F.col(key)
    v = F.count("*") if field is None else _op(op)(field)
    return df.groupBy(k.alias(key)).agg(F.coalesce(v, F.lit(0)).alias(name))


def columnar(df: DataFrame, field: str) -> DataFrame:
    """All column aggregates in one pass."""
    return df.agg(
        F.coalesce(F.sum(F.col(field).cast("double")), F.lit(0.0)).alias("sum"), F.avg(field).alias("avg"), F.min(field).alias("min"), F.max(field).alias("max"), F.count("*").alias("count"), F.count(field).alias("count_field")
    )


def field_stats(df: DataFrame, fields: list[str], exact: bool = False) -> DataFrame:
    """A row for each field: total_rows, distinct, selectivity, least and greatest (as text).

    By default distinct is a sketch: one pass, partial aggregates only. exact counts the values of one field after
    another, each from its own column, by value first, so that a hot value is one row a task.
    """
    names = ("field", "total_rows", "distinct", "selectivity", "least", "greatest")

    def row(f: str, n: Column, d: Column, lo: Column, hi: Column) -> list[Column]:
        return [x.alias(name) for x, name in zip((F.lit(f), n, d, d / n, lo.cast("string"), hi.cast("string")), names, strict=True)]

    if exact:
        each = [df.groupBy(F.col(f).alias("v")).agg(F.count("*").alias("n")).agg(*row(f, F.coalesce(F.sum("n"), F.lit(0)), F.count("v"), F.min("v"), F.max("v"))) for f in fields]
        return reduce(DataFrame.unionByName, each)
    aggs = [F.count("*").alias("n")]
    for i, f in enumerate(fields):
        aggs += [F.approx_count_distinct(f).alias(f"d{i}"), F.min(f).alias(f"lo{i}"), F.max(f).alias(f"hi{i}")]
    rows = F.array(*(F.struct(*row(f, F.col("n"), F.col(f"d{i}"), F.col(f"lo{i}"), F.col(f"hi{i}"))) for i, f in enumerate(fields)))
    return df.agg(*aggs).select(F.explode(rows).alias("r")).select("r.*")


def nearest_rank(df: DataFrame, key: str, value: str, shares: dict[str, float]) -> DataFrame:
    """Exact nearest-rank percentiles: the value at place floor(n * share) of each group, counted from 0.

    Equal values are counted first. The distinct ones are dealt in ranges of (key, value); a range's sum of counts is
    one row a key, and places are numbered within ranges, so that no group has to fit into one task.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(F.col(key).alias("k"), F.col(value).alias("v")).agg(F.count("*").alias("c"))
    dealt = checkpointed(counts.repartitionByRange(F.col("k"), F.col("v")).withColumn("range", F.spark_partition_id()))
    by_key = Window.partitionBy("k")
    sums = dealt.groupBy("k", "range").agg(F.sum("c").alias("s"))
    before = F.coalesce(F.sum("s").over(by_key.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(F.col("k").alias("of"), F.col("range").alias("in"), before.alias("before"), F.sum("s").over(by_key).alias("n"))
    rows = dealt.join(sums, F.col("k").eqNullSafe(F.col("of")) & (F.col("range") == F.col("in")))
    upto = F.col("before") + F.sum("c").over(Window.partitionBy("k", "range").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("upto", upto)
    at = []
    for name, share in shares.items():
        place = F.least(F.floor(F.col("n") * share) + 1, F.col("n"))
        at.append(F.max(F.when((F.col("upto") >= place) & (F.col("upto") - F.col("c") < place), F.col("v"))).alias(name))
    return rows.groupBy(F.col("k").alias(key)).agg(F.min("v").alias("least"), F.max("v").alias("greatest"), *at)


def percentiles(df: DataFrame, key: str, value: str, shares: dict[str, float], accuracy: int = 10_000) -> DataFrame:
    """Approximate percentiles by a sketch: partial aggregates only."""
    return df.groupBy(key).agg(*(F.percentile_approx(value, share, accuracy).alias(name) for name, share in shares.items()))


def verified(df: DataFrame, columns: list[str], stored: Column, algorithm: str = "crc32") -> DataFrame:
    """df with intact: whether the record's checksum is the stored one."""
    return df.withColumn("intact", checksum(*columns, algorithm=algorithm).eqNullSafe(stored))
