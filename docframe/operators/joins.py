"""Nested and flat joins."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import array_path, known, predicate


def nested(left: DataFrame, right: DataFrame, on: tuple[str, str], how: str = "left", as_: str = "joined", order: str | None = None) -> DataFrame:
    """One row for each left row, with the matching right rows in an array of structs, in order of `order`.

    Null keys never match. inner drops left rows without a match; right adds each unmatched right row alone, with a
    null left side. Columns: left (a struct) and as_.
    """
    lk, rk = on
    if how not in ("left", "inner", "right"):
        raise ValueError(f"not a join type: {how!r}")
    row = F.struct(*(F.col(c) for c in right.columns))
    packed = F.struct(F.col(order or rk).alias("o"), row.alias("r"))
    groups = right.filter(F.col(rk).isNotNull()).groupBy(F.col(rk).alias("_key")).agg(F.transform(F.array_sort(F.collect_list(packed)), lambda x: x["r"]).alias(as_))
    one = left.select(F.struct(*left.columns).alias("left"), F.col(lk).alias("_lk"))
    none = F.array().cast(groups.schema[as_].dataType)
    out = one.join(groups, F.col("_lk") == F.col("_key"), "inner" if how != "left" else "left").select("left", F.coalesce(as_, none).alias(as_))
    if how == "right":
        alone = right.join(left.select(F.col(lk).alias("_lk")).distinct(), F.col(rk) == F.col("_lk"), "left_anti")
        out = out.unionByName(alone.select(F.lit(None).cast(out.schema["left"].dataType).alias("left"), F.array(row).cast(out.schema[as_].dataType).alias(as_)))
    return out


def flat(left: DataFrame, right: DataFrame, on: tuple[str, str], how: str = "inner") -> DataFrame:
    return left.join(right, left[on[0]] == right[on[1]], how)


def chain(base: DataFrame, *steps: tuple[DataFrame, str, str, str]) -> DataFrame:
    """Flat joins one after another; each step is (right, left key, right key, type)."""
    return reduce(lambda df, s: df.join(s[0], df[s[1]] == s[0][s[2]], s[3]), steps, base)


def nested_chain(joined: DataFrame, id_of: Column, array: str, key: str, right: DataFrame, right_key: str, right_id: str, as_: str, how: str = "left") -> DataFrame:
    """Joins on all keys within a nested array: each row gets the distinct right rows that any element matches."""
    keys = joined.select(id_of.alias("_id"), F.explode(array_path(F.col(array), key)).alias("_k")).distinct()
    hits = keys.join(right, F.col("_k") == F.col(right_key)).select("_id", F.struct(*right.columns).alias("_r"), F.col(right_id).alias("_rid")).dropDuplicates(["_id", "_rid"])
    groups = hits.groupBy("_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_rid", "_r"))), lambda x: x["_r"]).alias(as_))
    out = joined.withColumn("_own", id_of).join(groups, F.col("_own") == F.col("_id"), "left" if how == "left" else "inner").drop("_own", "_id")
    return out.withColumn(as_, F.coalesce(as_, F.array().cast(groups.schema[as_].dataType)))


def where_any(joined: DataFrame, arrays: list[str], field: str, op: str, value) -> DataFrame:
    """Rows of which any joined struct satisfies the predicate."""
    return joined.filter(reduce(lambda a, b: a | b, (F.exists(a, lambda x: known(predicate(x[field], op, value))) for a in arrays)))


class JoinQuery:
    """A chain of calls over nested joins: rows of left, a struct, and arrays of joined structs.

    A path is a field of the left row; `array.field`, the field of the first joined row; or `array[].field`, that of all.
    As in the builder, sort keys and selected columns are kept beside the rows, so that calls come in any order.
    """

    def __init__(self, joined: DataFrame, orders: tuple[Column, ...] = (), columns: tuple[Column, ...] = ()):
        self._rows, self._orders, self._columns = joined, orders, columns

    def _with(self, rows: DataFrame) -> JoinQuery:
        return JoinQuery(rows, self._orders, self._columns)

    def _col(self, path: str) -> Column:
        array, dot, field = path.partition(".")
        name = array.removesuffix("[]")
        if not dot or name == "left" or name not in self._rows.columns:
            return F.col(f"left.{path.removeprefix('left.')}")
        return array_path(F.col(name), field, first=not array.endswith("[]"))

    @property
    def _sorted(self) -> DataFrame:
        return self._rows.orderBy(*self._orders) if self._orders else self._rows

    @property
    def df(self) -> DataFrame:
        return self._sorted.select(*self._columns) if self._columns else self._sorted

    def where(self, path: str, op: str, value) -> JoinQuery:
        """Of an array[] path any element may satisfy the predicate."""
        c = self._col(path)
        if "[]." in path:
            return self._with(self._rows.filter(F.exists(c, lambda x: known(predicate(x, op, value)))))
        return self._with(self._rows.filter(predicate(c, op, value)))

    def where_any(self, field: str, op: str, value, arrays: list[str] | None = None) -> JoinQuery:
        names = arrays or [c for c, k in self._rows.dtypes if k.startswith("array<struct")]
        names = [n for n in names if field in self._rows.schema[n].dataType.elementType.fieldNames()]
        return self._with(where_any(self._rows, names, field, op, value))

    def where_fn(self, fn: Callable) -> JoinQuery:
        """fn(DataFrame) returns a Column; null is false."""
        return self._with(self._rows.filter(fn(self._rows)))

    def order_by(self, path: str, desc: bool = False) -> JoinQuery:
        """Nulls last in ascending order, first in descending; the later call is the major key."""
        c = self._col(path)
        return JoinQuery(self._rows, (c.desc_nulls_first() if desc else c.asc_nulls_last(), *self._orders), self._columns)

    def limit(self, n: int) -> JoinQuery:
        return self._with(self._sorted.limit(n)) if n > 0 else self

    def skip(self, n: int) -> JoinQuery:
        return self._with(self._sorted.offset(n))

    def select(self, **paths: str) -> JoinQuery:
        return JoinQuery(self._rows, self._orders, tuple(self._col(p).alias(name) for name, p in paths.items()))

    def aggregate(self, path: str, op: str) -> DataFrame:
        """A scalar, value; the elements of an array[] path count one by one, and count counts rows."""
        if op == "count":
            return self._rows.agg(F.count("*").alias("value"))
        c = F.explode(self._col(path)) if "[]." in path else self._col(path)
        return self._rows.select(c.alias("v")).agg(getattr(F, op)("v").alias("value"))

    def group_by(self, path: str, over: str, op: str = "count", name: str = "value") -> DataFrame:
        c = F.explode_outer(self._col(over)) if "[]." in over else self._col(over)
        rows = self._rows.select(self._col(path).alias("key"), c.alias("v"))
        return rows.groupBy("key").agg(F.coalesce(getattr(F, op)("v"), F.lit(0)).alias(name))

    def count(self) -> int:
        return self._rows.count()


def aggregate(joined: DataFrame, array: str, field: str, op: str) -> DataFrame:
    """A scalar over a field of all nested structs; count counts rows."""
    if op == "count":
        return joined.agg(F.count("*").alias("value"))
    return joined.select(F.explode(array_path(F.col(array), field)).alias("v")).agg(getattr(F, op)("v").alias("value"))


def group_by(joined: DataFrame, key: Column, array: str, field: str, op: str = "count", name: str = "value") -> DataFrame:
    rows = joined.select(key.alias("key"), F.explode_outer(array_path(F.col(array), field)).alias("v"))
    return rows.groupBy("key").agg(F.coalesce(getattr(F, op)("v"), F.lit(0)).alias(name))


def linked(target: DataFrame, source: DataFrame, target_id: str, source_ref: str, name: str, compute: Column | Callable) -> DataFrame:
    """A field computed for each target row from the source rows that refer to it.

    compute is an aggregate Column; or a callable from a pandas DataFrame to a double, which gets one group at a time
    and so needs groups that fit into a task.
    """
    if isinstance(compute, Column):
        groups = source.groupBy(F.col(source_ref).alias("_ref")).agg(compute.alias(name))
    else:
        import pandas as pd

        def one(key, pdf):
            return pd.DataFrame({"_ref": [key[0]], name: [float(compute(pdf))]})

        groups = source.groupBy(source_ref).applyInPandas(one, f"_ref {source.schema[source_ref].dataType.simpleString()}, {name} double")
    return target.join(groups, F.col(target_id) == F.col("_ref"), "left").drop("_ref")
