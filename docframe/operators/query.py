"""The chainable builder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import known, negated, path, predicate


def type_of(df: DataFrame, name: str) -> T.DataType | None:
    """The type of a dotted path, None where it isn't known."""
    kind: T.DataType = df.schema
    for part in name.split("."):
        if not isinstance(kind, T.StructType) or part not in kind.fieldNames():
            return None
        kind = kind[part].dataType
    return kind


class Query:
    """Each call wraps a new plan; nothing runs before first, last, count, pluck or rows.

    The plan is kept as rows, the keys they are sorted by (major key first) and the columns that are selected, so that
    filters and further keys can come after a sort or a selection; df puts the three together.
    """

    def __init__(self, rows: DataFrame, orders: tuple[Column, ...] = (), names: tuple[str, ...] = ()):
        self._rows, self._orders, self._names = rows, orders, names

    def _with(self, rows: DataFrame) -> Query:
        return Query(rows, self._orders, self._names)

    @property
    def _sorted(self) -> DataFrame:
        return self._rows.orderBy(*self._orders) if self._orders else self._rows

    @property
    def df(self) -> DataFrame:
        return self._sorted.select(*(self._col(n)[0].alias(n) for n in self._names)) if self._names else self._sorted

    def _col(self, name: str) -> tuple[Column, T.DataType | None]:
        kind = type_of(self._rows, f"data.{name}")
        return path(name, self._rows.schema), kind if kind is not None else type_of(self._rows, name)

    def where(self, name: str, op: str, value) -> Query:
        c, kind = self._col(name)
        return self._with(self._rows.filter(predicate(c, op, value, kind)))

    def where_not(self, name: str, op: str, value) -> Query:
        """The rows that where() leaves out, those with nulls included."""
        c, kind = self._col(name)
        return self._with(self._rows.filter(negated(c, op, value, kind)))

    def where_fn(self, fn: Callable) -> Query:
        """Rows for which fn holds; null is false.

        fn(DataFrame) returns a Column. A callable with .batches = True gets a pandas DataFrame of many rows and returns
        a series of bools: Arrow batches, no call a row. One with .python = True gets a Row and returns a bool, a row at
        a time: the slow form, for callables that can't be written otherwise.
        """
        if getattr(fn, "batches", False):
            def kept(parts: Iterator) -> Iterator:
                for pdf in parts:
                    yield pdf[fn(pdf).fillna(False).astype(bool)]

            return self._with(self._rows.mapInPandas(kept, self._rows.schema))
        if getattr(fn, "python", False):
            return self._with(self._rows.filter(F.udf(lambda r: bool(fn(r)), "boolean")(F.struct("*"))))
        return self._with(self._rows.filter(fn(self._rows)))

    def find(self, **equals) -> Query:
        q = self
        for k, v in equals.items():
            q = q.where(k, "eq", v)
        return q

    def order_by(self, name: str, desc: bool = False) -> Query:
        """Nulls last in ascending order, first in descending. Of chained calls the later is the major key."""
        c = self._col(name)[0]
        return Query(self._rows, (c.desc_nulls_first() if desc else c.asc_nulls_last(), *self._orders), self._names)

    def limit(self, n: int) -> Query:
        return self._with(self._sorted.limit(n)) if n > 0 else self

    def skip(self, n: int) -> Query:
        return self._with(self._sorted.offset(n))

    def select(self, *names: str) -> Query:
        return Query(self._rows, self._orders, names)

    def distinct(self, name: str) -> DataFrame:
        return self._rows.select(self._col(name)[0].alias(name)).distinct()

    def pluck(self, name: str) -> list:
        return [r[0] for r in self._sorted.select(self._col(name)[0]).collect()]

    def first(self):
        return self.df.first()

    def last(self):
        rows = self.df.tail(1)
        return rows[0] if rows else None

    def count(self) -> int:
        return self._rows.count()

    def rows(self) -> list:
        return self.df.collect()


def point(df: DataFrame, id_col: str, value) -> DataFrame:
    return df.filter(predicate(F.col(id_col), "eq", value, type_of(df, id_col))).limit(1)


def multi(df: DataFrame, id_col: str, values: list) -> DataFrame:
    """Rows with these ids in the order of the list, which the caller's call bounds; missing ids are skipped."""
    spark = df.sparkSession
    wanted = spark.createDataFrame([(i, v) for i, v in enumerate(values)], T.StructType([T.StructField("_pos", T.IntegerType()), T.StructField("_id", df.schema[id_col].dataType)]))
    return wanted.join(df, F.col("_id") == F.col(id_col)).orderBy("_pos").drop("_pos", "_id")


def between(df: DataFrame, name: str, start=None, end=None, closed: tuple[bool, bool] = (True, True)) -> DataFrame:
    """Rows in a range; an open end is None, closed says whether each end belongs to it; nulls never match."""
    c = F.col(name)
    out = df.filter(c.isNotNull())
    if start is not None:
        out = out.filter(c >= start if closed[0] else c > start)
    if end is not None:
        out = out.filter(c <= end if closed[1] else c < end)
    return out


def ends(df: DataFrame, name: str) -> DataFrame:
    """(least, greatest) of a key: Parquet answers from its statistics."""
    return df.agg(F.min(name).alias("least"), F.max(name).alias("greatest"))


def prefix(df: DataFrame, name: str, value: str) -> DataFrame:
    return df.filter(predicate(F.col(name), "startswith", value))


class ColumnView:
    """Columns of a collection, for filters, selections and aggregates that read only the columns they name."""

    def __init__(self, df: DataFrame, names: list[str] | None = None):
        self.df = df.select(*(names or df.columns))

    def filter(self, name: str, op: str, value) -> ColumnView:
        return ColumnView(self.df.filter(predicate(F.col(name), op, value, type_of(self.df, name))))

    def select(self, *names: str) -> DataFrame:
        return self.df.select(*names)

    def mask(self, name: str, op: str, value) -> DataFrame:
        """The rows with match, a two-valued column."""
        return self.df.withColumn("match", known(predicate(F.col(name), op, value, type_of(self.df, name))))

    def group(self, key: str, field: str | None = None, op: str = "count", none_label: str = "__none__") -> DataFrame:
        from . import aggregates

        return aggregates.grouped(self.df, key, field, op, none_label)
