"""Collections and the database facade.

A collection is a DataFrame under a name. Changes make new DataFrames; nothing is stored until it is written. For many
writes use operators.logged, whose plans don't grow with them.
"""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import predicate
from . import aggregates, query, search


class Collection:
    """Reads of one named DataFrame. Ids of inserted rows are made on the driver, with the rows."""

    def __init__(self, db: Database, name: str):
        self.db, self.name = db, name

    @property
    def df(self) -> DataFrame:
        return self.db.tables[self.name]

    def _set(self, df: DataFrame) -> None:
        self.db.register(self.name, df)

    def query(self) -> query.Query:
        return query.Query(self.df)

    def all(self, limit: int | None = None, offset: int = 0) -> DataFrame:
        df = self.df.offset(offset) if offset else self.df
        return df.limit(limit) if limit else df

    def get(self, id_value, id_col: str = "id") -> DataFrame:
        return query.point(self.df, id_col, id_value)

    def get_many(self, ids: list, id_col: str = "id") -> DataFrame:
        return query.multi(self.df, id_col, ids)

    def find(self, **equals) -> DataFrame:
        return self.query().find(**equals).df

    def find_by(self, field: str, value) -> DataFrame:
        return self.query().where(field, "eq", value).df

    def range(self, field: str, start=None, end=None) -> DataFrame:
        return query.between(self.df, field, start, end)

    def find_prefix(self, field: str, value: str) -> DataFrame:
        return query.prefix(self.df, field, value)

    def search(self, keyword: str, order: str = "id", limit: int = 50) -> DataFrame:
        return search.text_search(self.df, keyword, order, limit)

    def count(self) -> int:
        return self.df.count()

    def exists(self, id_value, id_col: str = "id") -> bool:
        return not self.get(id_value, id_col).isEmpty()

    def distinct(self, field: str) -> DataFrame:
        return self.query().distinct(field)

    def aggregate(self, field: str, op: str) -> DataFrame:
        return aggregates.scalar(self.df, field, op)

    def group_by(self, key: str, field: str | None = None, op: str = "count") -> DataFrame:
        return aggregates.grouped(self.df, key, field, op)

    def analyze(self, fields: list[str] | None = None) -> DataFrame:
        return aggregates.field_stats(self.df, fields or [c for c, k in self.df.dtypes if not k.startswith(("array", "map", "struct"))])

    def insert(self, *rows: dict) -> list[str]:
        """Appends rows with new ids and version 1."""
        now, ids = time.time(), [uuid.uuid4().hex for _ in rows]
        kinds = self.df.schema
        full = [{"id": i, "created_at": now, "updated_at": now, "version": 1} | r for i, r in zip(ids, rows, strict=True)]
        self._set(self.df.unionByName(self.db.spark.createDataFrame([tuple(r.get(f.name) for f in kinds) for r in full], kinds)))
        self.db.events.emit("record.inserted", collection=self.name, ids=ids)
        return ids

    def insert_df(self, rows: DataFrame) -> None:
        self._set(self.df.unionByName(rows, allowMissingColumns=True))

    def update_many(self, where: Column, values: dict) -> None:
        """Sets fields of matching rows to values or Columns; version goes up."""
        hit = F.coalesce(where, F.lit(False))
        new = {k: F.when(hit, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(k) if k in self.df.columns else F.lit(None)) for k, v in values.items()}
        if "version" in self.df.columns and "version" not in values:
            new["version"] = F.when(hit, F.col("version") + 1).otherwise(F.col("version"))
        self._set(self.df.withColumns(new))
        self.db.events.emit("record.updated", collection=self.name, fields=sorted(values))

    def update(self, id_value, values: dict, id_col: str = "id") -> None:
        self.update_many(F.col(id_col) == id_value, values)

    def delete_many(self, where: Column) -> None:
        self._set(self.df.filter(~F.coalesce(where, F.lit(False))))
        self.db.events.emit("record.deleted", collection=self.name)

    def delete(self, *ids, id_col: str = "id") -> None:
        self.delete_many(predicate(F.col(id_col), "in", list(ids)))


class EventBus:
    """Callbacks by topic: collection.created, collection.dropped, record.inserted, record.updated, record.deleted.

    Callbacks run on the driver, with the collection's name and what the call was given; their errors are kept, not raised.
    """

    TOPICS = ("collection.created", "collection.dropped", "record.inserted", "record.updated", "record.deleted")

    def __init__(self):
        self._held: dict[str, tuple[str, Callable]] = {}
        self.errors: list[tuple[str, Exception]] = []

    def on(self, topic: str, callback: Callable) -> str:
        """A handle for off()."""
        handle = uuid.uuid4().hex
        self._held[handle] = (topic, callback)
        return handle

    def off(self, handle: str) -> bool:
        return self._held.pop(handle, None) is not None

    def emit(self, topic: str, **about) -> int:
        """Calls a topic's callbacks in the order in which they came; how many there were."""
        mine = [f for t, f in self._held.values() if t == topic]
        for f in mine:
            try:
                f(about)
            except Exception as e:  # noqa: BLE001
                self.errors = [*self.errors[-99:], (topic, e)]
        return len(mine)


class Database:
    """Named collections, SQL over them, and a history of statements. Indexes are names only: scans prune by statistics."""

    SLOW_MS, KEPT = 100.0, 1000

    def __init__(self, spark: SparkSession):
        self.spark, self.tables, self.indexes, self.events = spark, {}, {}, EventBus()
        self.statements: list[tuple[str, float, str | None]] = []

    def register(self, name: str, df: DataFrame) -> Collection:
        new = name not in self.tables
        self.tables[name] = df
        df.createOrReplaceTempView(name)
        if new:
            self.events.emit("collection.created", collection=name)
        return Collection(self, name)

    def collection(self, name: str) -> Collection:
        if name not in self.tables:
            raise KeyError(f"no collection {name!r}")
        return Collection(self, name)

    def collections(self) -> list[str]:
        return sorted(self.tables)

    def drop(self, name: str) -> None:
        del self.tables[name]
        self.spark.catalog.dropTempView(name)
        self.indexes = {k: v for k, v in self.indexes.items() if v[0] != name}
        self.events.emit("collection.dropped", collection=name)

    def stats(self) -> dict[str, int]:
        return {name: df.count() for name, df in self.tables.items()}

    def explain(self, statement: str, mode: str = "formatted") -> str:
        df = self.spark.sql(statement)
        return self.spark.sparkContext._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)

    def execute(self, statement: str) -> DataFrame | None:
        """SELECT by Spark's own parser; INSERT, UPDATE, DELETE and DDL change the named collections."""
        began = time.time()
        error = None
        try:
            return self._execute(statement.strip().rstrip(";"))
        except Exception as e:
            error = str(e)
            raise
        finally:
            self.statements = [*self.statements[1 - self.KEPT :], (statement, (time.time() - began) * 1000, error)]

    def slow(self) -> list[tuple[str, float, str | None]]:
        return [s for s in self.statements if s[1] >= self.SLOW_MS]

    def _execute(self, s: str) -> DataFrame | None:
        if m := re.fullmatch(r"(?is)INSERT\s+INTO\s+(\w+)\s*(?:\(([^)]*)\))?\s*(VALUES.*|SELECT.*)", s):
            name, columns, body = m.groups()
            old = self.tables[name]
            names = [c.strip() for c in columns.split(",")] if columns else old.columns
            rows = self.spark.sql(f"SELECT * FROM ({body})").toDF(*names)
            rows = rows.select(*((F.col(f.name) if f.name in names else F.lit(None)).cast(f.dataType).alias(f.name) for f in old.schema))
            self.register(name, old.unionByName(rows))
        elif m := re.fullmatch(r"(?is)UPDATE\s+(\w+)\s+SET\s+(.*)", s):
            name, (sets, where) = m[1], _at_where(m[2])
            values = {k.strip(): F.expr(v) for k, v in (x.split("=", 1) for x in _commas(sets))}
            self.collection(name).update_many(F.expr(where) if where else F.lit(True), values)
        elif m := re.fullmatch(r"(?is)DELETE\s+FROM\s+(\w+)(?:\s+WHERE\s+(.*))?", s):
            self.collection(m[1]).delete_many(F.expr(m[2]) if m[2] else F.lit(True))
        elif m := re.fullmatch(r"(?is)CREATE\s+TABLE\s+(\w+)\s*\((.*)\)", s):
            self.register(m[1], self.spark.createDataFrame([], m[2]))
        elif m := re.fullmatch(r"(?is)DROP\s+TABLE\s+(\w+)", s):
            self.drop(m[1])
        elif m := re.fullmatch(r"(?is)CREATE\s+INDEX\s+(\w+)\s+ON\s+(\w+)\s*\(\s*(\w+)\s*\)", s):
            self.indexes[m[1]] = (m[2], m[3])
        elif m := re.fullmatch(r"(?is)DROP\s+INDEX\s+(\w+)", s):
            self.indexes.pop(m[1], None)
        elif m := re.fullmatch(r"(?is)EXPLAIN\s+(.*)", s):
            return self.spark.createDataFrame([(self.explain(m[1]),)], "plan string")
        else:
            return self.spark.sql(s)
        return None


def _at_where(text: str) -> tuple[str, str | None]:
    """What stands before and behind the first WHERE outside quotes and brackets."""
    bare = re.sub(r"""'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.)*"|`[^`]*`""", lambda m: "x" * len(m[0]), text)
    while (inner := re.sub(r"\([^()]*\)", lambda m: "x" * len(m[0]), bare)) != bare:
        bare = inner
    m = re.search(r"(?i)\sWHERE\s", bare)
    return (text[: m.start()], text[m.end() :]) if m else (text, None)


def _commas(text: str) -> list[str]:
    """Parts between commas that stand in no brackets or quotes."""
    out, depth, quote, part = [], 0, "", ""
    for ch in text:
        if quote:
            quote = "" if ch == quote else quote
        elif ch in "'\"":
            quote = ch
        elif ch in "([":
            depth += 1
        elif ch in ")]":
            depth -= 1
        if ch == "," and not depth and not quote:
            out.append(part)
            part = ""
        else:
            part += ch
    return [*out, part]
