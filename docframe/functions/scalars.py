"""Scalar functions with the documented null and edge behaviour."""

from __future__ import annotations

import re
from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

__all__ = [
    "add", "array_path", "checksum", "concat", "csv_cell", "date_text", "divide", "duration", "length", "like", "modulo", "multiply",
    "now", "path", "replace", "round_half_even", "round_scaled", "shard_of", "substr", "subtract", "timestamp", "tokens", "trim",
]


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def add(a: Column, b: Column) -> Column:
    return _zero(a) + _zero(b)


def subtract(a: Column, b: Column) -> Column:
    return _zero(a) - _zero(b)


def multiply(a: Column, b: Column) -> Column:
    return _zero(a) * _zero(b)


def _divisor(b: Column) -> Column:
    return F.coalesce(F.nullif(b, F.lit(0)), F.lit(1))


def divide(a: Column, b: Column) -> Column:
    """True division; a null or zero divisor counts as 1."""
    return _zero(a).cast("double") / _divisor(b)


def modulo(a: Column, b: Column) -> Column:
    """The remainder that has the divisor's sign; a null or zero divisor counts as 1."""
    d = _divisor(b)
    r = _zero(a) % d
    return F.when((r != 0) & ((r < 0) != (d < 0)), r + d).otherwise(r)


def length(s: Column) -> Column:
    return F.coalesce(F.length(s), F.lit(0))


def substr(s: Column, start: int = 0, n: int | None = None) -> Column:
    """Counts from 0; a negative start counts from the end."""
    begin = F.lit(start + 1) if start >= 0 else F.greatest(F.length(s) + start + 1, F.lit(1))
    return F.substring(s, begin, F.lit(n) if n is not None else F.length(s) + 1)


def concat(*parts: Column) -> Column:
    """Nulls are skipped."""
    return F.concat_ws("", *parts)


def trim(s: Column) -> Column:
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def replace(s: Column, old: str, new: str) -> Column:
    return F.replace(s, F.lit(old), F.lit(new))


def round_half_even(x: Column, n: int = 0) -> Column:
    return F.bround(x, n)


def round_scaled(x: Column, n: int = 0) -> Column:
    """A double times 10**n, to the nearest whole number (halves away from zero), scaled back, as DuckDB rounds; F.round goes by the decimal text."""
    return F.round(x * 10.0**n) / 10.0**n


def like(c: Column, pattern: str, negated: bool = False) -> Column:
    """LIKE and NOT LIKE, both false for null."""
    return F.coalesce(~c.like(pattern) if negated else c.like(pattern), F.lit(False))


def now() -> Column:
    return F.unix_micros(F.current_timestamp()) / 1e6


def date_text() -> Column:
    return F.date_format(F.current_date(), "yyyy-MM-dd")


def tokens(text: Column) -> Column:
    """Runs of a-z and runs of 0-9 of the text in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]+|[0-9]+"), F.lit(0))


def shard_of(key: Column, n: int) -> Column:
    """The first 4 bytes of the key's MD5, modulo n."""
    return (F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % n).cast("int")


def checksum(*columns: str, algorithm: str = "crc32") -> Column:
    """CRC32 or the first 16 hex digits of SHA-256 of the JSON of columns in order of name."""
    text = F.to_json(F.struct(*(F.col(c) for c in sorted(columns))), {"ignoreNullFields": "false"})
    return F.crc32(text.cast("binary")) if algorithm == "crc32" else F.substring(F.sha2(text, 256), 1, 16)


def _has(kind: T.DataType, parts: list[str]) -> bool:
    for p in parts:
        if not isinstance(kind, T.StructType) or p not in kind.fieldNames():
            return False
        kind = kind[p].dataType
    return True


def path(name: str, schema: T.StructType) -> Column:
    """A dotted path: what data has under it, else, where that is null or missing, what the row itself has."""
    parts = name.split(".")
    if not _has(schema, ["data", *parts]):
        return F.col(name)
    return F.coalesce(F.col(f"data.{name}"), F.col(name)) if _has(schema, parts) else F.col(f"data.{name}")


def array_path(array: Column, field: str, first: bool = False) -> Column:
    """A field of each struct of an array, or of the first one."""
    return F.get(array, 0)[field] if first else F.transform(array, lambda x: x[field])


def csv_cell(s: Column, kind: str) -> Column:
    """A CSV cell as long, double, boolean or string; blank and unreadable cells are null."""
    t = F.when(F.trim(s) != "", s)
    return t if kind == "string" else t.try_cast(kind)


def duration(text: str) -> float:
    """Seconds of texts like 5m; units s, m, h, d, w, others count as seconds; not a number is 0."""
    units = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}
    m = re.fullmatch(r"\s*([0-9]*\.?[0-9]+)\s*([a-zA-Z]?)\s*", str(text))
    return float(m[1]) * units.get(m[2].lower(), 1) if m else 0.0


def timestamp(value) -> datetime:
    """A number of seconds, or one of three ISO forms, as UTC."""
    if isinstance(value, datetime):
        return value
    if isinstance(value, (int, float)):
        return datetime.fromtimestamp(value, UTC).replace(tzinfo=None)
    for form in ("%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d"):
        try:
            return datetime.strptime(value, form)
        except ValueError:
            continue
    raise ValueError(f"not a time: {value!r}")
