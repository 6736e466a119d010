"""Two-valued predicates of the builder.

A comparison with null is false and its negation true; equality takes null for a value. Types that can't be compared
give false. In a filter, null is false already: predicate() leaves comparisons plain there, so that they reach the
scan, and says "null or ..." where a negation takes nulls. known() is for other places, where null must be false.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _no() -> Column:
    return F.lit(False)


def known(p: Column) -> Column:
    """p, with null as false."""
    return F.coalesce(p, _no())


def comparable(kind: T.DataType | None, value) -> bool:
    """Whether a column of this type and a Python value can be compared; unknown types can."""
    if kind is None or value is None:
        return True
    if isinstance(value, (list, tuple)):
        return all(comparable(kind, v) for v in value)
    if isinstance(value, bool):
        return isinstance(kind, T.BooleanType)
    if isinstance(value, (int, float)):
        return isinstance(kind, T.NumericType)
    if isinstance(value, str):
        return isinstance(kind, (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType))
    return True


def _some(values) -> tuple[list, bool]:
    """The values that aren't null, and whether one is."""
    some = [v for v in values if v is not None]
    return some, len(some) < len(list(values))


def _is_in(c: Column, v) -> Column:
    if isinstance(v, str):
        return F.lit(v).contains(_text(c))
    some, null = _some(v)
    p = c.isin(some) if some else _no()
    return c.isNull() | p if null else p


def _not_in(c: Column, v) -> Column:
    if isinstance(v, str):
        return c.isNull() | ~F.lit(v).contains(_text(c))
    some, null = _some(v)
    p = ~c.isin(some) if some else F.lit(True)
    return c.isNotNull() & p if null else c.isNull() | p


def _text(c: Column) -> Column:
    return c.cast("string")


OPS = {
    "eq": lambda c, v: c.isNull() if v is None else c == v,
    "ne": lambda c, v: c.isNotNull() if v is None else c.isNull() | (c != v),
    "gt": lambda c, v: c > v,
    "lt": lambda c, v: c < v,
    "gte": lambda c, v: c >= v,
    "lte": lambda c, v: c <= v,
    "in": _is_in,
    "nin": _not_in,
    "contains": lambda c, v: _text(c).contains(v),
    "icontains": lambda c, v: F.lower(_text(c)).contains(v.lower()),
    "startswith": lambda c, v: _text(c).startswith(v),
    "endswith": lambda c, v: _text(c).endswith(v),
    "regex": lambda c, v: _text(c).rlike(v),
    "exists": lambda c, v: c.isNotNull() if v else c.isNull(),
    "between": lambda c, v: c.between(v[0], v[1]),
}
NEGATED = {"ne": True, "nin": True}
TEXT_OPS = {"contains", "icontains", "startswith", "endswith", "regex", "exists"}


def predicate(c: Column, op: str, value, kind: T.DataType | None = None) -> Column:
    """The predicate of one filter, null where it is false; kind is the column's type, for values it can't be compared with."""
    if op not in OPS:
        raise ValueError(f"unknown operator {op!r}; one of {', '.join(OPS)}")
    if op not in TEXT_OPS and not (op in ("in", "nin") and isinstance(value, str)) and not comparable(kind, value):
        return F.lit(op in NEGATED)
    return OPS[op](c, value)


def negated(c: Column, op: str, value, kind: T.DataType | None = None) -> Column:
    """What predicate() leaves out, nulls included: NOT of a two-valued predicate."""
    return ~known(predicate(c, op, value, kind))
