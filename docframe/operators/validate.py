"""Checks of fields, as columns."""

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Field:
    """One field's rules. validator is a callable from Column to Column; with batches=True from a pandas series to one of
    bools, by Arrow batches; with python=True from value to bool, a row at a time."""

    type: str | None = None
    required: bool = False
    default: object = None
    min: float | None = None
    max: float | None = None
    min_length: int | None = None
    max_length: int | None = None
    pattern: str | None = None
    choices: tuple | None = None
    validator: Callable | None = None
    python: bool = False
    batches: bool = False

    def coerced(self, c: Column) -> Column:
        if self.type == "boolean":
            c = F.lower(c.cast("string")).isin("true", "1", "yes")
        elif self.type:
            c = c.try_cast(self.type)
        return c if self.default is None else F.coalesce(c, F.lit(self.default))

    def _judged(self, c: Column) -> Column:
        if self.batches:
            check = self.validator

            @F.pandas_udf("boolean")
            def judge(values: pd.Series) -> pd.Series:
                return check(values).fillna(False).astype(bool)

            return judge(c)
        return F.udf(lambda v: bool(self.validator(v)), "boolean")(c) if self.python else self.validator(c)

    def errors(self, name: str, raw: Column, c: Column, kind: str) -> list[Column]:
        checks: list[tuple[Column, str]] = []
        if self.required:
            checks.append((c.isNull(), "required"))
        if self.type:
            checks.append((raw.isNotNull() & c.isNull(), f"not {self.type}"))
        if self.min is not None:
            checks.append((c < self.min, f"less than {self.min}"))
        if self.max is not None:
            checks.append((c > self.max, f"more than {self.max}"))
        size = F.size(c) if kind.startswith(("array", "map")) else F.length(c.cast("string"))
        if self.min_length is not None:
            checks.append((size < self.min_length, f"shorter than {self.min_length}"))
        if self.max_length is not None:
            checks.append((size > self.max_length, f"longer than {self.max_length}"))
        if self.pattern is not None:
            checks.append((~c.cast("string").rlike(f"^(?:{self.pattern})"), "pattern"))
        if self.choices is not None:
            checks.append((~c.isin(list(self.choices)), "choices"))
        if self.validator is not None:
            ok = self._judged(c)
            checks.append((c.isNotNull() & ~F.coalesce(ok, F.lit(False)), "validator"))
        return [F.when(F.coalesce(bad, F.lit(False)), F.lit(f"{name}: {what}")) for bad, what in checks]


def validated(df: DataFrame, schema: dict[str, Field], strict: bool = False) -> DataFrame:
    """df with its fields coerced and _errors, an array of all that is wrong; strict names unknown columns, too."""
    kinds = dict(df.dtypes)
    errors: list[Column] = []
    out = df
    for name, f in schema.items():
        raw = F.col(name) if name in df.columns else F.lit(None)
        errors += f.errors(name, raw, f.coerced(raw), kinds.get(name, "string"))
    if strict:
        errors += [F.lit(f"{c}: unknown") for c in df.columns if c not in schema]
    out = out.withColumn("_errors", F.filter(F.array(*errors), lambda e: e.isNotNull()) if errors else F.array().cast("array<string>"))
    return out.withColumns({name: f.coerced(F.col(name) if name in df.columns else F.lit(None)) for name, f in schema.items()})


def split(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with _errors)."""
    return checked.filter(F.size("_errors") == 0).drop("_errors"), checked.filter(F.size("_errors") > 0)
