"""Readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import csv_cell


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def import_json(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Objects of a JSON array; the contents of `data`, where an object has it, take the object's place."""
    reader = spark.read.option("multiLine", True)
    df = (reader.schema(schema) if schema else reader).json(path)
    return df.select("data.*") if "data" in df.columns and isinstance(df.schema["data"].dataType, T.StructType) else df


def import_csv(spark: SparkSession, path: str, kinds: dict[str, str] | None = None, skip_id: bool = True) -> DataFrame:
    """A CSV file with a header; blank cells are null. kinds gives columns' types, others are inferred."""
    if kinds is None:
        df = spark.read.csv(path, header=True, inferSchema=True)
    else:
        raw = spark.read.csv(path, header=True)
        df = raw.select(*(csv_cell(F.col(c), kinds.get(c, "string")).alias(c) for c in raw.columns))
    return df.drop("id") if skip_id else df


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def export_csv(df: DataFrame, path: str, fields: list[str] | None = None) -> None:
    """id first, then the fields; nulls are empty."""
    names = fields or df.columns
    names = [*(["id"] if "id" in df.columns else []), *(c for c in names if c != "id")]
    df.select(*(F.col(c).cast("string").alias(c) for c in names)).na.fill("").write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def backup(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def restore(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def append(rows: DataFrame, path: str) -> None:
    """Adds rows to an append-only change log."""
    rows.write.mode("append").parquet(path)
