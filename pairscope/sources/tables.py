"""Table sources: parquet folders, CSV files, the field rule, pinned binary corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def csv_table(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """A CSV file with a header; the schema is inferred only where none is given."""
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema is not None else reader.option("inferSchema", True)).csv(path)


def categorical_fields(df: DataFrame, target: str, fields: str | list[str] | None = None) -> list[str]:
    """The named fields (a list or comma-separated), or every string column but the target."""
    if fields:
        names = fields.split(",") if isinstance(fields, str) else list(fields)
        missing = [n for n in names if n not in df.columns]
        if missing:
            raise ValueError(f"no such field: {', '.join(missing)}")
        return names
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name != target]


def binary_target(df: DataFrame, target: str) -> DataFrame:
    """df with y, the target as 0 or 1; any other value raises when it is read."""
    y = F.col(target).cast("int")
    return df.withColumn("y", F.when(y.isin(0, 1), y).otherwise(F.raise_error(F.concat(F.lit(f"{target} must be 0 or 1, found "), F.coalesce(F.col(target).cast("string"), F.lit("null")))).cast("int")))


def pinned_corpus(spark: SparkSession, path: str, size: int, sha256: str) -> DataFrame:
    """One row (content) with the first `size` bytes of a file; reading fails unless they have the given digest."""
    raw = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, size).alias("content"))
    found = F.sha2("content", 256)
    return raw.select(F.when(found == sha256, F.col("content")).otherwise(F.raise_error(F.concat(F.lit("corpus changed: sha256 "), found)).cast("binary")).alias("content"))
