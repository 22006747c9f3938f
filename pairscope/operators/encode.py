"""Dictionary codes and cell ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def dictionary(df: DataFrame, field: str) -> DataFrame:
    """(field, code): distinct values in sorted order from 0; null, where present, gets the last code."""
    values = df.select(field).distinct()
    order = Window.orderBy(F.col(field).asc_nulls_last())
    return values.withColumn("code", F.row_number().over(order) - 1)


def encode(df: DataFrame, fields: list[str], suffix: str = "_code") -> DataFrame:
    """df with a code column per field.  The dictionaries are as large as the alphabets; the optimizer picks the join."""
    out = df
    for f in fields:
        d = dictionary(df, f).select(F.col(f).alias("__v"), F.col("code").alias(f + suffix))
        out = out.join(d, F.col(f).eqNullSafe(F.col("__v")), "left").drop("__v")
    return out


def cell_id(a: Column, b: Column, size_b: int) -> Column:
    return a * size_b + b


def cell_parts(cell: Column, size_b: int) -> tuple[Column, Column]:
    return F.floor(cell / size_b).cast("int"), (cell % size_b).cast("int")


def field_sizes(df: DataFrame, fields: list[str]) -> DataFrame:
    """One row: the exact number of distinct values of each field."""
    return df.agg(*[F.countDistinct(f).alias(f) for f in fields])


def degenerate_fields(df: DataFrame, fields: list[str], least: int = 3) -> DataFrame:
    """(field, n_values, degenerate) per field, counted in one pass over distinct (field, value)."""
    each = df.select(F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])))
    return each.groupBy("field").agg(F.countDistinct("value").alias("n_values")).withColumn("degenerate", F.col("n_values") < least)
