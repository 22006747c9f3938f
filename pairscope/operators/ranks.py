"""Global ranks without a single sorted partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..sources.shared import stored


def global_rank(df: DataFrame, order: list[Column | str], out: str = "rank") -> DataFrame:
    """df with its rank from 1 by the order columns, which must not tie.

    Rows are range-partitioned and stored; each range is ranked by itself and shifted by the rows of the ranges before it,
    one number per range.  No task ever holds more than a range."""
    keyed = df.select("*", *[(c if isinstance(c, Column) else F.col(c)).alias(f"__k{i}") for i, c in enumerate(order)])
    keys = [f"__k{i}" for i in range(len(order))]
    placed, shift = ranges(keyed, keys, F.count(F.lit(1)))
    within = F.row_number().over(Window.partitionBy("__range").orderBy(*keys))
    return placed.withColumn("__at", within).join(F.broadcast(shift), "__range").withColumn(out, F.col("__before") + F.col("__at")).drop("__range", "__before", "__at", *keys)


def sum_before(df: DataFrame, order: list[str], value: str, out: str = "before") -> DataFrame:
    """df with the sum of a column over all rows before by the order columns, which must not tie; as global_rank does."""
    placed, shift = ranges(df, order, F.sum(value))
    within = F.sum(value).over(Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return placed.withColumn("__at", F.coalesce(within, F.lit(0))).join(F.broadcast(shift), "__range").withColumn(out, F.col("__before") + F.col("__at")).drop("__range", "__before", "__at")


def ranges(df: DataFrame, keys: list[str], total: Column) -> tuple[DataFrame, DataFrame]:
    """Stored rows in range partitions (__range), and (__range, __before): the total over the ranges before each."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = stored(df.repartitionByRange(n, *keys).withColumn("__range", F.spark_partition_id()), "ranges")
    sizes, before, offsets = sorted((r["__range"], r["size"]) for r in placed.groupBy("__range").agg(total.alias("size")).collect()), 0, []
    for k, size in sizes:
        offsets.append((k, before))
        before += size
    return placed, df.sparkSession.createDataFrame(offsets, "__range int, __before long")
