"""Aggregate expressions: bits, accuracy, entropy, divergence, quantiles and null statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bits(p: Column) -> Column:
    """Mean cross-entropy in bits of the probability given to the true class."""
    return F.avg(-F.log2(F.greatest(p, F.lit(1e-12))))


def binary_bits(p: Column, y: Column) -> Column:
    clipped = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
    return F.avg(-F.log2(F.when(y == 1, clipped).otherwise(1 - clipped)))


def accuracy(pred: Column, y: Column) -> Column:
    return F.avg((pred == y).cast("int"))


def share(condition: Column) -> Column:
    return F.avg(condition.cast("int"))


def null_z(value: Column, draws: Column) -> Column:
    """Standardised against the null draws: population deviation, guarded."""
    return (value - F.avg(draws)) / (F.stddev_pop(draws) + F.lit(1e-30))


def histogram(df: DataFrame, col: str) -> DataFrame:
    """(col, n, p): counts by value with their share."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select(col, "n", (F.col("n") / F.col("total")).alias("p"))


def entropy(df: DataFrame, col: str) -> DataFrame:
    return histogram(df, col).agg(F.sum(-F.col("p") * F.log2("p")).alias("entropy"))


def divergence(test: DataFrame, train: DataFrame, col: str) -> DataFrame:
    """KL(test || train) of symbol shares in bits, train shares floored at 1e-12."""
    e = histogram(test, col).select(col, F.col("p").alias("pe"))
    t = histogram(train, col).select(col, F.col("p").alias("pt"))
    ratio = F.col("pe") / F.greatest(F.coalesce("pt", F.lit(0.0)), F.lit(1e-12))
    return e.join(t, col, "left").agg(F.sum(F.col("pe") * F.log2(ratio)).alias("kl"))


def softmax(logits: Column, temperature: Column | float = 1.0) -> Column:
    """Softmax of an array column, shifted by its maximum."""
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp((x - top) / t))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))
