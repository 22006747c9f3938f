"""Candidate pairs: enumeration, ranking, picking, set operations and hash sampling."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.hashing import digest


def all_pairs(names: list) -> list[tuple]:
    return [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]


def pairs_frame(spark: SparkSession, count: int) -> DataFrame:
    """(i, j) with i < j below count, by a theta join of two ranges (count is a number of fields)."""
    left = spark.range(count).select(F.col("id").cast("int").alias("i"))
    right = spark.range(count).select(F.col("id").cast("int").alias("j"))
    return left.join(right, F.col("i") < F.col("j"))


def pool(size: int) -> tuple[int, list[tuple[int, int]]]:
    """The window that offers at least `size` lag pairs, and its first `size` pairs."""
    window = math.ceil((1 + math.sqrt(1 + 8 * size)) / 2)
    return window, all_pairs(list(range(window)))[:size]


def ranked(scores: DataFrame, by: str = "score", ascending: bool = False, keys: tuple[str, ...] = ("i", "j"), out: str = "rank") -> DataFrame:
    """scores with their rank; ties by the keys, missing values (null or NaN) last."""
    value = F.when(F.isnan(F.col(by).cast("double")), None).otherwise(F.col(by))
    order = value.asc_nulls_last() if ascending else value.desc_nulls_last()
    return scores.withColumn(out, F.row_number().over(Window.orderBy(order, *keys)))


def pick(scores: DataFrame, by: str = "score", keys: tuple[str, ...] = ("i", "j")) -> DataFrame:
    """The best row, the first one on ties."""
    return scores.orderBy(F.col(by).desc_nulls_last(), *keys).limit(1)


def remaining(candidates: DataFrame, chosen: DataFrame, keys: tuple[str, ...] = ("i", "j")) -> DataFrame:
    return candidates.join(chosen, list(keys), "left_anti")


def hits(chosen: DataFrame, truth: DataFrame, keys: tuple[str, ...] = ("i", "j")) -> DataFrame:
    """(hits): how many chosen pairs are true ones."""
    return chosen.select(*keys).intersect(truth.select(*keys)).agg(F.count(F.lit(1)).alias("hits"))


def sample(candidates: DataFrame, most: int, seed: int, keys: tuple[str, ...] = ("i", "j")) -> DataFrame:
    """At most `most` candidates in hash order."""
    ident = F.concat_ws(",", *[F.col(k).cast("string") for k in keys])
    return candidates.orderBy(digest(seed, "sample", ident), *keys).limit(most)


def frac_beaten(random_bits: DataFrame, bits: float, col: str = "bits") -> DataFrame:
    return random_bits.agg(F.avg((F.col(col) > bits + 1e-9).cast("int")).alias("frac_beaten"))
