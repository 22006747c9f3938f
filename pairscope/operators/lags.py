"""Lagged symbols of a stream with a dense position column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def with_lags(stream: DataFrame, lags: list[int], t: str = "t", x: str = "x", prefix: str = "x", chunk: int = 100_000) -> DataFrame:
    """stream with columns prefix{j} = x at t - j, null before the beginning.

    Positions are cut into chunks and the last max(lags) rows of a chunk are repeated in front of the next one, so one
    window per chunk gives all lags: one shuffle on the chunk, no global order and no self-joins."""
    reach = max(lags, default=0)
    chunk = max(chunk, reach + 1)
    at = F.col(t)
    own = F.floor(at / chunk)
    homes = F.when(at % chunk >= chunk - reach, F.array(own, own + 1)).otherwise(F.array(own)) if reach else F.array(own)
    spread = stream.withColumn("__chunk", F.explode(homes))
    order = Window.partitionBy("__chunk").orderBy(t)
    out = spread.select("*", *[F.lag(x, j).over(order).alias(f"{prefix}{j}") if j else F.col(x).alias(f"{prefix}0") for j in lags])
    return out.where(F.col("__chunk") == own).drop("__chunk")


def lag_join(stream: DataFrame, lag: int, t: str = "t", x: str = "x", out: str = "lagged") -> DataFrame:
    """The same by an equi self-join on the dense position; rows before the beginning are dropped."""
    shifted = stream.select((F.col(t) + lag).alias(t), F.col(x).alias(out))
    return stream.join(shifted, t)


def targets_ahead(stream: DataFrame, lag: int, t: str = "t", x: str = "x") -> DataFrame:
    """(t, y): the symbol `lag` positions ahead."""
    return stream.select((F.col(t) - lag).alias(t), F.col(x).alias("y"))
