"""Position and row splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import digest, uniform
from .ranks import global_rank


def strided(t: Column, start: int, stride: int) -> Column:
    return (t >= start) & (F.pmod(t - start, F.lit(stride)) == 0)


def first_half(t: Column, n: int) -> Column:
    return t < n // 2


def block_bounds(n: int, blocks: int = 8) -> list[tuple[int, int]]:
    return [(b * n // blocks, (b + 1) * n // blocks) for b in range(blocks)]


def block_of(t: Column, n: int, blocks: int = 8) -> Column:
    """The contiguous block of a position, with bounds b * n // blocks."""
    out = F.lit(0)
    for b, (start, _) in enumerate(block_bounds(n, blocks)):
        if b:
            out = F.when(t >= start, F.lit(b)).otherwise(out)
    return out


def hash_split(df: DataFrame, id_col: str, share: float, seed: int, out: str = "split") -> DataFrame:
    """df with 'tr' or 'te' by a hash of the id: independent of layout, no order needed."""
    return df.withColumn(out, F.when(uniform(seed, "split", F.col(id_col)) < share, F.lit("tr")).otherwise(F.lit("te")))


def hash_order_split(df: DataFrame, id_col: str, share: float, seed: int, out: str = "split") -> DataFrame:
    """Exactly the first share of rows in hash order is 'tr'; only (hash, id) is ranked."""
    total = df.count()
    ranked = global_rank(df.select(id_col), [digest(seed, "split", F.col(id_col)), id_col], "__r")
    side = F.when(F.col("__r") <= int(total * share), F.lit("tr")).otherwise(F.lit("te"))
    return df.join(ranked.select(id_col, side.alias(out)), id_col)


def ordinal_cut(ordinal: Column, n: int, share: float = 0.7) -> Column:
    return ordinal < int(n * share)


def eval_positions(t: Column, start: int, end: int, lag: int, context: int, steps: int = 24) -> Column:
    """Positions of a test block that every model is scored on: in whole windows, target inside, context inside both."""
    whole = start + (end - start) // steps * steps
    return (t >= start + context) & (t < whole) & (t + lag < end) & ((t - start) % steps >= context)


def evenly_spaced(n: int, most: int) -> list[int]:
    """At most `most` ordinals spread over 0..n-1."""
    return list(range(n)) if n <= most else [int(i * (n - 1) / (most - 1)) for i in range(most)]
