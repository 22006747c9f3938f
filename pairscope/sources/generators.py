"""Generated symbol streams.  A symbol is a hash of its position, so lagged symbols are computed, never joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import digest, symbol, uniform


def at(seed: int, alphabet: int, lag: int = 0, t: str = "t") -> Column:
    """The symbol at position t - lag; null before the stream begins."""
    return F.when(F.col(t) >= lag, symbol(seed, "x", F.col(t) - lag, alphabet))


def additive_stream(spark: SparkSession, n: int, alphabet: int, seed: int) -> DataFrame:
    """y is the symbol itself: nothing beyond the additive part."""
    return spark.range(n).select(F.col("id").alias("t")).select("t", at(seed, alphabet).alias("x"), at(seed, alphabet).alias("y"))


def single_interaction(spark: SparkSession, n: int, alphabet: int, lag: int, seed: int) -> DataFrame:
    """y[t] = (x[t] + x[t-lag]) mod alphabet."""
    return multi_sum(spark, n, alphabet, [0, lag], seed)


def multi_sum(spark: SparkSession, n: int, alphabet: int, lags: list[int], seed: int) -> DataFrame:
    """y[t] = sum of the lagged symbols mod alphabet; lags must differ."""
    if len(set(lags)) != len(lags):
        raise ValueError(f"repeated lags: {lags}")
    s = spark.range(n).select(F.col("id").alias("t"))
    total = sum((at(seed, alphabet, j) for j in lags), F.lit(0))
    return s.select("t", at(seed, alphabet).alias("x"), (total % alphabet).cast("int").alias("y"))


def components_stream(spark: SparkSession, n: int, alphabet: int, pairs: list[tuple[int, int]], comps: int, seed: int) -> DataFrame:
    """y = sum over pairs m of ((x[t-a]+x[t-b]) mod comps) * comps^m, and each digit as y_m."""
    if alphabet % comps:
        raise ValueError("the alphabet must be a multiple of comps")
    s = spark.range(n).select(F.col("id").alias("t"))
    parts = [((at(seed, alphabet, a) + at(seed, alphabet, b)) % comps).cast("int") for a, b in pairs]
    packed = sum((p * comps**m for m, p in enumerate(parts)), F.lit(0)).cast("int")
    return s.select("t", at(seed, alphabet).alias("x"), packed.alias("y"), *[p.alias(f"y_{m}") for m, p in enumerate(parts)])


def injected(lagged: DataFrame, a: str, b: str, comps: int, noise: float = 0.0, seed: int = 0) -> DataFrame:
    """lagged with y = (a + b) mod comps; with probability noise a uniform draw instead."""
    y = ((F.col(a) + F.col(b)) % comps).cast("int")
    if noise:
        y = F.when(uniform(seed, "noise", F.col("t")) < noise, symbol(seed, "label", F.col("t"), comps)).otherwise(y)
    return lagged.withColumn("y", y)


def rare_signal(lagged: DataFrame, a: str, rare: int, comps: int, seed: int, alphabet: int) -> DataFrame:
    """y is kept where column a is among the `rare` least frequent symbols of 0..alphabet-1 (absent ones count), else random."""
    spark = lagged.sparkSession
    counts = lagged.groupBy(F.col(a).alias("sym")).agg(F.count(F.lit(1)).alias("n"))
    every = spark.range(alphabet).select(F.col("id").cast("int").alias("sym"))
    rarest = every.join(counts, "sym", "left").orderBy(F.coalesce("n", F.lit(0)), "sym").limit(rare).select(F.col("sym").alias(a), F.lit(True).alias("informative"))
    flagged = lagged.join(F.broadcast(rarest), a, "left").withColumn("informative", F.coalesce("informative", F.lit(False)))
    return flagged.withColumn("y", F.when(F.col("informative"), F.col("y")).otherwise(symbol(seed, "rare", F.col("t"), comps)))


def shuffled(stream: DataFrame, seed: int, t: str = "t", x: str = "x") -> DataFrame:
    """The same symbols in hash order over the same positions: no structure survives.  Two narrow columns are ranked."""
    from ..operators.ranks import global_rank

    ranked = global_rank(stream.select(t, x), [digest(seed, "shuffle", F.col(t)), t], "__r")
    return ranked.select((F.col("__r") - 1).cast("long").alias(t), x)
