"""Verdicts derived from numbers: pure expressions and functions, thresholds are parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def interaction_verdict(best_bits: Column, additive_bits: Column, pick_score: Column, threshold: Column, margin: float = 0.005) -> Column:
    """no_pair_helps, inside_null or clears_null; a missing best counts as no help."""
    return (
        F.when(best_bits.isNull() | (best_bits >= additive_bits - margin), F.lit("no_pair_helps"))
        .when(pick_score <= threshold, F.lit("inside_null"))
        .otherwise(F.lit("clears_null"))
    )


def instrument_gates(rows: DataFrame, bar: str, additive: str, oracle: str, tolerance: float = 0.05) -> DataFrame:
    """rows with additive_ok, oracle_ok and valid, judged each by itself."""
    return rows.withColumn("additive_ok", F.abs(F.col(additive) - F.col(bar)) <= tolerance).withColumn("oracle_ok", F.col(oracle) <= tolerance).withColumn("valid", F.col("additive_ok") & F.col("oracle_ok"))


def opponent_gate(bits: Column, acc: Column) -> Column:
    return (bits < 0.2) & (acc > 0.95)


def entropy_gate(entropy: Column, least: float = 0.2) -> Column:
    """The note that stands in for a fit where the label's entropy is under `least` bits, else null."""
    return F.when(F.coalesce(entropy, F.lit(0.0)) < least, F.lit(f"DEGENERATE: label entropy under {least} bits"))


def leak_control(rows: DataFrame, bps: str = "bps", unigram: str = "unigram_bps", slack: float = 0.02) -> DataFrame:
    """(margin, passes): on a shuffled stream no model may beat the unigram by more than the slack."""
    return rows.agg(F.min(F.col(bps) - F.col(unigram)).alias("margin")).withColumn("passes", F.col("margin") > -slack)


def authorisation(rows: DataFrame, cell: list[str], bps: str = "bps", unigram: str = "unigram_bps", bar: float = 0.20) -> DataFrame:
    """(worst_gain, authorised): the best model's gain over the unigram in the worst cell must reach the bar."""
    gains = rows.groupBy(*cell).agg(F.max(F.col(unigram) - F.col(bps)).alias("gain"))
    return gains.agg(F.min("gain").alias("worst_gain")).withColumn("authorised", F.col("worst_gain") >= bar)


def sweep_summary(rows: DataFrame, by: list[str], rank: str = "rank", bits: str = "bits") -> DataFrame:
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("cells"), F.count_if(F.col(rank) == 1).alias("first"), F.avg(rank).alias("mean_rank"), F.avg(bits).alias("mean_bits"))


def parameters(kind: str, alphabet: int, classes: int, window: int = 0, dim: int = 8) -> int:
    """Free parameters of a read-out: exact joint table, low-rank block or factorisation machine."""
    linear = alphabet * window * classes
    if kind == "exact":
        return alphabet * alphabet * classes + linear + classes
    if kind == "lowrank":
        return 2 * alphabet * dim + dim * classes + linear + classes
    if kind == "fm":
        return linear * (1 + dim) + classes
    raise ValueError(kind)


def width_guard(alphabet: int, window: int, budget: int = 6000, pairs: int = 1) -> str | None:
    """None where a design of window slots and the exact blocks of some pairs is within the budget, else its note."""
    width = pairs * alphabet * alphabet + alphabet * window + 1
    return f"SKIPPED: width {width} > {budget}" if width > budget else None


def identifiable(rows: int, parameters: int) -> str | None:
    """None where there are more training rows than parameters, else the note that stands in for a fit."""
    return None if rows > parameters else f"SKIPPED: {rows} rows for {parameters} parameters"
