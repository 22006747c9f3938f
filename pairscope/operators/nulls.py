"""Permutation controls.  A permutation is a hash order; only ids and one column are ranked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import digest
from .criterion import pair_scores
from .ranks import global_rank


def draws_frame(df: DataFrame, draws: int) -> DataFrame:
    return df.sparkSession.range(draws).select(F.col("id").cast("int").alias("draw"))


def permuted(df: DataFrame, id_col: str, col: str, draws: int, seed: int, out: str | None = None) -> DataFrame:
    """df once per draw (column draw) with `col` permuted over the rows by the order of md5(seed:perm<draw>:id).

    (draw, hash, id, value) is ranked for all draws at once; every draw has as many rows as df, so a rank tells its draw
    and its place.  The wide rows are joined by their own rank.  id_col must tell rows apart."""
    out = out or col
    total = df.count()
    narrow = df.select(id_col, F.col(col).alias("__moved")).crossJoin(F.broadcast(draws_frame(df, draws)))
    key = digest(F.concat(F.lit(f"{seed}.").cast("string"), F.col("draw").cast("string")), "perm", F.col(id_col))
    ranked = global_rank(narrow, ["draw", key, id_col], "__r")
    by_hash = ranked.select("draw", "__moved", (F.col("__r") - F.col("draw") * F.lit(total)).alias("__r"))
    natural = global_rank(df, [id_col], "__r")
    return natural.join(by_hash, "__r").drop("__r").withColumn(out, F.col("__moved")).drop("__moved")


def null_scores(df: DataFrame, id_col: str, fields: list[str], err: str, draws: int, seed: int, weighted: bool = True) -> DataFrame:
    """(draw, i, j, score): every pair's score with the residual permuted, the draw shared by all pairs."""
    return pair_scores(permuted(df, id_col, err, draws, seed), fields, err, weighted, keys=["draw"])


def null_threshold(scores: DataFrame, quantile: float = 0.95) -> DataFrame:
    """(threshold): the quantile over draws of the best score of any candidate."""
    return scores.groupBy("draw").agg(F.max("score").alias("best")).agg(F.percentile("best", quantile).alias("threshold"))


def second_variable_null(df: DataFrame, id_col: str, a: str, b: str, err: str, draws: int, seed: int, weighted: bool = False) -> DataFrame:
    """(draw, score) of one pair with its second variable permuted."""
    moved = permuted(df, id_col, b, draws, seed)
    return pair_scores(moved, [a, b], err, weighted, keys=["draw"]).select("draw", "score")


def own_shuffle_null(df: DataFrame, id_col: str, fields: list[str], pairs: list[tuple[int, int]], errs: list[str], draws: int, seed: int, weighted: bool = False) -> DataFrame:
    """(draw, i, j, score): every candidate with its own permutation of its second variable in every draw."""
    out = None
    for k, (i, j) in enumerate(pairs):
        moved = permuted(df.select(id_col, F.col(fields[i]).alias("a"), F.col(fields[j]).alias("b"), *errs), id_col, "b", draws, seed * 100_003 + k)
        one = pair_scores(moved, ["a", "b"], errs, weighted, keys=["draw"]).select("draw", F.lit(i).alias("i"), F.lit(j).alias("j"), "score")
        out = one if out is None else out.unionByName(one)
    return out
