"""The residual criterion over pairs of variables.

For a pair's cells c with residual sums S_c and counts n_c, R_c = S_c - (n_c / n) * s; the score is the sum of |R_c|^2,
or of |R_c|^2 / n_c.  All pairs come out of one scan: rows are aggregated by their full combination of fields first, each
combination is then spread to its pairs, and cells are aggregated again.  A cell that holds a third of all rows is
absorbed by the partial aggregation of either step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def mean_residual(df: DataFrame, y: Column, out: str = "err") -> DataFrame:
    """df with err = mean(y) - y: the residual of the constant model."""
    mean = df.agg(F.avg(y).alias("__m"))
    return df.join(F.broadcast(mean)).withColumn(out, F.col("__m") - y).drop("__m")


def main_effects_residual(df: DataFrame, a: str, b: str, y: Column, out: str = "err") -> DataFrame:
    """err = m_a + m_b - m - y: the closed-form additive residual of two fields."""
    m = df.agg(F.avg(y).alias("__m"))
    ma = df.groupBy(a).agg(F.avg(y).alias("__ma"))
    mb = df.groupBy(b).agg(F.avg(y).alias("__mb"))
    joined = df.join(ma, df[a].eqNullSafe(ma[a])).drop(ma[a]).join(mb, df[b].eqNullSafe(mb[b])).drop(mb[b]).join(F.broadcast(m))
    return joined.withColumn(out, F.col("__ma") + F.col("__mb") - F.col("__m") - y).drop("__m", "__ma", "__mb")


def pair_cells(df: DataFrame, fields: list[str], errs: list[str], keys: list[str] = (), pairs: list[tuple[int, int]] | None = None, pre_aggregate: bool = True) -> DataFrame:
    """(*keys, i, j, a, b, n, S_*): counts and residual sums of every cell of every pair; values are compared as text."""
    keys = list(keys)
    if pairs is None:
        pairs = [(i, j) for i in range(len(fields)) for j in range(i + 1, len(fields))]
    base = df.select(*keys, *fields, F.lit(1).cast("long").alias("n"), *[F.col(e).alias(f"S_{k}") for k, e in enumerate(errs)])
    sums = [F.sum(c).alias(c) for c in ("n", *(f"S_{k}" for k in range(len(errs))))]
    if pre_aggregate and len(pairs) > 1:
        base = base.groupBy(*keys, *fields).agg(*sums)
    text = [F.coalesce(F.col(f).cast("string"), F.lit("\0null")) for f in fields]
    made = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), text[i].alias("a"), text[j].alias("b")) for i, j in pairs])
    spread = base.select(*keys, *[s for s in base.columns if s == "n" or s.startswith("S_")], F.inline(made))
    return spread.groupBy(*keys, "i", "j", "a", "b").agg(*sums)


def coded_cells(df: DataFrame, fields: list[str], errs: list[str], size: int) -> DataFrame:
    """(i, j, a, b, n, S_*) as pair_cells gives, of fields with values 0..size-1: each task sums its rows into one table
    per pair, so only cells are shuffled and not combinations of fields."""
    pairs = [(i, j) for i in range(len(fields)) for j in range(i + 1, len(fields))]
    sums = [f"S_{k}" for k in range(len(errs))]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(pairs), 1 + len(errs), size * size))
        for batch in batches:
            values = [np.asarray(batch.column(f)).astype(np.int64) for f in fields]
            weights = [None, *[np.asarray(batch.column(e)) for e in errs]]
            for p, (i, j) in enumerate(pairs):
                cell = values[i] * size + values[j]
                for w, weight in enumerate(weights):
                    total[p, w] += np.bincount(cell, weight, size * size)
        at, cell = np.nonzero(total[:, 0])
        i, j = np.array(pairs, np.int32).reshape(-1, 2)[at].T
        made = [i, j, (cell // size).astype(np.int32), (cell % size).astype(np.int32), total[at, 0, cell].astype(np.int64), *[total[at, 1 + k, cell] for k in range(len(errs))]]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(m)) for m in made], names=["i", "j", "a", "b", "n", *sums])

    cells = df.select(*fields, *errs).mapInArrow(task, ", ".join(["i int, j int, a int, b int, n long", *[f"{s} double" for s in sums]]))
    return cells.groupBy("i", "j", "a", "b").agg(*[F.sum(c).alias(c) for c in ("n", *sums)])


def scores_of_cells(cells: DataFrame, heads: int = 1, weighted: bool = True, keys: list[str] = ()) -> DataFrame:
    """(*keys, i, j, score): the centred criterion, summed over heads."""
    keys = [*keys, "i", "j"]
    pair = Window.partitionBy(*keys)
    n = F.sum("n").over(pair)
    centred = [F.col(f"S_{k}") - F.col("n") / n * F.sum(f"S_{k}").over(pair) for k in range(heads)]
    square = sum((r * r for r in centred[1:]), centred[0] * centred[0])
    each = cells.select(*keys, (square / F.col("n") if weighted else square).alias("r"))
    return each.groupBy(*keys).agg(F.sum("r").alias("score"))


def pair_scores(df: DataFrame, fields: list[str], errs: str | list[str] = "err", weighted: bool = True, keys: list[str] = (), pairs: list[tuple[int, int]] | None = None) -> DataFrame:
    """(*keys, i, j, score) for all pairs of fields (or the given pairs of their indices)."""
    errs = [errs] if isinstance(errs, str) else list(errs)
    return scores_of_cells(pair_cells(df, fields, errs, keys, pairs), len(errs), weighted, keys)


def lag_scores(stream: DataFrame, lags: list[int], errs: list[str], x: str = "x0", weighted: bool = False) -> DataFrame:
    """(i, j, score) of the pairs (x, x_lag): the single-lag criterion; rows without the lag are left out per candidate."""
    fields = [x, *[f"x{j}" for j in lags]]
    cells = pair_cells(stream, fields, errs, pairs=[(0, k + 1) for k in range(len(lags))])
    return scores_of_cells(cells.where("a <> '\0null' and b <> '\0null'"), len(errs), weighted)


def named(scores: DataFrame, fields: list[str]) -> DataFrame:
    """scores with field_a and field_b in place of indices."""
    names = F.array(*[F.lit(f) for f in fields])
    return scores.withColumn("field_a", F.element_at(names, F.col("i") + 1)).withColumn("field_b", F.element_at(names, F.col("j") + 1))


def cell_table(df: DataFrame, a: str, b: str, y: str = "y", split: str = "split", min_cell: int = 10) -> DataFrame:
    """(a, b, train_rate, train_n, test_rate, test_n) of cells with at least min_cell training rows, one pass."""
    tr, te = F.col(split) == "tr", F.col(split) == "te"
    return (
        df.groupBy(F.col(a).alias("a"), F.col(b).alias("b"))
        .agg(F.avg(F.when(tr, F.col(y))).alias("train_rate"), F.count(F.when(tr, 1)).alias("train_n"), F.avg(F.when(te, F.col(y))).alias("test_rate"), F.count(F.when(te, 1)).alias("test_n"))
        .where(F.col("train_n") >= min_cell)
    )


def top_cells(cells: DataFrame, most: int = 8) -> DataFrame:
    """The first cells of a cell table by training rate, then support, then their values."""
    return cells.orderBy(F.desc("train_rate"), F.desc("train_n"), "a", "b").limit(most)


def cell_shares(df: DataFrame, a: str, b: str, size: int) -> DataFrame:
    """(max_share, occupied): the largest cell's share of rows and the share of size^2 cells that hold rows."""
    cells = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    return cells.agg((F.max("n") / F.sum("n")).alias("max_share"), (F.count(F.lit(1)) / F.lit(size * size)).alias("occupied"))
