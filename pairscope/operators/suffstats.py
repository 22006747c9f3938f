"""Sufficient statistics of categorical designs: all pairwise contingency tables in one aggregation.

The Gram matrix of one-hot columns is made of pair counts, and so are its products with a one-hot target and the normal
equations of the low-rank block; one Spark job collects them, the solves are small and run on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pairwise_counts(df: DataFrame, cols: list[str], pairs: list[tuple[int, int]] | None = None) -> DataFrame:
    """(i, j, a, b, n): counts of value pairs for i <= j; values are integers."""
    if pairs is None:
        pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    base = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")) if len(cols) <= 4 else df.select(*cols, F.lit(1).cast("long").alias("n"))
    made = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(cols[i]).cast("int").alias("a"), F.col(cols[j]).cast("int").alias("b")) for i, j in pairs])
    return base.select("n", F.inline(made)).groupBy("i", "j", "a", "b").agg(F.sum("n").alias("n"))


class Tables:
    """The pairwise tables on the driver as dense matrices; `budget` bounds the width that may be collected."""

    def __init__(self, df: DataFrame, cols: list[str], sizes: list[int], budget: int = 6000):
        width = sum(sizes)
        if width > budget:
            raise ValueError(f"SKIPPED: width {width} > {budget}")
        self.cols, self.sizes = cols, sizes
        self.offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(int)
        self.full = np.zeros((width, width))
        got = pairwise_counts(df, cols).toPandas()
        at = self.offsets[got["i"].to_numpy()] + got["a"].to_numpy()
        to = self.offsets[got["j"].to_numpy()] + got["b"].to_numpy()
        self.full[at, to] = got["n"]
        self.full[to, at] = got["n"]
        self.n = float(got.loc[(got["i"] == 0) & (got["j"] == 0), "n"].sum())

    def block(self, left: list[str], right: list[str]) -> np.ndarray:
        def index(names: list[str]) -> np.ndarray:
            return np.concatenate([np.arange(self.offsets[k], self.offsets[k + 1]) for k in map(self.cols.index, names)]) if names else np.zeros(0, int)

        return self.full[np.ix_(index(left), index(right))]

    def counts(self, names: list[str]) -> np.ndarray:
        return np.concatenate([np.diag(self.block([c], [c])) for c in names]) if names else np.zeros(0)


def gram_with_intercept(tables: Tables, features: list[str]) -> np.ndarray:
    n = tables.counts(features)
    return np.block([[tables.block(features, features), n[:, None]], [n[None, :], np.array([[tables.n]])]])


def target_products(tables: Tables, features: list[str], y: str) -> np.ndarray:
    """X'T with an intercept row, for T = onehot(y) - 1 / classes."""
    by_class = tables.block(features, [y])
    classes = by_class.shape[1]
    total = tables.counts([y])
    return np.vstack([by_class - tables.counts(features)[:, None] / classes, (total - tables.n / classes)[None]])
