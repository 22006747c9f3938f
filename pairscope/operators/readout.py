"""Ridge read-out on centred one-hot targets, from pairwise counts; temperature on held-back rows; scoring in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.metrics import accuracy, bits
from .split import evenly_spaced, ordinal_cut
from .suffstats import Tables, gram_with_intercept, target_products

#: Ridge on the intercept, and the range of temperatures.
INTERCEPT_RIDGE, LOWEST, HIGHEST = 1e6, 1e-3, 10.0


@dataclass
class Readout:
    """logits(columns) -> (rows, classes) on integer columns; probabilities are softmax(logits / temperature)."""

    features: list[str]
    logits: Callable[[list[np.ndarray]], np.ndarray]
    classes: int
    temperature: float = 1.0
    parameters: int = 0


def solve_ridge(gram: np.ndarray, rhs: np.ndarray, lam: float, intercept_ridge: float = INTERCEPT_RIDGE) -> np.ndarray:
    g = gram + lam * np.eye(len(gram))
    g[-1, -1] += intercept_ridge
    return np.linalg.solve(g, rhs)


def linear_logits(weights: np.ndarray, sizes: list[int]) -> Callable[[list[np.ndarray]], np.ndarray]:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(int)

    def logits(columns: list[np.ndarray]) -> np.ndarray:
        out = np.tile(weights[-1], (len(columns[0]), 1))
        for k, c in enumerate(columns):
            out += weights[offsets[k] + c]
        return out

    return logits


def dense_products(df: DataFrame, features: list[str], sizes: list[int], y: str, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """(X'X, X'T) with an intercept, from dense one-hot rows batch by batch: the reference that the counts are held against.

    Every task emits one matrix; width^2 numbers per task is what makes the counts the better way."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(int)
    width = int(offsets[-1]) + 1

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width + classes))
        for batch in batches:
            x = np.zeros((batch.num_rows, width))
            x[:, -1] = 1
            for k, f in enumerate(features):
                x[np.arange(len(x)), offsets[k] + np.asarray(batch.column(f)).astype(int)] = 1
            t = np.eye(classes)[np.asarray(batch.column(y)).astype(int)] - 1 / classes
            total += x.T @ np.hstack([x, t])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["products"])

    total = np.zeros((width, width + classes))
    for row in df.select(*features, y).mapInArrow(task, "products binary").toLocalIterator():
        total += np.frombuffer(bytes(row["products"])).reshape(total.shape)
    return total[:, :width], total[:, width:]


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def best_temperature(logits: np.ndarray, y: np.ndarray, grid: int = 120) -> float:
    """The temperature of least cross-entropy on a geometric grid."""
    at = np.arange(len(y))
    grid_points = np.geomspace(LOWEST, HIGHEST, grid)
    losses = [-np.log2(np.maximum(softmax(logits / t)[at, y], 1e-12)).mean() for t in grid_points]
    return float(grid_points[int(np.argmin(losses))])


def temperature_rows(df: DataFrame, features: list[str], y: str, ordinal: Column, cut: int, n: int, most: int = 3000) -> tuple[list[np.ndarray], np.ndarray]:
    """At most `most` evenly spaced rows from ordinal `cut` on, on the driver."""
    wanted = [cut + i for i in evenly_spaced(n - cut, most)]
    marks = df.sparkSession.createDataFrame([(i,) for i in wanted], "__o long")
    rows = df.withColumn("__o", ordinal.cast("long")).join(F.broadcast(marks), "__o").orderBy("__o").select(*features, y).toPandas()
    return [rows[f].to_numpy(int) for f in features], rows[y].to_numpy(int)


def fit_readout(df: DataFrame, features: list[str], sizes: list[int], y: str, classes: int, ordinal: Column, n: int, lam: float = 1e-2, share: float = 0.7, grid: int = 120) -> Readout:
    """Fitted on the first share of rows by ordinal (0..n-1), tempered on the rest; evaluation rows are never seen."""
    cut = int(n * share)
    tables = Tables(df.where(ordinal_cut(ordinal, n, share)), [*features, y], [*sizes, classes], budget=6000 + classes)
    weights = solve_ridge(gram_with_intercept(tables, features), target_products(tables, features, y), lam)
    logits = linear_logits(weights, sizes)
    out = Readout(list(features), logits, classes, parameters=weights.size)
    held, truth = temperature_rows(df, features, y, ordinal, cut, n)
    if len(truth):
        out.temperature = best_temperature(logits(held), truth, grid)
    return out


def with_probabilities(df: DataFrame, model: Readout, out: str = "p") -> DataFrame:
    """df with an array of class probabilities; one vectorised gather per Arrow batch."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [np.asarray(batch.column(batch.schema.get_field_index(f))).astype(int) for f in model.features]
            p = softmax(model.logits(columns) / model.temperature) if batch.num_rows else np.zeros((0, model.classes))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * model.classes, pa.int32()), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, out])

    return df.mapInArrow(task, schema)


def score(df: DataFrame, model: Readout, y: str = "y") -> DataFrame:
    """(bits, acc) of a model over rows."""
    scored = with_probabilities(df.select(*dict.fromkeys([*model.features, y])), model)
    pred = F.array_position("p", F.array_max("p")).cast("int") - 1
    return scored.select(F.element_at("p", F.col(y).cast("int") + 1).alias("pt"), pred.alias("pred"), F.col(y).alias("yy")).agg(bits(F.col("pt")).alias("bits"), accuracy(F.col("pred"), F.col("yy")).alias("acc"))


def residuals(df: DataFrame, model: Readout, y: str = "y", prefix: str = "e") -> DataFrame:
    """df with e0..e{classes-1} = p - onehot(y)."""
    scored = with_probabilities(df, model, "__p")
    return scored.select(*df.columns, *[(F.element_at("__p", c + 1) - (F.col(y) == c).cast("double")).alias(f"{prefix}{c}") for c in range(model.classes)])
