"""One experiment cell: a lagged stream, its split, an additive read-out, and what joint blocks add to it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import criterion, lowrank, readout, verdict
from ..operators.candidates import all_pairs, pick, ranked
from ..operators.encode import cell_id
from ..operators.lags import with_lags
from ..operators.split import first_half, strided
from ..sources.shared import stored


@dataclass
class Design:
    """Train and test rows with slot columns x0..x{window-1}, target y and a dense training ordinal."""

    train: DataFrame
    test: DataFrame
    ordinal: Column
    n: int
    slots: list[str]
    alphabet: int
    classes: int

    @property
    def sizes(self) -> list[int]:
        return [self.alphabet] * len(self.slots)


def stream_design(stream: DataFrame, n: int, alphabet: int, classes: int, window: int, start: int, stride: int = 7, slots: list[int] | None = None, heads: list[str] = ()) -> Design:
    """Strided positions, the first half in time for training; lags beyond the start leave no row undefined."""
    reach = range(window)
    lagged = with_lags(stream, list(reach))
    t, half = F.col("t"), n // 2
    first = max(start, window)
    keep = lagged.where(strided(t, first, stride) & F.col("y").isNotNull())
    rows = stored(keep.select("t", *[f"x{j}" for j in reach], "y", *heads), "design")
    ordinal = F.floor((t - first) / stride)
    count = max(0, -(-(half - first) // stride))
    names = [f"x{j}" for j in (slots if slots is not None else reach)]
    return Design(rows.where(first_half(t, n)), rows.where(~first_half(t, n)), ordinal, count, names, alphabet, classes)


def with_cell(df: DataFrame, a: str, b: str, alphabet: int, name: str = "cell") -> DataFrame:
    return df.withColumn(name, cell_id(F.col(a), F.col(b), alphabet).cast("int"))


def numbers(frame: DataFrame) -> dict:
    return frame.first().asDict()


def fit_additive(d: Design, y: str = "y", classes: int | None = None) -> readout.Readout:
    return readout.fit_readout(d.train, d.slots, d.sizes, y, classes or d.classes, d.ordinal, d.n)


def exact_block(d: Design, pairs: list[tuple[str, str]], y: str = "y", classes: int | None = None) -> dict:
    """bits and acc on test with exact joint blocks of the pairs beside the slots; bits None where too wide."""
    width = d.alphabet * len(d.slots) + len(pairs) * d.alphabet**2 + 1
    note = verdict.width_guard(d.alphabet, len(d.slots), pairs=len(pairs))
    if note:
        return {"bits": None, "acc": None, "width": width, "note": note}
    train, test, names = d.train, d.test, []
    for k, (a, b) in enumerate(pairs):
        names.append(f"cell{k}")
        train, test = with_cell(train, a, b, d.alphabet, names[-1]), with_cell(test, a, b, d.alphabet, names[-1])
    model = readout.fit_readout(train, [*d.slots, *names], [*d.sizes, *[d.alphabet**2] * len(pairs)], y, classes or d.classes, d.ordinal, d.n)
    return {**numbers(readout.score(test, model, y)), "width": width, "note": None}


def lowrank_block(d: Design, pairs: list[tuple[str, str]], y: str = "y", classes: int | None = None, dim: int = 8, sweeps: int = 6, method: str = "als") -> tuple[dict, dict]:
    """(bits, acc, parameters and note, factors); nulls and no factors where the cells are too many for the driver's tables."""
    note = verdict.width_guard(d.alphabet, len(d.slots), pairs=len(pairs))
    if note:
        return {"bits": None, "acc": None, "parameters": None, "note": note}, {}
    train, test, names = d.train, d.test, []
    for k, (a, b) in enumerate(pairs):
        names.append(f"cell{k}")
        train, test = with_cell(train, a, b, d.alphabet, names[-1]), with_cell(test, a, b, d.alphabet, names[-1])
    model, factors = lowrank.fit_lowrank(train, d.slots, d.sizes, names, d.alphabet, y, classes or d.classes, d.ordinal, d.n, dim, sweeps, method)
    return {**numbers(readout.score(test, model, y)), "parameters": model.parameters}, factors


def residual_scores(d: Design, model: readout.Readout, fields: list[str], pairs: list[tuple[int, int]] | None = None, weighted: bool = False, y: str = "y") -> DataFrame:
    """The criterion of all pairs of fields on the training residual of a model."""
    errs = readout.residuals(d.train, model, y)
    return criterion.pair_scores(errs, fields, [f"e{c}" for c in range(model.classes)], weighted, pairs=pairs)


def lag_residual_scores(d: Design, model: readout.Readout, lags: list[int], y: str = "y") -> DataFrame:
    errs = readout.residuals(d.train, model, y)
    return criterion.lag_scores(errs, lags, [f"e{c}" for c in range(model.classes)])


def rank_of(scores: DataFrame, i: int, j: int) -> int | None:
    row = ranked(scores).where((F.col("i") == i) & (F.col("j") == j)).first()
    return row["rank"] if row else None


def top(scores: DataFrame) -> tuple[int, int]:
    row = pick(scores).first()
    return row["i"], row["j"]


def runner_up(scores: DataFrame) -> tuple[int, int]:
    row = ranked(scores).where("rank = 2").first()
    return row["i"], row["j"]


def rows_frame(spark: SparkSession, rows: list[dict], ddl: str) -> DataFrame:
    """Result rows under one declared schema; missing values are null."""
    names = [part.split()[0] for part in ddl.split(",")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ddl)


__all__ = ["Design", "all_pairs", "exact_block", "fit_additive", "lag_residual_scores", "lowrank_block", "numbers", "rank_of", "residual_scores", "rows_frame", "runner_up", "stream_design", "top", "with_cell"]
