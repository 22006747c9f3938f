"""Interpolated-backoff n-grams as counts and joins.

p_n(y) = (count(ctx, y) + alpha * p_{n-1}(y)) / (total(ctx) + alpha), p_0 = 1 / V.  One set of count tables serves all
orders; positions meet them by (context) and (context, y), counted first: w positions that share both are one row.
Accuracy needs the best symbol of a context only, so the distribution is spread over V for distinct contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lags import targets_ahead, with_lags

#: The smoothing grid.
ALPHAS = (0.01, 0.05, 0.2, 1.0, 10.0)


def contexts(stream: DataFrame, order: int, lag: int, t: str = "t", x: str = "x", chunk: int = 100_000) -> DataFrame:
    """(t, x0..x{order-2}, y): the context of each position and the symbol `lag` ahead of it."""
    lagged = with_lags(stream.select(t, x), list(range(max(order - 1, 1))), t, x, chunk=chunk)
    return lagged.join(targets_ahead(stream, lag, t, x), t)


def context_columns(order: int) -> list[str]:
    return [f"x{i}" for i in range(order - 1)]


def fit_filter(t: Column, start: int, end: int, lag: int, order: int) -> Column:
    """Training positions: the target inside the range and the longest context, and one more, after its start."""
    inside = (t >= start) & (t + lag < end)
    return inside & (t - order + 1 >= start) if order > 1 else inside


def counted(rows: DataFrame, order: int, marks: dict[str, Column]) -> DataFrame:
    """(*marks, x0.., y, w): the number of positions that share a context, a symbol and the marks, of which they meet one."""
    ctx = context_columns(order)
    marked = rows.select(*[c.alias(m) for m, c in marks.items()], *ctx, "y").where(" or ".join(marks))
    return marked.groupBy(*marks, *ctx, "y").agg(F.count(F.lit(1)).alias("w"))


def tables(train: DataFrame, order: int) -> dict[int, tuple[DataFrame, DataFrame]]:
    """order -> (counts by context and y, totals by context)."""
    out = {}
    for n in range(1, order + 1):
        ctx = context_columns(n)
        counts = train.groupBy(*ctx, "y").agg(F.sum("w").alias(f"c{n}"))
        out[n] = (counts, counts.groupBy(*ctx).agg(F.sum(f"c{n}").alias(f"n{n}")))
    return out


def with_probabilities(positions: DataFrame, fitted: dict, order: int, v: int, alpha: dict[int, Column | float]) -> DataFrame:
    """positions with p1..p{order}: the probability that each order gives to y."""
    out = positions
    for n in range(1, order + 1):
        counts, totals = fitted[n]
        ctx = context_columns(n)
        out = out.join(counts, [*ctx, "y"], "left")
        out = out.join(totals, ctx, "left") if ctx else out.join(F.broadcast(totals))
    p: Column = F.lit(1.0) / v
    for n in range(1, order + 1):
        a = alpha[n] if isinstance(alpha[n], Column) else F.lit(float(alpha[n]))
        p = (F.coalesce(F.col(f"c{n}"), F.lit(0)) + a * p) / (F.coalesce(F.col(f"n{n}"), F.lit(0)) + a)
        out = out.withColumn(f"p{n}", p)
        p = F.col(f"p{n}")
    return out.drop(*[f"{k}{n}" for n in range(1, order + 1) for k in "cn"])


def predictions(positions: DataFrame, fitted: dict, order: int, v: int, alpha: dict[int, float]) -> DataFrame:
    """(context columns, pred): the most probable symbol per distinct context, ties to the smallest symbol."""
    ctx = context_columns(order)
    spark = positions.sparkSession
    symbols = spark.range(v).select(F.col("id").cast("int").alias("y"))
    distinct = positions.select(*ctx).distinct() if ctx else spark.range(1).select()
    spread = with_probabilities(distinct.join(F.broadcast(symbols)), fitted, order, v, alpha)
    return spread.groupBy(*ctx).agg(F.max_by("y", F.struct(F.col(f"p{order}"), -F.col("y"))).alias("pred"))


def scorecard(scored: DataFrame, order: int, unk: int = 0) -> DataFrame:
    """One row: bps, acc, n, unk rates, and the same over positions whose symbol is in the vocabulary."""
    hit = -F.log2(F.greatest(F.col(f"p{order}"), F.lit(1e-12)))
    real = F.col("y") != unk
    right = (F.col("pred") == F.col("y")).cast("int")
    return scored.agg(
        mean(hit).alias("bps"), mean(right).alias("acc"), total().alias("n"), mean((~real).cast("int")).alias("unk_true_rate"), mean((F.col("pred") == unk).cast("int")).alias("unk_pred_rate"),
        mean(F.when(real, hit)).alias("bps_real"), mean(F.when(real, right)).alias("acc_real"), total(real).alias("n_real"),
    )


def total(condition: Column | None = None) -> Column:
    """Positions behind the rows, or those that meet a condition."""
    return F.coalesce(F.sum("w" if condition is None else F.when(condition, F.col("w"))), F.lit(0).cast("long"))


def mean(value: Column) -> Column:
    """The mean over positions; null where no row has a value."""
    return F.sum(value * F.col("w")) / F.sum(F.when(value.isNotNull(), F.col("w")))


def evaluate(stream: DataFrame, v: int, order: int, lag: int, train: tuple[int, int], test: Column, alpha: dict[int, float], with_accuracy: bool = True) -> DataFrame:
    """A scorecard per order 1..order, all off one set of tables fitted on the train range."""
    grams = counted(contexts(stream, order, lag), order, {"train": fit_filter(F.col("t"), *train, lag, order), "test": test})
    return scorecards(grams.where("train"), grams.where("test"), v, order, alpha, with_accuracy)


def scorecards(train: DataFrame, test: DataFrame, v: int, order: int, alpha: dict[int, float], with_accuracy: bool = True, only: list[int] | None = None) -> DataFrame:
    """A scorecard per order (or those named) from counted positions of both sides."""
    fitted = tables(train, order)
    scored = with_probabilities(test, fitted, order, v, alpha)
    out = None
    for n in only or range(1, order + 1):
        ctx = context_columns(n)
        if with_accuracy:
            pred = predictions(test, fitted, n, v, alpha)
            each = scored.join(pred, ctx) if ctx else scored.join(F.broadcast(pred))
        else:
            each = scored.withColumn("pred", F.lit(None).cast("int"))
        card = scorecard(each, n).select(F.lit(n).alias("order"), "*")
        out = card if out is None else out.unionByName(card)
    return out


def alpha_marks(train_end: int, order: int, lag: int) -> dict[str, Column]:
    """fit: what the models of the alpha choice are fitted on; held: the last eighth (256 at least) of the training side."""
    start, t = train_end - max(256, train_end // 8), F.col("t")
    return {"fit": fit_filter(t, 0, start, lag, order), "held": (t >= start + max(order - 1, 1)) & (t + lag < train_end)}


def alpha_bits(stream: DataFrame, v: int, order: int, lag: int, train_end: int, alphas=ALPHAS) -> DataFrame:
    """(order, alpha, bps) on the validation slice."""
    grams = counted(contexts(stream, order, lag), order, alpha_marks(train_end, order, lag))
    return alpha_bits_of(grams.where("fit"), grams.where("held"), v, order, alphas)


def alpha_bits_of(fit: DataFrame, held: DataFrame, v: int, order: int, alphas=ALPHAS) -> DataFrame:
    """(order, alpha, bps) from counted positions."""
    fitted = tables(fit, order)
    grid = held.sparkSession.createDataFrame([(float(a),) for a in alphas], "alpha double")
    a = F.col("alpha")
    scored = with_probabilities(held.join(F.broadcast(grid)), fitted, order, v, {n: a for n in range(1, order + 1)})
    floors = [mean(-F.log2(F.greatest(F.col(f"p{n}"), F.lit(1e-12)))).alias(f"b{n}") for n in range(1, order + 1)]
    wide = scored.groupBy("alpha").agg(*floors)
    return wide.select("alpha", F.inline(F.array(*[F.struct(F.lit(n).alias("order"), F.col(f"b{n}").alias("bps")) for n in range(1, order + 1)])))


def alpha_choice(bits: DataFrame) -> DataFrame:
    """(order, alpha): the best alpha per order, the smallest on ties."""
    return bits.groupBy("order").agg(F.min_by("alpha", F.struct("bps", "alpha")).alias("alpha"))
