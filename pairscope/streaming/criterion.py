"""The criterion over event-time windows of a stream, for a frozen model: cell counts and sums are additive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_cells(events: DataFrame, ts: str, fields: list[str], err: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window, i, j, a, b, n, S_0) per event-time window, with a watermark; works on streams and on tables."""
    pairs = [(i, j) for i in range(len(fields)) for j in range(i + 1, len(fields))]
    text = [F.coalesce(F.col(f).cast("string"), F.lit("\0null")) for f in fields]
    made = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), text[i].alias("a"), text[j].alias("b")) for i, j in pairs])
    timed = events.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    spread = timed.select("__ts", F.col(err).alias("__err"), F.explode(made).alias("__pair")).select("__ts", "__err", "__pair.*")
    return spread.groupBy(F.window("__ts", window).alias("window"), "i", "j", "a", "b").agg(F.count(F.lit(1)).alias("n"), F.sum("__err").alias("S_0"))


def window_scores(cells: DataFrame, weighted: bool = True) -> DataFrame:
    """(window, i, j, score) from finished cells."""
    from ..operators.criterion import scores_of_cells

    return scores_of_cells(cells, 1, weighted, keys=["window"])
