"""Shared helpers: tables in the shared folder, Arrow batch sizes, column names that do not clash, byte-level word rules."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import discard, scratch, shared_root, stored

__all__ = ["BLANKS", "UPPER", "ascii_lower", "discard", "fresh_names", "scratch", "shared_root", "small_batches", "stored"]

#: The six ASCII blanks that separate words and are stripped from lines.
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def small_batches(spark: SparkSession, rows: int = 1000, megabytes: int = 8) -> None:
    """Bound the Arrow batches between the JVM and Python workers, whose memory stands beside the executor's heap."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{megabytes}m")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def fresh_names(taken: list[str], *names: str) -> list[str]:
    """The names, each with underscores added until no column of `taken` has it (case ignored, as Spark does)."""
    used = {c.lower() for c in taken}
    out = []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out
