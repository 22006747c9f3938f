"""Reproducible randomness: every draw is an md5 of (seed, purpose, id), equal across partitionings and engines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(seed: int | str | Column, purpose: str, ident: Column) -> Column:
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat(seed.cast("string"), F.lit(f":{purpose}:"), ident.cast("string")).cast("binary"))


def draw32(seed, purpose: str, ident: Column) -> Column:
    """A uniform integer in [0, 2^32)."""
    return F.conv(F.substring(digest(seed, purpose, ident), 1, 8), 16, 10).cast("long")


def uniform(seed, purpose: str, ident: Column) -> Column:
    return draw32(seed, purpose, ident) / F.lit(4294967296.0)


def symbol(seed, purpose: str, ident: Column, alphabet: int | Column) -> Column:
    return (draw32(seed, purpose, ident) % alphabet).cast("int")


def sql_draw32(seed: int, purpose: str, ident: str) -> str:
    """The same draw as DuckDB SQL."""
    return f"CAST('0x' || substr(md5('{seed}:{purpose}:' || ({ident})), 1, 8) AS BIGINT)"
