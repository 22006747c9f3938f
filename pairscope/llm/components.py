"""Connected components of a link table by alternating large-star and small-star rounds.

Only narrow (id, id) rows move.  A hub's neighbours are never gathered: each round takes a partial-aggregated minimum
per node and joins it back.  Every round is a table in the shared folder, so lost executors cost one round at most."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def fingerprint(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def connected_components(links: DataFrame, src: str, dst: str, max_rounds: int = 60) -> DataFrame:
    """(id, component) for every id that has a link; component is the smallest id that it reaches.

    Self links and links with a null end are ignored; repeated links count once."""
    edges = links.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where(f"{src} is not null and {dst} is not null and {src} <> {dst}").distinct()
    edges = stored(edges, "links")
    before = fingerprint(edges)
    for _ in range(max_rounds if before[0] else 0):
        # large star: neighbours above u go to the least of u and its neighbours
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its smaller neighbours go to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e")).select(F.col("e.u").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct()
        after_edges = stored(small, "links")
        discard(edges)
        edges, after = after_edges, fingerprint(after_edges)
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
