"""Exact top-k inner products by a Voronoi kNN join.

Vectors are quantised to integers.  Adding the coordinate sqrt(M^2 - |x|^2) to every datum (0 to a query) turns the largest
inner product into the smallest distance, so the triangle inequality holds: pivots, whose number grows with the root of
the data, cut data into cells, and per-cell summaries (rows, radius, least distance, the rows nearest to the pivot) bound
how far a query's k-th neighbour can be.  A query goes to a cell only if the ring of the cell and its side of the plane
between the two pivots leave room for a datum within that bound.  Rows of the query's own id are left out of its
bound one by one, so an id that repeats costs the bounds of its own queries only.

Cells are cut into blocks of bounded size by a hash of the id, so a cell of a third of all rows is many tasks.  Queries are
replicated to the blocks that they need, solved there, and the k best per query and block are merged by another partial
top-k.  Where vectors lie in all directions alike, as random ones do, no bound excludes anything and every query meets
every block; on clustered vectors most cells are left out (README has the measured shares).

Defined cases: null vectors, vectors with null or non-finite components, and null ids take no part; a query sees
vectors of its own length only; rows that repeat an id are candidates each, never for a query of that id; a query with fewer
than k candidates gets all; components beyond 64 bits saturate there, and so do scores, which then tie and go to the
smaller id; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import scratch, small_batches, stored

#: Plan sizes; results do not depend on them.  Pivots are the root of the rows, within these bounds, spread by
#: farthest-first choice among so many times their number of rows.
LEAST_PIVOTS, MOST_PIVOTS, PIVOT_SAMPLE, BLOCK_ROWS, BATCH_QUERIES = 8, 1024, 8, 16_384, 16_384
FOUND_DDL = "query_id long, copy long, vec_id long, score long"


def quantised(table: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, v array<long>, dim) of the rows that take part."""
    fine = F.forall(F.col(vec_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    v = F.transform(F.col(vec_col), lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return table.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & (F.size(vec_col) > 0) & fine).select(F.col(id_col).cast("long").alias("id"), v.alias("v"), F.size(vec_col).alias("dim"))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as an integer matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.int64).reshape(len(column), -1)


def lifted(v: np.ndarray, top: float | None) -> np.ndarray:
    """Data (top: the largest square of a norm) or queries (None) in the space where closeness is inner product."""
    x = v.astype(float)
    extra = np.zeros(len(x)) if top is None else np.sqrt(np.maximum(top - (x * x).sum(1), 0))
    return np.column_stack([x, extra])


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] - 2 * x @ pivots.T + (pivots * pivots).sum(1)[None], 0))


def assigned(rows: DataFrame, pivots: np.ndarray, top: float) -> DataFrame:
    """rows with their nearest pivot (cell) and its distance."""
    held = rows.sparkSession.sparkContext.broadcast(pivots)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                far = distances(lifted(matrix(batch.column("v")), top), held.value)
                cell = far.argmin(1)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(cell, pa.int32()), pa.array(far[np.arange(len(far)), cell])], names=["id", "v", "cell", "dist"])

    return rows.select("id", "v").mapInArrow(task, "id long, v array<long>, cell int, dist double")


def spread_out(x: np.ndarray, count: int) -> np.ndarray:
    """The first row, then again and again the row farthest from those chosen."""
    chosen, far = [0], np.full(len(x), np.inf)
    while len(chosen) < min(count, len(x)):
        far = np.minimum(far, distances(x, x[chosen[-1:]])[:, 0])
        far[chosen] = -1
        chosen.append(int(far.argmax()))
    return x[chosen]


class Cells:
    """What the bounds need to know of all cells: pivots, rows, radius, least distance, and the `keep` rows of
    different ids nearest to the pivot (distance and id; infinite where there are fewer)."""

    def __init__(self, pivots: np.ndarray, found: dict[int, tuple[int, float, float, list]], keep: int, top: float):
        self.cells = np.array(sorted(found), np.int64)
        self.pivots = pivots[self.cells]
        self.rows, self.radius, self.least = (np.array([found[c][i] for c in self.cells.tolist()], float) for i in range(3))
        self.near, self.ids = np.full((len(self.cells), keep), np.inf), np.zeros((len(self.cells), keep), np.int64)
        for k, c in enumerate(self.cells.tolist()):
            first: dict[int, float] = {}
            for dist, ident in found[c][3]:
                first.setdefault(ident, dist)
            for j, (ident, dist) in enumerate(list(first.items())[:keep]):
                self.near[k, j], self.ids[k, j] = dist, ident
        self.gap = distances(self.pivots, self.pivots)
        self.longest = math.sqrt(top)
        # rounding of a distance is about the root of a double's precision times the norms
        self.slack = 1e-6 * (1 + self.longest)

    def visits(self, ids: np.ndarray, v: np.ndarray, k: int) -> list[np.ndarray]:
        """For each query the cells that can hold one of its k nearest."""
        out = []
        step = max(1, (1 << 21) // max(1, self.near.size))
        for at in range(0, len(v), step):
            far = distances(lifted(v[at : at + step], None), self.pivots)
            reach = far[:, :, None] + np.where(self.ids[None] == ids[at : at + step, None, None], np.inf, self.near[None])
            reach = reach.reshape(len(far), -1)
            limit = np.partition(reach, k - 1)[:, k - 1] if reach.shape[1] >= k else np.full(len(far), np.inf)
            # scores that may saturate can tie beyond any bound
            limit[np.linalg.norm(v[at : at + step].astype(float), axis=1) * self.longest >= 2**62] = np.inf
            home = far.argmin(1)
            with np.errstate(divide="ignore", invalid="ignore"):
                plane = (far**2 - (far[np.arange(len(far)), home] ** 2)[:, None]) / (2 * self.gap[home])
            plane[~np.isfinite(plane)] = 0
            apart = np.maximum(np.maximum(far - self.radius[None], self.least[None] - far), plane)
            out += [self.cells[row] for row in apart <= limit[:, None] * (1 + 1e-9) + self.slack]
        return out


def summaries(cells: DataFrame, keep: int) -> dict[int, tuple[int, float, float, list]]:
    """cell -> (rows, radius, least distance, its nearest (distance, id)): one bounded row per cell, pre-aggregated in
    the tasks."""
    ddl = "cell int, n long, radius double, least double, near array<struct<dist:double,id:long>>"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, list] = {}
        for batch in batches:
            cell, dist, ids = (np.asarray(batch.column(c)) for c in ("cell", "dist", "id"))
            for c in np.unique(cell).tolist():
                d, who = dist[cell == c], ids[cell == c]
                n, radius, near = seen.get(c, (0, 0.0, {}))
                near = dict(near)
                for j in np.argsort(d, kind="stable").tolist():
                    if len(near) >= keep and d[j] >= max(near.values()):
                        break
                    near[int(who[j])] = min(float(d[j]), near.get(int(who[j]), np.inf))
                    near = dict(sorted(near.items(), key=lambda x: x[1])[:keep])
                seen[c] = (n + len(d), max(radius, float(d.max())), near)
        if seen:
            least = [min(s[2].values()) for s in seen.values()]
            near = [[{"dist": d, "id": i} for i, d in s[2].items()] for s in seen.values()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.int32()), pa.array([s[0] for s in seen.values()], pa.int64()), pa.array([s[1] for s in seen.values()], pa.float64()), pa.array(least, pa.float64()), pa.array(near, pa.list_(pa.struct([("dist", pa.float64()), ("id", pa.int64())])))],
                names=["cell", "n", "radius", "least", "near"],
            )

    merged = (
        cells.select("cell", "dist", "id")
        .mapInArrow(task, ddl)
        .groupBy("cell")
        .agg(F.sum("n").alias("n"), F.max("radius").alias("radius"), F.min("least").alias("least"), F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, 4 * keep).alias("near"))
    )
    return {r["cell"]: (r["n"], r["radius"], r["least"], [(x["dist"], x["id"]) for x in r["near"]]) for r in merged.collect()}


def routed(asked: DataFrame, cells: Cells, k: int) -> DataFrame:
    """asked with copy, which tells queries of one id apart, and the cells that each visits."""
    held = asked.sparkSession.sparkContext.broadcast(cells)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = held.value.visits(np.asarray(batch.column("id")), matrix(batch.column("v")), k)
                ends = np.cumsum([0, *map(len, found)])
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("copy"), batch.column("v"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found), pa.int32()))], names=["id", "copy", "v", "cells"])

    return asked.select("id", F.xxhash64("v").alias("copy"), "v").mapInArrow(task, "id long, copy long, v array<long>, cells array<int>")


def solve(k: int):
    """Local top-k of a (cell, block, batch): a matrix product, then the k best of each query by score and id."""
    schema = pa.schema([("query_id", pa.int64()), ("copy", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        ids = np.asarray(left.column("id").combine_chunks())
        order = np.argsort(ids, kind="stable")
        ids, data = ids[order], matrix(left.column("v"))[order]
        asked, copies, q = np.asarray(right.column("id").combine_chunks()), np.asarray(right.column("copy").combine_chunks()), matrix(right.column("v"))
        largest = float(np.abs(data.astype(float)).max(initial=0)) * float(np.abs(q.astype(float)).max(initial=0)) * data.shape[1]
        # doubles hold the scores exactly, else 64 bits do, else Python's integers do and saturate
        kind = float if largest < 2**53 else np.int64 if largest < 2**62 else object
        data_t = data.T.astype(kind)
        rows: list[np.ndarray] = []
        step = max(1, (1 << 22) // len(ids))
        for at in range(0, len(q), step):
            part = q[at : at + step].astype(kind) @ data_t
            part = np.minimum(np.maximum(part, -(2**63)), 2**63 - 1).astype(np.int64) if kind is object else part.astype(np.int64)
            own = ids[None] == asked[at : at + step, None]
            for i in range(len(part)):
                s = part[i]
                open_to = np.nonzero(~own[i])[0] if own[i].any() else None
                s = s if open_to is None else s[open_to]
                if len(s) > k:
                    hit = np.nonzero(s >= np.partition(s, len(s) - k)[len(s) - k])[0]
                else:
                    hit = np.arange(len(s))
                best = hit[np.argsort(-s[hit], kind="stable")[:k]]
                found = best if open_to is None else open_to[best]
                rows.append(np.column_stack([np.full(len(best), asked[at + i]), np.full(len(best), copies[at + i]), ids[found], s[best].astype(np.int64)]))
        table = np.concatenate(rows)
        return pa.Table.from_arrays([pa.array(table[:, j]) for j in range(4)], schema=schema)

    return task


def cells_of(data: DataFrame, k: int, pivots: int | None) -> tuple[DataFrame, Cells] | None:
    """Stored data with its cells, and their summaries; None without data."""
    about = data.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))).alias("top"), F.count(F.lit(1)).alias("n")).first()
    if not about["n"]:
        return None
    count = pivots or min(MOST_PIVOTS, max(LEAST_PIVOTS, int(math.sqrt(about["n"]))))
    some = np.array([r["v"] for r in data.orderBy(F.xxhash64("id", F.lit(7)), "id", "v").limit(PIVOT_SAMPLE * count).select("v").collect()], np.int64)
    centres = spread_out(np.unique(lifted(some, about["top"]), axis=0), count)
    cells = stored(assigned(data, centres, about["top"]), "cells")
    return cells, Cells(centres, summaries(cells, k + 1), k + 1, about["top"])


def top_of_dimension(data: DataFrame, asked: DataFrame, k: int, pivots: int | None) -> DataFrame | None:
    """FOUND_DDL: the k best of every query within each block that it visits."""
    made = cells_of(data, k, pivots)
    if made is None:
        return None
    spark, (cells, about) = data.sparkSession, made
    queries = stored(routed(asked, about, k), "routed")
    load = {r["cell"]: r["count"] for r in queries.select(F.explode("cells").alias("cell")).groupBy("cell").count().collect()}
    # plan: blocks per cell and batches of queries per cell, one row per cell
    plan = [(int(c), max(1, -(-int(n) // BLOCK_ROWS)), max(1, -(-load[int(c)] // BATCH_QUERIES))) for c, n in zip(about.cells, about.rows) if int(c) in load]
    steps = F.broadcast(spark.createDataFrame(plan, "cell int, blocks int, batches int"))
    spread = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = cells.join(steps, "cell").select("cell", F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks")).cast("int").alias("block"), spread(F.col("batches")).alias("batch"), "id", "v")
    right = (
        queries.select(F.explode("cells").alias("cell"), "id", "copy", "v")
        .join(steps, "cell")
        .select("cell", spread(F.col("blocks")).alias("block"), F.pmod(F.xxhash64("id", F.lit(2)), F.col("batches")).cast("int").alias("batch"), "id", "copy", "v")
    )
    key = ["cell", "block", "batch"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(solve(k), FOUND_DDL)


def top_inner_products(table: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", pivots: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k largest integer inner products, ties to the smaller id."""
    small_batches(table.sparkSession)
    with scratch() as keep:
        data = stored(quantised(table, id_col, vec_col, scale), "vectors")
        asked = stored(quantised(queries, id_col, vec_col, scale).distinct(), "queries")
        best = table.sparkSession.createDataFrame([], FOUND_DDL)
        for d in sorted(r["dim"] for r in asked.select("dim").distinct().collect()):
            part = top_of_dimension(data.where(F.col("dim") == d), asked.where(F.col("dim") == d), k, pivots)
            best = best if part is None else best.unionByName(part)
        order = Window.partitionBy("query_id", "copy").orderBy(F.desc("score"), "vec_id")
        top = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        out = stored(top.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "top")
        keep(out)
    return out
