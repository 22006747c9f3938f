"""Compare a registered query with its SQL on the same parquet files, column by column and row by row, order aside."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, (float, int)) or type(value).__name__ == "Decimal":
        return round(float(value), 9)
    return value


def rows_of(records: list[dict]) -> list[tuple]:
    return sorted((tuple(plain(r[k]) for k in sorted(r)) for r in records), key=repr)


def differences(spark, folder: str, query, sql: str) -> str:
    got = [r.asDict() for r in query(spark, folder).collect()]
    con = connection(folder)
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    want = [dict(zip(names, r)) for r in cursor.fetchall()]
    if got and want and sorted(got[0]) != sorted(want[0]):
        return f"columns {sorted(got[0])} and {sorted(want[0])}"
    a, b = rows_of(got), rows_of(want)
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    return next((f"{x} and {y}" for x, y in zip(a, b) if x != y), "")
