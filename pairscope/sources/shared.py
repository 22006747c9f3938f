"""Intermediate tables in the folder that driver and executors share.

Everything stored lies under one folder per application, which the file system removes when the application ends; scratch()
removes tables earlier."""

from __future__ import annotations

import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_open = threading.local()
_folders: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """This application's folder under spark.checkpoint.dir, or under the folder given to setCheckpointDir.

    Where neither is set, a temporary folder serves a local master, whose tasks run on the driver; on a cluster that is an
    error."""
    sc = spark.sparkContext
    app = sc.applicationId
    if app not in _folders:
        root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
        if not root:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors reach")
            root = "file://" + tempfile.gettempdir()
        _folders[app] = f"{root.rstrip('/')}/pairscope-{app}-{uuid.uuid4().hex[:8]}"
        path = spark._jvm.org.apache.hadoop.fs.Path(_folders[app])
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
    return _folders[app]


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write df under the shared folder and read it back: lineage ends in files that survive lost executors."""
    path = f"{shared_root(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_path = path
    if getattr(_open, "held", None):
        _open.held[-1].append(out)
    return out


@contextmanager
def scratch():
    """Tables stored inside by this thread are removed at the end, but for those handed to the yielded function."""
    held: list = []
    kept: list = []
    stack = _open.__dict__.setdefault("held", [])
    stack.append(held)
    try:
        yield kept.append
    finally:
        stack.pop()
        for df in held:
            if not any(df is k for k in kept):
                discard(df)
            elif stack:
                stack[-1].append(df)


def discard(df: DataFrame) -> None:
    """Remove the files behind a frame made by stored()."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._stored_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
