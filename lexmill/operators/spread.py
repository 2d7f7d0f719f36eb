"""What operators of several jobs share: writing rows once, deleting them again, and joins that hot keys do not slow down."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it.

    Only a local session without ``spark.checkpoint.dir`` gets a temporary folder.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    at = "file://" + tempfile.mkdtemp(prefix="lexmill-")
    spark.conf.set("spark.checkpoint.dir", at) if spark.conf.isModifiable("spark.checkpoint.dir") else None
    return at


class _Scopes(threading.local):
    """The open scratch scopes of this thread; what another thread writes is not theirs."""

    def __init__(self):
        self.open: list[list[str]] = []


_scopes = _Scopes()


def cut(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: its lineage ends there.

    A lost executor can neither lose the rows nor cause them to be computed again. What is
    written stays until ``discard`` or, unless ``keep``, the end of an enclosing ``scratch``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexmill-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _scopes.open and not keep:
        _scopes.open[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def once(df: DataFrame, name: str) -> DataFrame:
    """``df`` itself if ``cut`` returned it, else what ``cut`` makes of it."""
    return df if getattr(df, "written_to", None) is not None else cut(df, name)


def discard(*written: DataFrame | None) -> None:
    """Delete what ``cut`` wrote and returned, once nothing reads it any more."""
    for df in written:
        if (path := getattr(df, "written_to", None)) is not None:
            _delete(df.sparkSession, [path])


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        if "/lexmill-" in path:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What operators write to the shared folder within this block is deleted at its end.

    Their results are read lazily, so write them elsewhere before.
    """
    _scopes.open.append([])
    try:
        yield
    finally:
        _delete(spark, _scopes.open.pop())


#: Keys that hold more than one in so many of all rows are heavy; there are fewer than that of them.
HEAVY = 1 << 14


def join_spread(rows: DataFrame, table: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with a table of one row for each key that no hot key slows down.

    ``count`` is the table's column of how many of the ``total`` rows have the key. The heavy
    keys, at most ``HEAVY``, are broadcast, so their rows stay where they are; only the others
    are shuffled to their keys.
    """
    least = max(total // HEAVY, 1)
    heavy = F.broadcast(table.where(F.col(count) > least))
    light = rows.join(heavy.select(*keys), keys, "left_anti").join(table.where(F.col(count) <= least), keys)
    return light.unionByName(rows.join(heavy, keys))
