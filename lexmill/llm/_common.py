"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from lexmill.operators.spread import cut, discard, join_spread, scratch, shared_dir

__all__ = ["bucketed", "cut", "discard", "drop_table", "field", "free_name", "join_spread", "positions", "running", "scratch", "shared_dir", "small_batches", "train_remainder"]


#: Rows that Spark hands to a Python worker at once.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Ask for batches of few rows unless the session already does: texts are long, and a worker holds a batch."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(setting)) > BATCH_ROWS or int(spark.conf.get(setting)) <= 0:
        spark.conf.set(setting, BATCH_ROWS)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` has it (Spark ignores case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def train_remainder(doc_id: str, parts: int):
    """crc32 of the id written as text, modulo ``parts``; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % parts


def field(df: DataFrame, name: str, as_name: str | None = None) -> T.StructField:
    return T.StructField(as_name or name, df.schema[name].dataType, True)


def bucketed(df: DataFrame, name: str, keys: Sequence[str], buckets: int | None = None) -> tuple[DataFrame, str]:
    """Write ``df`` as a table in the shared folder, bucketed and sorted by ``keys``; the table and its name.

    Joins on the keys read it without a shuffle. ``drop_table`` deletes it.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"lexmill_{name}_{uuid.uuid4().hex}"
    writer = df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys)
    writer.option("path", f"{shared_dir(spark)}/{table}").saveAsTable(table)
    return spark.table(table), table


def drop_table(spark: SparkSession, table: str) -> None:
    """Drop what ``bucketed`` wrote, files too, once nothing reads it any more."""
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{table}")
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def positions(df: DataFrame, order: Sequence[Column | str], keys: Sequence[str] = (), at: str = "pos") -> DataFrame:
    """``df`` with the place of each row, from 1, within its ``keys`` (or in all) in the given order.

    Rows are dealt out by ranges of keys and order and numbered range by range, so that neither
    all rows nor those of a hot key meet in one task. What earlier ranges hold of a key is
    added; only the first key of a range has earlier rows, so there is at most one such number
    for each range, and these are broadcast.
    """
    part, own = free_name(df, "part"), free_name(df, "within")
    ranged = cut(df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn(part, F.spark_partition_id()), "ranges")
    counts = ranged.groupBy(part, *keys).agg(F.count("*").alias(at))
    before = W.Window.partitionBy(*keys).orderBy(part).rowsBetween(W.Window.unboundedPreceding, -1)
    earlier = counts.withColumn(at, F.sum(at).over(before)).where(F.col(at) > 0)
    numbered = ranged.withColumn(own, F.row_number().over(W.Window.partitionBy(part, *keys).orderBy(*order)))
    placed = numbered.join(F.broadcast(earlier), [part, *keys], "left").withColumn(at, F.coalesce(at, F.lit(0)) + F.col(own))
    return placed.select(*df.columns, at)


#: Places that are summed at once; a longer group is summed chunk by chunk.
CHUNK = 1024


def running(df: DataFrame, key: str, at: str, columns: Sequence[str], backwards: bool = False) -> DataFrame:
    """``df`` with each of ``columns`` replaced by its sum up to the row (or from it on) within ``key``.

    ``at`` numbers the rows of a key without large gaps. A hot key is summed in chunks of
    ``CHUNK`` places by different tasks; one task sees only its chunks' sums.
    """
    chunk = free_name(df, "chunk")
    order = F.col(at).desc() if backwards else F.col(at)
    rows = df.withColumn(chunk, F.floor(F.col(at) / CHUNK) * (-1 if backwards else 1))
    sums = rows.groupBy(key, chunk).agg(*[F.sum(c).alias(c) for c in columns])
    before = W.Window.partitionBy(key).orderBy(chunk).rowsBetween(W.Window.unboundedPreceding, -1)
    earlier = sums.select(key, chunk, *[F.sum(c).over(before).alias(f"{c}_before") for c in columns]).where(F.col(f"{columns[0]}_before").isNotNull())
    within = W.Window.partitionBy(key, chunk).orderBy(order).rowsBetween(W.Window.unboundedPreceding, 0)
    summed = rows.select(*[F.sum(c).over(within).alias(c) if c in columns else c for c in rows.columns]).join(earlier, [key, chunk], "left")
    return summed.select(*[(F.col(c) + F.coalesce(f"{c}_before", F.lit(0))).alias(c) if c in columns else c for c in df.columns])
