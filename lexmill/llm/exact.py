"""Exact duplicates against a persistent index of digests.

The index is a table of one row for each distinct text ever taken in, bucketed and sorted by
the text's SHA-256. New rows are reduced to their digests, those of one batch to one row, and
meet the index in a sort-merge anti-join for which the index is not shuffled; what the index
has not is appended. Texts themselves are read once and neither shuffled nor kept.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm._common import cut, discard, drop_table, join_spread, shared_dir

SCHEMA = "digest binary, keep_id long, keep_row long, batch string"


class DigestIndex:
    """Digests of all texts taken in so far, in the table ``name``; made if it does not exist.

    The table lies in ``path``, else in the session's warehouse, and outlives the session where
    the catalog does. ``buckets`` is fixed when the table is made: some hundred MB of digests
    each (32 bytes a text) is a good size.
    """

    def __init__(self, spark: SparkSession, name: str, buckets: int = 64, path: str | None = None):
        self.spark, self.name, self.buckets, self.path = spark, name, buckets, path
        if not spark.catalog.tableExists(name):
            self._append(spark.createDataFrame([], SCHEMA))

    def _append(self, rows: DataFrame) -> None:
        writer = rows.repartition(self.buckets, "digest").write.mode("append").bucketBy(self.buckets, "digest").sortBy("digest")
        (writer.option("path", self.path) if self.path else writer).saveAsTable(self.name)

    @property
    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, rows: DataFrame, batch: str) -> None:
        """Take in rows of digest, doc_id and row; of equal new ones that of largest doc_id is named.

        Digests that the index has stay as they are: what came first is kept. ``batch`` is
        written beside the new ones.
        """
        last = F.max(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "row")).alias("last")
        found = rows.groupBy("digest").agg(last).select("digest", F.col("last.doc_id").alias("keep_id"), F.col("last.row").alias("keep_row"), F.lit(batch).alias("batch"))
        new = cut(found.join(self.table.select("digest").hint("merge"), "digest", "left_anti"), "new-digests")
        self._append(new)
        discard(new)


def digests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """row (a number of its own), doc_id and SHA-256 of each row's text; null counts as empty."""
    digest = F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"), digest.alias("digest"))


def exact_classes(docs: DataFrame, index: DigestIndex, batches: int = 2, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row, after taking all into ``index``.

    Texts are equal when they are the same characters; null counts as empty. Of equal texts that
    are new, the row of the largest doc_id stays (null ids last; of rows that share it, one);
    where the index had the text before, none stays and keep_id names the row taken in then.
    group_size counts the given rows of the text. Repeated rows each give a row; other columns
    are ignored; an empty table gives an empty result and leaves the index as it is.

    Rows come in ``batches`` ranges of ids, the largest ids first, so that a batch has only the
    memory of its own digests. A text that a third of all rows share is one row after the
    aggregate within tasks, and its rows get their group by a broadcast of the heavy groups.
    """
    rows, batch = cut(digests(docs, text, doc_id), "digests"), uuid.uuid4().hex
    low, high, total = rows.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    edges = [low + (high - low + 1) * k // batches for k in range(batches)] if low is not None else []
    upper = None
    for edge in reversed(edges):
        part = F.col("doc_id") >= edge
        index.add(rows.where(part if upper is None else part & (F.col("doc_id") < upper)), batch)
        upper = edge
    index.add(rows.where(F.col("doc_id").isNull()), batch)
    sizes = rows.groupBy("digest").agg(F.count("*").alias("group_size"))
    groups = index.table.join(sizes, "digest")
    kept = ((F.col("batch") == batch) & (F.col("row") == F.col("keep_row"))).alias("kept")
    out = join_spread(rows, groups, ["digest"], "group_size", total)
    return out.select("doc_id", "keep_id", "group_size", kept, F.lower(F.hex("digest")).alias("text_sha256"))


def exact_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``exact_classes`` of one table by itself: with an index that goes when the result is written."""
    spark = docs.sparkSession
    name = f"lexmill_digests_{uuid.uuid4().hex}"
    index = DigestIndex(spark, name, int(spark.conf.get("spark.sql.shuffle.partitions")), f"{shared_dir(spark)}/{name}")
    out = cut(exact_classes(docs, index, text=text, doc_id=doc_id), "exact")
    drop_table(spark, name)
    return out


#: The same in SQL, for one table with an empty index.
EXACT_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
