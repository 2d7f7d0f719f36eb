"""Connected components of a table of links, on Spark alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.operators.spread import cut, discard, join_spread


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and root, the smallest node reachable, of every node that has a link.

    Alternates two star contractions (large star, small star) until every link joins a node to
    its root. Each round is written to the shared folder, and the one before it deleted; links
    only ever get fewer or shorter. A node with many links does not gather them in one task.
    Self-links and repeated links are harmless; nulls are ignored; no links give no rows.
    """
    edges = links.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v")
    edges = cut(edges.distinct(), "links")
    before = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
        both = edges.union(edges.select("v", "u"))
        large = join_spread(both, _least(both), ["u"], "n", 2 * now[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large, "large-star")
        least = _least(large)
        small = join_spread(large, least, ["u"], "n", large.count()).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        old, edges = edges, cut(least.select("u", F.col("m").alias("v")).union(small).distinct(), "small-star")
        discard(old, large)
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def _least(edges: DataFrame) -> DataFrame:
    """For each u: m, the least of it and its v; n, its edges."""
    return edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("u", "m"))
