"""Sections of documents as nested topics, and the maps that name them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.sources import sinks


def topic_tree(sections: DataFrame, key: str = "doc_id", levels: int = 6) -> DataFrame:
    """Sections (key, ord, level, title, ...) with parent (ord, null at the top), depth from 0, and way, the ords above.

    A section lies in the last one above it of smaller level, whatever levels are left out
    between; what stands before the first heading (level 0) is a topic of its own at the top.
    """
    w = Window.partitionBy(key).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.max(F.when(F.col("level") == k, F.col("ord"))).over(w) for k in range(1, levels + 1)]
    rows = sections.withColumn("_last", F.array(*last))
    # a level is open if nothing of a smaller one came after it
    open_ = F.filter(F.transform("_last", lambda o, k: F.struct(o.alias("ord"), (k + 1).alias("level"))), lambda x: x["ord"].isNotNull() & (x["level"] < F.col("level")))
    way = F.filter(open_, lambda x: F.forall(open_, lambda y: (y["level"] >= x["level"]) | (y["ord"] < x["ord"])))
    way = F.transform(way, lambda x: x["ord"])
    return rows.withColumn("way", way).withColumns({"depth": F.size("way"), "parent": F.try_element_at("way", F.lit(-1))}).drop("_last")


def _escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def topic_maps(tree: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, content): each document's map, references nested as its topics are, by the tags that each opens and closes."""
    after = F.lead("depth").over(Window.partitionBy(key).orderBy("ord"))
    name = F.concat(F.lit("t"), F.col(key).cast("string"), F.lit("_"), F.col("ord").cast("string"), F.lit(".dita"))
    opens = F.concat(F.lit('<topicref href="'), name, F.lit('" navtitle="'), _escaped(F.coalesce("title", F.lit(""))), F.lit('">'))
    closes = F.repeat(F.lit("</topicref>"), F.coalesce(F.col("depth") - after + 1, F.col("depth") + 1))
    parts = tree.select(key, "ord", F.concat(opens, closes).alias("part"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "part"))), lambda p: p["part"]), "")
    return parts.groupBy(key).agg(F.concat(F.lit("<map>"), joined, F.lit("</map>")).alias("content"))


def topic_package(sections: DataFrame, key: str = "doc_id") -> DataFrame:
    """(archive, path, content): a file for each topic and one map for each document, as ``sinks.write_archives`` takes them."""
    named = lambda rows: rows.withColumn("archive", F.regexp_extract("path", r"^t(.*)_\d+\.dita$", 1))
    topics = named(sinks.topic_files(sections, key, "dita"))
    maps = topic_maps(topic_tree(sections, key), key).select(F.lit("map.ditamap").alias("path"), "content", F.col(key).cast("string").alias("archive"))
    return topics.unionByName(maps).select("archive", "path", "content")
