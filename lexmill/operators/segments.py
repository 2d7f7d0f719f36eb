"""Documents as rows: lines, sections, sentences, chunks and pages; and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import text as X


def exploded(docs: DataFrame, parts: Column, doc_id: str = "doc_id", position: str = "idx", name: str = "text") -> DataFrame:
    """doc_id, position from 0 and part of every part of every document."""
    return docs.select(doc_id, F.posexplode(parts).alias(position, name))


def lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, line_number from 1 and content: the inverse is ``joined_lines``."""
    return exploded(docs, X.lines(F.col(text)), doc_id, "idx", "content").select(doc_id, (F.col("idx") + 1).alias("line_number"), "content")


def joined_lines(rows: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Documents from their lines in order."""
    ordered = F.array_sort(F.collect_list(F.struct("line_number", "content")))
    return rows.groupBy(doc_id).agg(F.array_join(F.transform(ordered, lambda x: x["content"]), "\n").alias("text"))


def with_running_heading(rows: DataFrame, heading: Column, key: str = "doc_id", order: str = "line_number", none: str = "") -> DataFrame:
    """Each line with the last heading at or above it."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("chapter", F.coalesce(F.last(F.when(heading, F.col("content")), ignorenulls=True).over(w), F.lit(none)))


def nearest_parent(rows: DataFrame, key: str = "doc_id", order: str = "ord", level: str = "level", levels: int = 6) -> DataFrame:
    """Each heading's parent: the nearest one above of smaller level, null at the top.

    One window and one running maximum for each level, instead of a self-join.
    """
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    at = [F.max(F.when(F.col(level) == k, F.col(order))).over(w) for k in range(1, levels + 1)]
    parent = F.greatest(*(F.when(F.col(level) > k, at[k - 1]) for k in range(1, levels + 1)), F.lit(None).cast("int"))
    return rows.withColumn("parent", parent)


def repeated_edge_lines(pages: DataFrame, key: str = "doc_id", page: str = "page_num", order: str = "line_number", edge: int = 3, least: int = 3) -> DataFrame:
    """Lines among the first or last ``edge`` of a page that occur there on ``least`` pages or more: headers and footers."""
    w = Window.partitionBy(key, page)
    rows = pages.withColumns({"_up": F.row_number().over(w.orderBy(order)), "_down": F.row_number().over(w.orderBy(F.desc(order)))})
    near = rows.where(((F.col("_up") <= edge) | (F.col("_down") <= edge)) & (F.trim("content") != ""))
    return near.groupBy(key, F.trim("content").alias("content")).agg(F.countDistinct(page).alias("pages")).where(F.col("pages") >= least)


def merged_wrapped(rows: DataFrame, key: str = "doc_id", order: str = "line_number") -> DataFrame:
    """Lines that go on in the next (no end mark, next in lower case) joined to it."""
    w = Window.partitionBy(key).orderBy(order)
    before = F.lag("content").over(w)
    goes_on = before.isNotNull() & ~before.rlike(r"[.!?:;]\s*$") & F.col("content").rlike(r"^\s*\p{Ll}") & (F.trim(before) != "")
    rows = rows.withColumn("_new", (~F.coalesce(goes_on, F.lit(False))).cast("int")).withColumn("block", F.sum("_new").over(w))
    ordered = F.array_sort(F.collect_list(F.struct(order, F.trim("content").alias("content"))))
    return rows.groupBy(key, "block").agg(F.array_join(F.transform(ordered, lambda x: x["content"]), " ").alias("content"))


def filled_down(rows: DataFrame, column: str, key: str, order: str) -> DataFrame:
    """Blank cells with the last value above that is not blank."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(column, F.last(F.when(F.trim(column) != "", F.col(column)), ignorenulls=True).over(w))


def page_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """title and text of web pages by patterns: hidden elements go, block ends become lines, references of five kinds decode.

    An approximation for markup that is well formed.
    """
    h = X.text_of(F.col(html))
    title = F.trim(F.regexp_extract(h, r"(?is)<title[^>]*>(.*?)</title>", 1))
    body = h
    for tag in ("script", "style", "noscript", "head"):
        body = F.regexp_replace(body, rf"(?is)<{tag}[^>]*>.*?</{tag}>", " ")
    body = F.regexp_replace(body, r"(?s)<!--.*?-->", " ")
    body = F.regexp_replace(body, r"(?i)</?(?:p|div|li|ul|ol|tr|h[1-6]|br|section|article|nav|footer|header|table)\b[^>]*>", "\n")
    body = F.regexp_replace(body, r"<[^>]*>", "")
    for ref, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        body = F.replace(body, F.lit(ref), F.lit(char))
    body = F.regexp_replace(F.regexp_replace(body, r"[ \t\r]+", " "), r" ?\n[ \n]*", "\n")
    return pages.select(*(c for c in pages.columns if c != html), title.alias("title"), F.trim(F.regexp_replace(body, r"^\n+|\n+$", "")).alias("text"))


def page_of(snippets: DataFrame, pages: DataFrame, key: str = "doc_id", page: str = "page_num", probe: int = 40) -> DataFrame:
    """Each snippet (key, snippet) with the first page that holds its start, 0 if none does."""
    found = snippets.join(pages.select(F.col(key).alias("_key"), F.col(page).alias("_page"), F.col("text").alias("_text")), (F.col(key) == F.col("_key")) & (F.trim(F.left("snippet", F.lit(probe))) != "") & F.contains("_text", F.trim(F.left("snippet", F.lit(probe)))), "left")
    return found.groupBy(*snippets.columns).agg(F.coalesce(F.min("_page"), F.lit(0)).alias("page"))


def longest(rows: DataFrame, key: str, order: str, text: str = "text", k: int = 3) -> DataFrame:
    """The k longest texts of each key; of equals the earlier."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(F.length(text)), order))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def preview(rows: DataFrame, order: list, n: int = 20, columns: int = 12) -> DataFrame:
    """The head of a table: its first rows in order, its first columns, and how many rows and columns it has."""
    total = rows.agg(F.count("*").alias("total_rows"))
    head = rows.orderBy(*order).limit(n).select(*rows.columns[:columns])
    return head.join(F.broadcast(total)).withColumn("total_columns", F.lit(len(rows.columns)))
