"""Parameters of documents: extraction from lines and tables, exact then fuzzy comparison."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import text as X
from lexmill.operators import matching as M


def name_key(c: Column) -> Column:
    """A parameter's name without spaces and a bracket at its end, in lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(X.text_of(c), r"\s*[(\[][^)\]]*[)\]]\s*$", ""), r"\s+", ""))


def value_key(c: Column) -> Column:
    """A value with plain signs, single spaces and lower case."""
    return F.lower(X.collapsed(F.translate(X.text_of(c), "×−–", "x--")))


VALUE = r"^[<>≤≥±~]?\s*\d"


def extract(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", longest_name: int | None = None, two_lines: bool = False) -> DataFrame:
    """(doc_id, ord, name, value): ``name: value`` lines, those of lists too, and two-cell rows of pipe tables.

    With ``two_lines``, also a line without digits, colon or bar over one that begins with a number.
    Longer names than ``longest_name``, if it is given, are sentences, not names.
    """
    rows = docs.select(doc_id, F.posexplode(X.lines(F.col(text))).alias("ord", "line"))
    bullet = r"^\s*(?:[-*•+]|\d+[.)])\s+"
    below = F.lead("line").over(Window.partitionBy(doc_id).orderBy("ord")) if two_lines else F.lit(None).cast("string")
    rows = rows.withColumns({"line": F.regexp_replace("line", bullet, ""), "below": F.trim(below)})
    pair = F.regexp_extract_all("line", F.lit(r"^\s*([^:|]+?)\s*:\s*(\S.*?)\s*$"), 1), F.regexp_extract("line", r"^\s*([^:|]+?)\s*:\s*(\S.*?)\s*$", 2)
    cell = F.regexp_extract("line", r"^\s*\|?\s*([^|]+?)\s*\|\s*([^|]+?)\s*\|?\s*$", 1), F.regexp_extract("line", r"^\s*\|?\s*([^|]+?)\s*\|\s*([^|]+?)\s*\|?\s*$", 2)
    name = F.when(F.size(pair[0]) > 0, pair[0][0]).otherwise(cell[0])
    value = F.when(F.size(pair[0]) > 0, pair[1]).otherwise(cell[1])
    over = ~F.col("line").rlike(r"[\d:|]") & F.col("below").rlike(VALUE)
    name, value = F.when((name == "") & over, F.trim("line")).otherwise(name), F.when((name == "") & over, F.col("below")).otherwise(value)
    rows = rows.select(doc_id, "ord", name.alias("name"), value.alias("value"))
    rows = rows.where((F.col("name") != "") & (F.col("value") != "") & ~F.col("value").rlike(r"^[-=\s]+$"))
    return rows if longest_name is None else rows.where(F.length("name") <= longest_name)


def name_likeness(a: str, b: str) -> float:
    """What likens short names beside the ratio: few edits of at most 15 characters, or a common beginning."""
    a, b = a.casefold(), b.casefold()
    if a == b:
        return 1.0
    longer = max(len(a), len(b))
    same = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    prefix = 0.60 + 0.25 * same / longer if same >= 2 and same / longer >= 0.3 else 0.0
    if not a or not b or longer > 15:
        return prefix
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return max(prefix, 1.0 - row[-1] / longer)


def name_may(a: list[str], b: list[str], least: float) -> np.ndarray:
    """Which names ``name_likeness`` can bring to ``least``: two first characters in common, or short with enough in common."""
    a, b = [x.casefold() for x in a], [x.casefold() for x in b]
    longer = np.maximum.outer([len(x) for x in a], [len(x) for x in b])
    start = np.array([x[:2] for x in a])[:, None] == np.array([x[:2] for x in b])
    return start | ((longer <= 15) & (M.common_letters(a, b) >= least * longer - 1e-9))


def name_factor(least: float) -> float | None:
    """How many times as long as another a name may be: of ``least`` over .60 the common beginning tells.

    Case folding makes up to three characters of one.
    """
    share = min(max(4 * (least - 0.60), 0.3), least / (2 - least))
    return 3 / share if least > 0.60 else None


def compare(a: DataFrame, b: DataFrame, key: str, least: float = 0.70) -> DataFrame:
    """(key, name_a, name_b, value_a, value_b, status) of two sides' parameters (key, ord, name, value).

    Equal names meet first, the k-th with the k-th; names left over pair greedily by their ratio,
    few edits or common beginning, whichever is most;
    the rest is only_a or only_b. Values are equal up to spaces, case and signs.
    """
    ordered = Window.partitionBy(key, "_k").orderBy("ord")
    side = lambda rows, s: rows.withColumn("_k", name_key(F.col("name"))).withColumn("nth", F.row_number().over(ordered)).select(key, "_k", "nth", F.col("ord").alias(f"ord_{s}"), F.col("name").alias(f"name_{s}"), F.col("value").alias(f"value_{s}"))
    both = side(a, "a").join(side(b, "b"), [key, "_k", "nth"], "full")
    exact = both.where("ord_a is not null and ord_b is not null")
    left = both.where("ord_b is null").select(key, F.col("ord_a").alias("idx"), F.col("name_a").alias("text"), "value_a")
    right = both.where("ord_a is null").select(key, F.col("ord_b").alias("idx"), F.col("name_b").alias("text"), "value_b")
    pairs = M.greedy(M.alike(left, right, key, least, score=name_likeness, may=name_may, factor=name_factor(least)), key)
    fuzzy = pairs.join(left.select(key, F.col("idx").alias("a_idx"), F.col("text").alias("name_a"), "value_a"), [key, "a_idx"]).join(right.select(key, F.col("idx").alias("b_idx"), F.col("text").alias("name_b"), "value_b"), [key, "b_idx"])
    only_a = left.join(pairs.select(key, F.col("a_idx").alias("idx")), [key, "idx"], "left_anti").select(key, F.col("text").alias("name_a"), "value_a")
    only_b = right.join(pairs.select(key, F.col("b_idx").alias("idx")), [key, "idx"], "left_anti").select(key, F.col("text").alias("name_b"), "value_b")
    columns = [key, "name_a", "name_b", "value_a", "value_b"]
    out = exact.select(*columns).unionByName(fuzzy.select(*columns)).unionByName(only_a, allowMissingColumns=True).unionByName(only_b, allowMissingColumns=True)
    same = value_key(F.col("value_a")) == value_key(F.col("value_b"))
    return out.withColumn("status", F.when(F.col("name_b").isNull(), "only_a").when(F.col("name_a").isNull(), "only_b").when(same, "same").otherwise("different"))
