"""Filters, joins, set operations, windows and paging."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.operators.spread import cut


def filtered(rows: DataFrame, **wanted) -> DataFrame:
    """Rows equal to every given value; a parameter that is None filters nothing, a list means any of it."""
    for name, value in wanted.items():
        if value is not None:
            rows = rows.where(F.col(name).isin(*value) if isinstance(value, (list, tuple, set)) else F.col(name) == value)
    return rows


def within_days(rows: DataFrame, ts: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """Rows from the start of ``first`` to the end of ``last``, as a half-open range that reaches the scan."""
    if first:
        rows = rows.where(F.col(ts) >= F.lit(first).cast("date"))
    if last:
        rows = rows.where(F.col(ts) < F.date_add(F.lit(last).cast("date"), 1))
    return rows


def any_contains(keyword: str, *columns: str) -> Column:
    """Whether any of the columns holds the keyword, ignoring case; null columns do not."""
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(keyword.lower())), F.lit(False))
    return found


def page(rows: DataFrame, order: Sequence[Column | str], number: int, size: int) -> DataFrame:
    """A page of rows in a total order, with the number of all rows as ``total``."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset((number - 1) * size).limit(size).join(F.broadcast(total))


def next_event(rows: DataFrame, session: str, order: str, role: str, asks: str, answers: str, columns: Sequence[str]) -> DataFrame:
    """Each asking row with the first strictly later answering row of its session, or nulls.

    One window over the session: no join, no square of its rows.
    """
    w = Window.partitionBy(session).orderBy(F.col(order)).rangeBetween(1, Window.unboundedFollowing)
    answer = F.when(F.col(role) == answers, F.struct(*(F.col(c).alias(f"next_{c}") for c in columns)))
    return rows.withColumn("_next", F.first(answer, ignorenulls=True).over(w)).where(F.col(role) == asks).select(*rows.columns, "_next.*")


def lookup(rows: DataFrame, names: DataFrame, key: str, name_key: str, name: str, default: str) -> DataFrame:
    """Rows with a name from a small table, or the default."""
    found = names.select(F.col(name_key).alias("_key"), F.col(name).alias("_name"))
    return rows.join(found, F.col(key) == F.col("_key"), "left").withColumn(name, F.coalesce("_name", F.lit(default))).drop("_key", "_name")


def unseen(rows: DataFrame, stored: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows whose key is not stored; null parts of keys are equal."""
    a, b = rows.alias("a"), stored.select(*key).distinct().alias("b")
    on = F.lit(True)
    for k in key:
        on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return a.join(b, on, "left_anti")


def compare_by_key(a: DataFrame, b: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """Full outer comparison: key, value_a, value_b and status same, different, only_a or only_b."""
    a = a.select(*key, F.col(value).alias("value_a"), F.lit(True).alias("in_a"))
    b = b.select(*key, F.col(value).alias("value_b"), F.lit(True).alias("in_b"))
    both = a.join(b, list(key), "full")
    status = F.when(F.col("in_a").isNull(), "only_b").when(F.col("in_b").isNull(), "only_a").when(F.col("value_a").eqNullSafe(F.col("value_b")), "same").otherwise("different")
    return both.select(*key, "value_a", "value_b", status.alias("status"))


def multiset_match(a: DataFrame, b: DataFrame, key: str, order_a: str, order_b: str) -> DataFrame:
    """The k-th row of ``a`` with a key beside the k-th of ``b``: each row at most once."""
    nth = lambda rows, order: rows.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    left = nth(a.select(key, F.col(order_a).alias("a_order")), "a_order")
    right = nth(b.select(key, F.col(order_b).alias("b_order")), "b_order")
    return left.join(right, [key, "nth"]).select(key, "a_order", "b_order")


def first_n_per_key(rows: DataFrame, key: Sequence[str], order: Sequence[Column | str], n: int = 1) -> DataFrame:
    """The first n rows of each key in a total order."""
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("_nth", nth).where(F.col("_nth") <= n).drop("_nth")


def islands(rows: DataFrame, key: str, order: Sequence[str], kind: str) -> DataFrame:
    """Runs of neighbouring rows of one kind: key, run, kind, size, first and last of the order column."""
    w = Window.partitionBy(key).orderBy(*order)
    new = (~F.col(kind).eqNullSafe(F.lag(kind).over(w))).cast("int")
    runs = rows.withColumn("_new", F.when(F.row_number().over(w) == 1, 1).otherwise(new)).withColumn("run", F.sum("_new").over(w))
    return runs.groupBy(key, "run", kind).agg(F.count("*").alias("n"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"))


def within_budget(rows: DataFrame, key: str, order: Sequence[Column | str], size: str, budget: int) -> DataFrame:
    """The longest prefix of each key's rows whose sizes sum to at most the budget."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(size).over(w)).where(F.col("used") <= budget)


def subtree(nodes: DataFrame, roots: Column, node: str = "node", parent: str = "parent") -> DataFrame:
    """node, depth and path of all nodes below the roots, however deep; a path never meets a node twice.

    Level by level: each joins the children of the one before and is written once.
    """
    rows = cut(nodes.select(F.col(node).alias("node"), F.col(parent).alias("parent"), F.coalesce(roots, F.lit(False)).alias("is_root")), "tree-nodes")
    children = rows.select(F.col("node").alias("child"), "parent").where("parent is not null")
    level = rows.where("is_root").select("node", F.lit(0).alias("depth"), F.array(F.col("node").cast("string")).alias("way"))
    levels = [level]
    while True:
        below = level.join(children, level["node"] == children["parent"]).where(~F.array_contains("way", F.col("child").cast("string")))
        level = cut(below.select(F.col("child").alias("node"), (F.col("depth") + 1).alias("depth"), F.concat("way", F.array(F.col("child").cast("string"))).alias("way")), "tree-level")
        if level.isEmpty():
            break
        levels.append(level)
    return reduce(DataFrame.union, levels).select("node", "depth", F.array_join("way", "/").alias("path"))


def merge_by_key(a: DataFrame, b: DataFrame, key: Sequence[str], score: str, bonus: int = 8, most: int = 99) -> DataFrame:
    """Two sets of findings as one: keys in lower case, models that agree, and a consensus score.

    The score of a key found by several models is its best one and a bonus for each further model.
    """
    lower = [F.lower(F.coalesce(F.col(k).cast("string"), F.lit(""))).alias(k) for k in key]
    rows = a.select(*lower, score, "model").unionByName(b.select(*lower, score, "model"))
    out = rows.groupBy(*key).agg(F.array_sort(F.collect_set("model")).alias("models"), F.max(score).alias("best"))
    return out.withColumn("consensus", F.least(F.lit(most), F.col("best") + bonus * (F.size("models") - 1)))
