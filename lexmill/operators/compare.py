"""Comparison of documents and of packages of documents: segments, differences, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import text as X
from lexmill.operators import matching as M
from lexmill.operators import segments as G
from lexmill.operators.spread import cut

PAGE_MARK = r"(?m)^\s*(?:page|第)\s*\d+\s*(?:页|of \d+)?\s*$"


def normalized(c: Column) -> Column:
    """Without lines that only number pages, broken lines joined, single spaces."""
    out = F.regexp_replace(X.text_of(c), PAGE_MARK, "")
    out = F.regexp_replace(out, r"([^.!?:\n])\n(\p{Ll})", "$1 $2")
    return F.trim(F.regexp_replace(out, r"[ \t\r\f]+", " "))


def segments(docs: DataFrame, key: str, text: str = "text", least: int = 5) -> DataFrame:
    """(key, idx, text) of the normalized sentences."""
    return G.exploded(docs, X.sentences(normalized(F.col(text)), least), key)


def document_pairs(a: DataFrame, b: DataFrame, key: str, least: float = 0.80, text: str = "text") -> DataFrame:
    """One-to-one sentence pairs of two versions of each document (key, text): exact, then greedy fuzzy."""
    return M.with_exact(segments(a, key, text), segments(b, key, text), key, least)


def compare_documents(a: DataFrame, b: DataFrame, key: str, least: float = 0.80, text: str = "text") -> DataFrame:
    """Similarity, coverage, counts of differences and verdict of two versions of each document."""
    left, right = (cut(segments(d, key, text), "segments") for d in (a, b))
    pairs = M.with_exact(left, right, key, least)
    changed = pairs.groupBy(key).agg(F.count_if(F.col("score") < 1).alias("modified"))
    out = M.fuzzy_jaccard(pairs, left, right, key).join(changed, key, "left").fillna(0, ["modified"])
    return out.withColumns({"deleted": F.col("n_a") - F.col("pairs"), "added": F.col("n_b") - F.col("pairs"), "risk": risk(F.col("fuzzy"))})


def differences(a: DataFrame, b: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """(key, type, a_idx, b_idx, text_a, text_b, score, severity): what was modified, deleted or added.

    a and b are segments, pairs their one-to-one pairs.
    """
    left, right = a.select(key, F.col("idx").cast("long").alias("a_idx"), F.col("text").alias("text_a")), b.select(key, F.col("idx").cast("long").alias("b_idx"), F.col("text").alias("text_b"))
    both = left.join(pairs.select(key, "a_idx", "b_idx", "score"), [key, "a_idx"], "left").join(right, [key, "b_idx"], "full")
    kind = F.when(F.col("text_a").isNull(), "added").when(F.col("text_b").isNull(), "deleted").when(F.col("score") < 1, "modified")
    out = both.withColumn("type", kind).where("type is not null")
    return out.withColumn("severity", severity(F.col("text_a"), F.col("text_b"))).select(key, "type", "a_idx", "b_idx", "text_a", "text_b", "score", "severity")


NUMBER = r"\d+(?:[.,]\d+)*"
WARNING = r"(?i)\b(?:warning|caution|danger|must|never|voltage|password)\b"


def severity(a: Column, b: Column, warning: str = WARNING) -> Column:
    """high if warnings (a pattern) or numbers changed, medium if words did, else low."""
    numbers = lambda c: F.array_sort(F.regexp_extract_all(X.text_of(c), F.lit(NUMBER), 0))
    warned = X.text_of(a).rlike(warning) | X.text_of(b).rlike(warning)
    return F.when(warned | (numbers(a) != numbers(b)), "high").when(X.tokens(a) != X.tokens(b), "medium").otherwise("low")


def risk(similarity: Column) -> Column:
    return F.when(similarity >= 0.95, "low").when(similarity >= 0.80, "medium").otherwise("high")


def merged_neighbours(diffs: DataFrame, key: str, order: str, kind: str = "type", text: str = "text") -> DataFrame:
    """Differences of one kind in a row as one, texts joined by spaces."""
    w = Window.partitionBy(key).orderBy(order)
    new = (~F.col(kind).eqNullSafe(F.lag(kind).over(w)) | (F.col(order) - F.lag(order).over(w) > 1)).cast("int")
    rows = diffs.withColumn("_run", F.sum(F.coalesce(new, F.lit(1))).over(w))
    parts = F.array_sort(F.collect_list(F.struct(order, text)))
    return rows.groupBy(key, "_run", kind).agg(F.min(order).alias("first"), F.count("*").alias("n"), F.array_join(F.transform(parts, lambda p: p[text]), " ").alias(text)).drop("_run")


# From which similarity a topic has each state.
TOPIC_STATES = ((0.99, "same"), (0.95, "high"), (0.85, "mostly"), (0.70, "partly"), (0.50, "low"), (0.0, "very_low"))


def topic_state(similarity: Column) -> Column:
    out = None
    for least, name in TOPIC_STATES:
        out = F.when(similarity >= least, name) if out is None else out.when(similarity >= least, name)
    return out


def rollup(topics: DataFrame, key: str) -> DataFrame:
    """A package comparison from its topics (key, similarity; null where only one side has it, side a or b):
    topics on each side, matched, in each of six states, the mean similarity and the weighted one (1 from .99, a half from .70)."""
    s, matched = F.col("similarity"), F.col("similarity").isNotNull()
    points = F.when(s >= 0.99, 1.0).when(s >= 0.70, 0.5).when(matched, 0.0)
    return topics.groupBy(key).agg(
        F.count_if(matched).alias("matched"),
        F.count_if(~matched & (F.col("side") == "a")).alias("only_a"),
        F.count_if(~matched & (F.col("side") == "b")).alias("only_b"),
        *(F.count_if(topic_state(s) == name).alias(name) for _, name in TOPIC_STATES),
        F.round(F.coalesce(F.avg(s), F.lit(0.0)), 4).alias("mean"),
        F.round(F.coalesce(F.avg(points), F.lit(0.0)), 4).alias("weighted"),
    )


# What a source promises that its package must hold: name and pattern of a line.
PROMISES = {
    "notes": r"(?im)^\s*(?:[-*]\s+)?(?:note|notice|caution|warning|danger)\b",
    "tables": r"(?im)^\s*table\s+\d+",
    "figures": r"(?im)^\s*figure\s+\d+",
    "ordered": r"(?m)^\s*\d+[.)]\s",
    "unordered": r"(?m)^\s*[-*+]\s",
    "images": r"!\[[^\]]*\]\([^)]+\)",
}


def verify_package(sources: DataFrame, package: DataFrame, key: str, promises: dict[str, str] | None = None, text: str = "text") -> DataFrame:
    """(key, promise, expected, found, status) for each promise of each source: what its package's topics together hold."""
    promises = promises or PROMISES
    counts = lambda rows: rows.groupBy(key).agg(*(F.sum(F.regexp_count(X.text_of(F.col(text)), F.lit(p))).cast("long").alias(n) for n, p in promises.items()))
    stacked = lambda rows, value: counts(rows).select(key, F.inline(F.array(*(F.struct(F.lit(n).alias("promise"), F.col(n).alias(value)) for n in promises))))
    both = stacked(sources, "expected").join(stacked(package, "found"), [key, "promise"], "left").fillna(0, ["found"])
    status = F.when(F.col("found") == F.col("expected"), "ok").when(F.col("found") < F.col("expected"), "missing").otherwise("more")
    return both.where("expected > 0 or found > 0").withColumn("status", status)


def lines_greedy(a: DataFrame, b: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Each line in turn with the unused line most like it, however little: (key, a_idx, b_idx, score, label)."""
    side = lambda d: G.exploded(d, F.filter(X.lines(F.col(text)), lambda x: F.trim(x) != ""), key)
    return M.aligned_in_order(side(a), side(b), key, least=0.0)
