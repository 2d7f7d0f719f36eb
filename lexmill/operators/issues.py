"""Rule engines over documents, and the pipeline that scores, thins and orders what they find.

Rules, penalties and topics are data: tables of a few rows that a caller gives. An issue is a
row with rule, category, severity, source, original_text, suggestion, confidence and chapter.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import text as X


@dataclass(frozen=True)
class Rule:
    rule: str
    pattern: str
    category: str = "style"
    severity: str = "general"
    source: str = "rule"
    suggestion: str = ""
    confidence: int = 90
    language: str | None = None


def detect(docs: DataFrame, rules: Sequence[Rule], keep: Sequence[str] = ("doc_id",), text: str = "text", language: str | None = None) -> DataFrame:
    """An issue for each match of each rule, numbered in order within document and rule.

    Every rule is tried in one pass over the text; documents without a match give no row.
    """
    t = X.text_of(F.col(text))

    def found(r: Rule) -> Column:
        hits = F.regexp_extract_all(t, F.lit(r.pattern), 0)
        if r.language and language:
            hits = F.when(F.col(language) == r.language, hits).otherwise(F.array().cast("array<string>"))
        return F.struct(
            *(F.lit(v).alias(n) for n, v in (("rule", r.rule), ("category", r.category), ("severity", r.severity), ("source", r.source), ("suggestion", r.suggestion), ("confidence", r.confidence))), hits.alias("hits")
        )

    per_rule = docs.select(*keep, F.inline(F.array(*map(found, rules)))).where(F.size("hits") > 0)
    return per_rule.select(*keep, "rule", "category", "severity", "source", "suggestion", "confidence", F.posexplode("hits").alias("nth", "original_text"))


def detect_spans(docs: DataFrame, rules: Sequence[Rule], text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, rule, start, end (code points) and text of every match, in the regex library's dialect."""
    names = [r.rule for r in rules]

    @F.pandas_udf("array<struct<rule:string,start:int,end:int,original_text:string>>")
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        compiled = [regex.compile(r.pattern) for r in rules]
        for texts in batches:
            yield pd.Series([[{"rule": n, "start": m.start(), "end": m.end(), "original_text": m[0]} for n, p in zip(names, compiled, strict=True) for m in p.finditer(t or "") if m[0]] for t in texts])

    return docs.select(doc_id, F.inline(spans(F.col(text)))).dropDuplicates([doc_id, "rule", "start", "end"])


def replaced_terms(docs: DataFrame, terms: dict[str, str], text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Occurrences of each wrong term as a whole word whose right form the document lacks."""
    t = X.text_of(F.col(text))
    words = F.regexp_extract_all(t, F.lit(X.TOKEN), 0)
    found = [F.struct(F.lit(bad).alias("term"), F.lit(good).alias("standard"), F.when(F.contains(t, F.lit(good)), 0).otherwise(F.size(F.filter(words, _is(bad)))).alias("n")) for bad, good in sorted(terms.items())]
    return docs.select(*keep, F.inline(F.array(*found))).where("n > 0")


def missing_references(docs: DataFrame, cited: str, defined: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Numbers that a document cites (first group of ``cited``) without defining them."""
    numbers = lambda p: F.array_distinct(F.regexp_extract_all(X.text_of(F.col(text)), F.lit(p), 1))
    return docs.select(doc_id, F.explode(F.array_except(numbers(cited), numbers(defined))).alias("number"))


def mixed_forms(docs: DataFrame, forms: dict[str, str], keep: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """Documents with two or more of the forms, and how many matches of each."""
    out = docs.select(*keep, *(F.regexp_count(X.text_of(F.col(text)), F.lit(p)).cast("long").alias(n) for n, p in forms.items()))
    kinds = sum((F.col(n) > 0).cast("int") for n in forms)
    return out.withColumn("kinds", kinds).where("kinds >= 2")


@dataclass(frozen=True)
class Scoring:
    """Points of the value score, and which rules and texts it favours."""

    # The points.
    base: int = 50
    severity: dict[str, int] = field(default_factory=lambda: {"fatal": 25, "serious": 18, "general": 6, "suggestion": -8})
    source: dict[str, int] = field(default_factory=lambda: {"rule": 8, "term": 6, "ai": -2, "spellcheck": 0})
    high_value: str = r"password|credential|missing|empty"
    low_value: str = r"[^\s\S]"
    low_rules: tuple[str, ...] = ()
    high_bonus: int = 30
    low_penalty: int = 55
    low_rule_penalty: int = 45
    incomplete_penalty: int = 20


def _points(column: str, points: dict[str, int]) -> Column:
    out = F.lit(0)
    for name, p in points.items():
        out = F.when(F.col(column) == name, p).otherwise(out)
    return out


def blob() -> Column:
    return F.concat_ws(" ", "rule", "category", "original_text", "suggestion")


def value_score(s: Scoring) -> Column:
    """0 to 100: severity, source, confidence, and what the finding is about."""
    c = F.col("confidence")
    score = F.lit(s.base) + _points("severity", s.severity) + _points("source", s.source)
    score = score + F.when(c >= 95, 10).when(c >= 90, 6).when((c > 0) & (c < 80), -12).otherwise(0)
    score = score + F.when(blob().rlike(f"(?i){s.high_value}"), s.high_bonus).otherwise(0)
    score = score - F.when(blob().rlike(f"(?i){s.low_value}"), s.low_penalty).otherwise(0)
    score = score - F.when(F.col("rule").isin(*s.low_rules), s.low_rule_penalty).otherwise(0) if s.low_rules else score
    score = score - F.when((F.col("original_text") == "") | (F.col("suggestion") == ""), s.incomplete_penalty).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), score))


# Ranks of severities and sources.
SEVERITY_RANK = {"fatal": 4, "serious": 3, "general": 2, "suggestion": 1}
SOURCE_RANK = {"rule": 4, "term": 3, "grammar": 2, "ai": 1, "spellcheck": 0}


def is_noise() -> Column:
    """Short findings of minor severity that are punctuation only."""
    return F.col("severity").isin("general", "suggestion") & (F.length(X.collapsed(F.col("original_text"))) <= 3) & X.collapsed(F.col("original_text")).rlike(r"^[^\p{L}\p{N}]+$")


def topic_of(topics: dict[str, str]) -> Column:
    """The first topic whose pattern the finding matches, or an empty text."""
    out = F.lit("")
    for name, pattern in reversed(list(topics.items())):
        out = F.when(blob().rlike(f"(?i){pattern}"), name).otherwise(out)
    return out


def dedupe_key() -> Column:
    """Findings of one topic by the text's start; spelling by rule and text; others by rule, text and chapter."""
    text = X.compact(F.col("original_text"))
    return (
        F.when(F.col("topic") != "", F.concat_ws("|", F.lit("topic"), "topic", F.left(text, F.lit(80))))
        .when(F.col("source") == "spellcheck", F.concat_ws("|", F.lit("spell"), "rule", text))
        .otherwise(F.concat_ws("|", "rule", text, X.compact(F.col("chapter"))))
    )


def select_issues(issues: DataFrame, scoring: Scoring, topics: dict[str, str], shadowed: Sequence[str] = (), least: int = 45, least_serious: int = 38, key: str = "doc_id", order: str = "nth") -> DataFrame:
    """Findings worth showing: noise and low scores go, the best of each key stays, model findings
    whose topic or text a deterministic one covers go."""
    rows = issues.where(F.coalesce(F.trim("original_text"), F.lit("")) != "").where(~is_noise())
    rows = rows.withColumn("score", value_score(scoring)).withColumn("topic", topic_of(topics))
    rows = rows.where(F.col("score") >= F.when(F.col("severity").isin("fatal", "serious"), least_serious).otherwise(least))
    rows = best_per_key(rows.withColumn("dedupe_key", dedupe_key()), key, order)
    return suppress_shadowed(rows, key, shadowed)


def best_per_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The finding of highest score, severity, source and confidence of each key; the first of equals."""
    rank = Window.partitionBy(key, "dedupe_key").orderBy(F.desc("score"), F.desc(_points("severity", SEVERITY_RANK)), F.desc(_points("source", SOURCE_RANK)), F.desc("confidence"), order, "rule")
    return rows.withColumn("_n", F.row_number().over(rank)).where("_n = 1").drop("_n")


def suppress_shadowed(rows: DataFrame, key: str, shadowed: Sequence[str]) -> DataFrame:
    """Without model findings covered by a deterministic one of the same document: two windows, no join."""
    sure = F.col("source") != "ai"
    text = X.compact(F.col("original_text"))
    by_topic = F.max(F.when(sure, True)).over(Window.partitionBy(key, "topic"))
    by_text = F.max(F.when(sure, True)).over(Window.partitionBy(key, "topic", text))
    hidden = ~sure & (F.col("topic") != "") & ((F.col("topic").isin(*shadowed) & by_topic) if shadowed else F.lit(False)) | (~sure & (F.col("topic") != "") & F.coalesce(by_text, F.lit(False)))
    return rows.withColumn("_hidden", F.coalesce(hidden, F.lit(False))).where("NOT _hidden").drop("_hidden")


def ordered(rows: DataFrame, order: str = "nth") -> DataFrame:
    """Fatal, then serious, then the rest; by score, severity and position."""
    group = F.when(F.col("severity") == "fatal", 0).when(F.col("severity") == "serious", 1).otherwise(2)
    return rows.orderBy(group, F.desc("score"), F.desc(_points("severity", SEVERITY_RANK)), order, "doc_id", "rule")


def layers(rows: DataFrame, rules: dict[str, str], default: str = "content") -> DataFrame:
    """Number of findings in each layer, the first whose pattern the rule's category matches."""
    layer = F.lit(default)
    for name, pattern in reversed(list(rules.items())):
        layer = F.when(F.col("category").rlike(pattern), name).otherwise(layer)
    return rows.groupBy(layer.alias("layer")).agg(F.count("*").alias("n"))


def _is(word: str):
    return lambda w: w == word


def normalized_candidates(candidates: DataFrame, key: str, order: str, least: int = 70, content: Column | None = None) -> DataFrame:
    """Model findings worth keeping: confident, with text that the content has, each text once.

    candidates (key, order, original_text, confidence, content); confidence is cut to 0..100. A caller
    that has made ``X.compact`` of a content once for its many findings gives it as ``content`` instead.
    """
    content = X.compact(F.col("content")) if content is None else content
    c = F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce("confidence", F.lit(0))))
    rows = candidates.withColumn("confidence", c).where((F.col("confidence") >= least) & (F.trim("original_text") != "") & F.contains(content, X.compact(F.col("original_text"))))
    first = F.row_number().over(Window.partitionBy(key, X.compact(F.col("original_text"))).orderBy(order))
    return rows.withColumn("_n", first).where("_n = 1").drop("_n")


def reason_counts(rows: DataFrame, reason: str = "reason") -> DataFrame:
    return rows.groupBy(reason).agg(F.count("*").alias("n"))
