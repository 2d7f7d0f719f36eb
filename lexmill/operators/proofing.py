"""Spelling, grammar and style of texts; ordered rewriting rules; protected words."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import text as X
from lexmill.operators.spread import cut


def nfkc(c: Column) -> Column:
    """Compatibility composition of a text."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))

    return run(c)


# Full-width punctuation and what replaces it.
WIDE, NARROW = "，。！？；：（）【】“”‘’、", ",.!?;:()[]\"\"'',"


def aggressive(c: Column) -> Column:
    """Plain punctuation, no spaces, lower case, no punctuation at the end: a key for loose equality."""
    return F.regexp_replace(F.lower(F.regexp_replace(F.translate(X.text_of(c), WIDE, NARROW), r"\s+", "")), r"[.,!?;:]+$", "")


def clauses(c: Column, least: int = 2) -> Column:
    """Parts between punctuation marks, trimmed."""
    parts = F.transform(F.split(X.text_of(c), r"[,.;:!?\n，。；：！？、]+"), lambda p: F.trim(p))
    return F.filter(parts, lambda p: F.length(p) >= least)


#: Words of a list that is broadcast at most.
LISTED = 1 << 20


def unknown_words(docs: DataFrame, dictionary: DataFrame, whitelist: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 3, most: int | None = None) -> DataFrame:
    """(doc_id, word, n) of words that neither the dictionary (word, any case) nor the whitelist (word, exact) has.

    Known words go before occurrences are counted where the lists are broadcast, which they are up to
    ``LISTED`` words; else counts are written first (Spark would move the joins below them), and a word is looked up once for a document. Counts are reported
    up to ``most`` if that is given.
    """
    words = docs.select(doc_id, F.explode(F.regexp_extract_all(X.text_of(F.col(text)), F.lit(r"\p{L}+"), 0)).alias("word")).where(F.length("word") >= least)
    known = cut(dictionary.select(F.lower("word").alias("_known")).where("_known is not null").distinct(), "dictionary")
    fine = cut(whitelist.select(F.col("word").alias("_fine")).where("_fine is not null").distinct(), "whitelist")
    counted = lambda rows: rows.groupBy(doc_id, "word").agg(F.count("*").alias("n"))
    unknown = lambda rows, of: rows.join(of(known), F.lower("word") == F.col("_known"), "left_anti").join(of(fine), F.col("word") == F.col("_fine"), "left_anti")
    left = counted(unknown(words, F.broadcast)) if max(known.count(), fine.count()) <= LISTED else unknown(cut(counted(words), "word-counts"), lambda rows: rows)
    return left.withColumn("n", F.least("n", F.lit(most))) if most else left


def corrections(unknown: DataFrame, dictionary: DataFrame, most: int = 3, distance: int = 2) -> DataFrame:
    """(word, suggestion, distance, rank): dictionary words within a few edits of each distinct word, with its first letter.

    Two words so near become equal when at most ``distance`` letters are left out of each, so they
    meet on these shortened forms; words that are merely of like length never do.
    """
    words = unknown.select(F.lower("word").alias("w")).distinct()
    known = dictionary.select(F.lower("word").alias("suggestion")).distinct()
    met = words.select("w", F.explode(shortened(F.col("w"), distance)).alias("form")).join(known.select("suggestion", F.explode(shortened(F.col("suggestion"), distance)).alias("form")), "form")
    near = met.select("w", "suggestion").distinct().withColumn("distance", F.levenshtein("w", "suggestion", distance)).where("distance >= 0")
    rank = F.row_number().over(Window.partitionBy("w").orderBy("distance", "suggestion"))
    return near.withColumn("rank", rank).where(F.col("rank") <= most).select(F.col("w").alias("word"), "suggestion", "distance", "rank")


def shortened(c: Column, most: int) -> Column:
    """A word without up to ``most`` of its letters after the first, each form once."""
    one_less = lambda w: F.when(F.length(w) < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(2), F.greatest(F.length(w), F.lit(2))), lambda i: F.concat(F.left(w, i - 1), F.substring(w, i + 1, F.length(w)))))
    forms = F.array(c)
    for _ in range(most):
        forms = F.array_distinct(F.concat(forms, F.flatten(F.transform(forms, one_less))))
    return forms


AN = r"(?i)\ban\s+(?:[bcdfgjklmnpqrstvwxyz]|uni|use|eu)\w*"
A = r"(?i)\ba\s+(?:[aeio]|un[^i]|hour|honest)\w*"


def wrong_articles(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, phrase): an before a consonant's sound, a before a vowel's."""
    found = F.concat(F.regexp_extract_all(X.text_of(F.col(text)), F.lit(AN), 0), F.regexp_extract_all(X.text_of(F.col(text)), F.lit(A), 0))
    return docs.select(doc_id, F.explode(found).alias("phrase"))


@dataclass(frozen=True)
class Rewrite:
    rule_id: int
    pattern: str
    replacement: str | None
    priority: int = 0


def rewritten(docs: DataFrame, rules: Sequence[Rewrite], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, applied): rules by falling priority, then id, each on what the one before left.

    A pattern that does not compile is taken literally; a rule without a replacement only reports.
    """
    ordered = sorted(rules, key=lambda r: (-r.priority, r.rule_id))

    @F.pandas_udf("text string, applied array<struct<rule_id:long,n:long>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        compiled = []
        for r in ordered:
            try:
                compiled.append((r, regex.compile(r.pattern)))
            except regex.error:
                compiled.append((r, regex.compile(regex.escape(r.pattern))))
        for texts in batches:
            out = []
            for t in texts:
                t, applied = t or "", []
                for r, p in compiled:
                    if r.replacement is None:
                        n = len(p.findall(t))
                    else:
                        t, n = p.subn(r.replacement, t)
                    if n:
                        applied.append({"rule_id": r.rule_id, "n": n})
                out.append((t, applied))
            yield pd.DataFrame(out, columns=["text", "applied"])

    return docs.select(doc_id, run(F.col(text)).alias("r")).select(doc_id, "r.*")


def spaced_units(c: Column, units: Sequence[str] = ("mm", "cm", "kg", "mL", "GB", "MB")) -> Column:
    """A space between a number and its unit."""
    return F.regexp_replace(X.text_of(c), rf"(\d)({'|'.join(map(re.escape, units))})\b", "$1 $2")


def spaced_scripts(c: Column) -> Column:
    """A space between CJK characters and Latin letters or digits."""
    out = F.regexp_replace(X.text_of(c), r"([\x{4E00}-\x{9FFF}])([A-Za-z0-9])", "$1 $2")
    return F.regexp_replace(out, r"([A-Za-z0-9])([\x{4E00}-\x{9FFF}])", "$1 $2")


def lost_words(a: Column, b: Column, pattern: str = r"\b[A-Z][A-Za-z0-9-]{2,}\b") -> Column:
    """Protected words (names, models) of a text that its rewriting lacks."""
    found = lambda c: F.array_distinct(F.regexp_extract_all(X.text_of(c), F.lit(pattern), 0))
    return F.array_sort(F.array_except(found(a), found(b)))


def first_match(c: Column, names: dict[str, str], default: str) -> Column:
    """The first name whose pattern a text holds: ordered classification of annotations and fingerprints."""
    out = F.lit(default)
    for name, pattern in reversed(list(names.items())):
        out = F.when(X.text_of(c).rlike(pattern), name).otherwise(out)
    return out


def spell_response(found: Sequence[DataFrame], key: str = "doc_id") -> DataFrame:
    """Findings of several engines (key, start, end, type, message) as one list: each span and type once, by position."""
    from functools import reduce

    rows = reduce(DataFrame.unionByName, [d.select(key, "start", "end", "type", "message", F.lit(k).alias("_e")) for k, d in enumerate(found)])
    first = F.row_number().over(Window.partitionBy(key, "start", "end", "type").orderBy("_e", "message"))
    return rows.withColumn("_n", first).where("_n = 1").drop("_n", "_e").orderBy(key, "start", "end", "type")
