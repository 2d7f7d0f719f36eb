"""Rules that look at more than one place: mixed forms, agreement, split words, lines, protected words.

Word lists, forms and patterns are arguments; the defaults are small sets of English function words.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import text as X


def mixed_terms(docs: DataFrame, groups: dict[str, Sequence[str]], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, name, form, n): each form of a term in documents that use two or more of its forms (patterns)."""
    t = X.text_of(F.col(text))
    rows = [F.struct(F.lit(name).alias("name"), F.array(*(F.struct(F.lit(f).alias("form"), F.regexp_count(t, F.lit(f)).cast("long").alias("n")) for f in forms)).alias("forms")) for name, forms in groups.items()]
    found = docs.select(doc_id, F.inline(F.array(*rows))).withColumn("forms", F.filter("forms", lambda f: f["n"] > 0))
    return found.where(F.size("forms") >= 2).select(doc_id, "name", F.inline("forms"))


NUMBERING = {"dot": r"\b\d+\.(?:\s|$)", "bracket": r"\b\d+\)", "brackets": r"\(\d+\)"}


def mixed_numbering(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", styles: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, line_number, style, n): each numbering style of lines that use two or more."""
    lines = docs.select(doc_id, F.posexplode(X.lines(F.col(text))).alias("line_number", "line"))
    found = F.filter(F.array(*(F.struct(F.lit(s).alias("style"), F.regexp_count("line", F.lit(p)).cast("long").alias("n")) for s, p in (styles or NUMBERING).items())), lambda s: s["n"] > 0)
    return lines.select(doc_id, (F.col("line_number") + 1).alias("line_number"), found.alias("styles")).where(F.size("styles") >= 2).select(doc_id, "line_number", F.inline("styles"))


@dataclass(frozen=True)
class Agreement:
    """Which words count as singular or plural, and which are no subjects."""

    singular: tuple[str, ...] = ("he", "she", "it", "this", "that")
    plural: tuple[str, ...] = ("we", "you", "they", "these", "those")
    singular_verbs: tuple[str, ...] = ("is", "was", "has", "does")
    plural_verbs: tuple[str, ...] = ("are", "were", "have")
    auxiliaries: tuple[str, ...] = ("is", "was", "are", "were", "has", "have", "had", "does", "do", "did", "can", "could", "may", "might", "must", "shall", "should", "will", "would")
    no_subjects: tuple[str, ...] = ("the", "a", "an", "and", "or", "of", "to", "in", "on", "at", "not", "there", "which", "who", "what", "also", "only", "some", "any", "no", "more", "many")


def is_singular(word: Column, g: Agreement) -> Column:
    return F.when(word.isin(*g.singular), True).when(word.isin(*g.plural), False).otherwise(~word.endswith("s"))


def disagreements(docs: DataFrame, g: Agreement = Agreement(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, kind, subject, verb): "there" with a verb whose noun is of the other number, a subject with
    such a verb, and he or she with a verb without its ending. All matches are reported."""
    t = F.lower(X.text_of(F.col(text)))
    verbs = "|".join(g.singular_verbs + g.plural_verbs)
    pairs = lambda kind, p, s, v: F.transform(F.arrays_zip(F.regexp_extract_all(t, F.lit(p), s).alias("s"), F.regexp_extract_all(t, F.lit(p), v).alias("v")), lambda x: F.struct(F.lit(kind).alias("kind"), x["s"].alias("subject"), x["v"].alias("verb")))
    skipped = "|".join(g.no_subjects)
    being = "|".join(v for v in g.singular_verbs + g.plural_verbs if v not in ("has", "have", "does"))
    there = pairs("there", rf"(?:^|[^\p{{L}}])there\s+({being})\s+(?:(?:{skipped})\s+)*(\p{{L}}+)", 2, 1)
    subject = pairs("subject", rf"(\p{{L}}+)\s+({verbs})(?:[^\p{{L}}]|$)", 1, 2)
    person = pairs("person", r"(?:^|[^\p{L}])(he|she)\s+(\p{L}+)", 1, 2)
    found = docs.select(doc_id, F.inline(F.concat(there, subject, person)))
    number = is_singular(F.col("subject"), g) != F.col("verb").isin(*g.singular_verbs)
    wrong = F.when(F.col("kind") == "person", ~F.col("verb").isin(*g.auxiliaries, *g.no_subjects) & ~F.col("verb").endswith("s")).otherwise(number & ~F.col("subject").isin(*g.no_subjects))
    return found.where(wrong)


SPLITS = (r"(?:^|[^\p{L}])([A-Za-z]{2,12}) ([a-z]{1,2})(?:[^\p{L}]|$)", r"(?:^|[^\p{L}])([a-z]) ([a-z]{2,12})(?:[^\p{L}]|$)")


def split_words(docs: DataFrame, dictionary: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 4) -> DataFrame:
    """(doc_id, original, joined, n): two parts whose join the dictionary (word, lower case) has, but not both parts."""
    t = X.text_of(F.col(text))
    pairs = F.concat(*(F.transform(F.arrays_zip(F.regexp_extract_all(t, F.lit(p), 1).alias("a"), F.regexp_extract_all(t, F.lit(p), 2).alias("b")), lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"))) for p in SPLITS))
    rows = docs.select(doc_id, F.inline(pairs)).groupBy(doc_id, "a", "b").agg(F.count("*").alias("n"))
    rows = rows.withColumn("joined", F.concat("a", "b")).where(F.length("joined") >= least)
    known = dictionary.select(F.lower("word").alias("word")).distinct()
    rows = rows.join(known.withColumnRenamed("word", "_w"), F.lower("joined") == F.col("_w"), "left_semi")
    for part in ("a", "b"):
        rows = rows.join(known.select(F.col("word").alias(f"_{part}")), F.lower(part) == F.col(f"_{part}"), "left")
    return rows.where("_a is null or _b is null").select(doc_id, F.concat_ws(" ", "a", "b").alias("original"), "joined", "n")


def line_findings(docs: DataFrame, polite: str, verbs: Sequence[str], conditions: Sequence[str], least_words: int = 6, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, line_number, kind, original): at most one polite imperative a line, a condition without its comma, a line without an end mark."""
    lines = docs.select(doc_id, F.posexplode(X.lines(F.col(text))).alias("line_number", "line"))
    line = F.trim("line")
    imperative = F.regexp_extract(line, rf"(?i)\b{polite}\s+(?:{'|'.join(verbs)})\b", 0)
    conditional = F.regexp_extract(line, rf"(?i)^(?:{'|'.join(conditions)})\s[^,，.;]{{10,}}[.;]?$", 0)
    open_end = F.when((F.regexp_count(line, F.lit(r"\S+")) >= least_words) & ~line.rlike(r"[.!?:;。！？：；]$"), line).otherwise("")
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), c.alias("original")) for k, c in (("imperative", imperative), ("conditional", conditional), ("open_end", open_end))))
    return lines.select(doc_id, (F.col("line_number") + 1).alias("line_number"), F.inline(F.filter(kinds, lambda k: k["original"] != "")))


def protected(c: Column, pattern: str) -> Column:
    """(masked, words): a text with its protected words (one group-free pattern) as numbered marks, and these words."""

    def masked(words: Column) -> Column:
        parts = F.split(X.text_of(c), pattern)
        marks = F.transform(words, lambda _, k: F.concat(F.lit("⟦"), k, F.lit("⟧")))
        joined = F.transform(F.arrays_zip(parts.alias("p"), marks.alias("m")), lambda x: F.concat(F.coalesce(x["p"], F.lit("")), F.coalesce(x["m"], F.lit(""))))
        return F.struct(F.array_join(joined, "").alias("masked"), words.alias("words"))

    return X.bound(F.regexp_extract_all(X.text_of(c), F.lit(pattern), 0), masked)


def restored(masked: Column, words: Column) -> Column:
    """A masked text with its words back; null where a mark is missing, double or out of order: the rewriting is to be rejected."""
    marks = F.regexp_extract_all(masked, F.lit(r"⟦(\d+)⟧"), 1)
    parts = F.split(masked, r"⟦\d+⟧")
    joined = F.transform(F.arrays_zip(parts.alias("p"), words.alias("w")), lambda x: F.concat(F.coalesce(x["p"], F.lit("")), F.coalesce(x["w"], F.lit(""))))
    whole = marks == F.transform(words, lambda _, k: k.cast("string"))
    return F.when(whole, F.array_join(joined, ""))


def latest_of_aliases(rows: DataFrame, roots: DataFrame, alias: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The last row of each record that several aliases name; roots (node, root) are the aliases' components."""
    named = rows.join(roots, rows[alias] == roots["node"], "left").withColumn("record", F.coalesce("root", alias))
    best = named.groupBy("record").agg(F.max(F.struct(*order, *(c for c in columns if c not in order))).alias("last"))
    return best.select("record", *(F.col("last")[c].alias(c) for c in columns))


def sentence_windows(docs: DataFrame, openers: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, idx, window): clauses of a text; one that only opens the next (matches ``openers``) is joined to it."""
    parts = F.filter(F.transform(F.split(X.text_of(F.col(text)), r"[,;，；]"), lambda p: F.trim(p)), lambda p: p != "")
    rows = docs.select(doc_id, F.posexplode(parts).alias("idx", "clause")).withColumn("opens", F.col("clause").rlike(openers))
    w = Window.partitionBy(doc_id).orderBy("idx")
    # a run of openers pairs up from its first: every second one is the end of a pair
    run = F.sum((~F.col("opens")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_run", F.coalesce(run, F.lit(0)))
    nth = F.row_number().over(Window.partitionBy(doc_id, "_run").orderBy("idx"))
    rows = rows.withColumns({"_starts": nth % 2 == 1, "next": F.lead("clause").over(w)})
    window = F.when(F.col("opens") & F.col("next").isNotNull(), F.concat_ws(", ", "clause", "next")).otherwise(F.col("clause"))
    return rows.where("_starts").select(doc_id, "idx", window.alias("window"))
