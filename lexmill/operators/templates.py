"""Sentences against sentence templates: intents, structured scores, penalties, tiers and keep rules.

An intent is read with word lists that the caller gives: conditions (clauses after a word such as
"when"), action-object pairs, marked labels, numbers. Scores are expressions over these arrays.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import text as X
from lexmill.operators import matching as M
from lexmill.operators.spread import cut


@dataclass(frozen=True)
class Grammar:
    actions: tuple[str, ...] = ("click", "select", "open", "close", "press", "enter", "add", "remove", "check", "start", "stop")
    conditions: tuple[str, ...] = ("when", "if", "before", "after", "while", "until")
    articles: tuple[str, ...] = ("the", "a", "an")
    label: str = r"[\"<\[]([^\"<>\[\]]+)[\">\]]"
    generic: tuple[str, ...] = ("button", "icon", "window", "page")


@dataclass(frozen=True)
class Weights:
    # Weights of the structured and of the whole score.
    pair: float = 0.28
    condition: float = 0.18
    action: float = 0.14
    object: float = 0.10
    sequence: float = 0.15
    label: float = 0.15
    structured: float = 0.45
    edit: float = 0.15
    anchor: float = 0.20
    number: float = 0.15
    context: float = 0.05
    most_penalty: float = 0.35
    tiers: tuple[tuple[float, str], ...] = field(default=((0.70, "fuzzy"), (0.34, "reference")))


def intent(c: Column, g: Grammar) -> Column:
    """conditions, actions, objects, pairs, labels and numbers of a sentence as arrays."""
    t = F.lower(X.collapsed(c))
    verbs, articles = "|".join(g.actions), "|".join(g.articles)
    pair = rf"\b({verbs})\s+(?:(?:{articles})\s+)?(\w+)"
    return F.struct(
        F.transform(F.regexp_extract_all(t, F.lit(rf"\b(?:{'|'.join(g.conditions)})\s+([^,.;]+)"), 1), lambda x: F.trim(x)).alias("conditions"),
        F.regexp_extract_all(t, F.lit(rf"\b({verbs})\b"), 1).alias("actions"),
        F.regexp_extract_all(t, F.lit(pair), 2).alias("objects"),
        F.regexp_replace(F.array_join(F.regexp_extract_all(t, F.lit(pair), 0), "\n"), rf"\b(?:{articles})\s+", "").alias("pair_lines"),
        F.array_distinct(F.regexp_extract_all(t, F.lit(g.label), 1)).alias("labels"),
        F.array_distinct(F.regexp_extract_all(t, F.lit(r"\d+(?:\.\d+)?"), 0)).alias("numbers"),
    )


def marker_overlap(a: Column, b: Column) -> Column:
    """Common members over the larger set; 0 where both are empty."""
    return X.overlap(F.array_distinct(a), F.array_distinct(b))


def best_overlap(a: Column, b: Column) -> Column:
    """Mean over a of its best partner in b: equal 1, one within the other .92, else word overlap."""

    def like(x: Column, y: Column) -> Column:
        return F.when(x == y, 1.0).when(F.contains(x, y) | F.contains(y, x), 0.92).otherwise(X.overlap(F.array_distinct(F.split(x, " ")), F.array_distinct(F.split(y, " "))))

    best = F.transform(a, lambda x: F.coalesce(F.array_max(F.transform(b, lambda y: like(x, y))), F.lit(0.0)))
    return F.when(F.size(a) == 0, 0.0).otherwise(F.aggregate(best, F.lit(0.0), lambda s, v: s + v) / F.greatest(F.size(a), F.lit(1)))


def in_order(a: Column, b: Column) -> Column:
    """Members of a found in b in order, each after the one before, over the longer length."""
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"))

    def step(acc: Column, x: Column) -> Column:
        rest = F.slice(b, acc["at"] + 1, F.greatest(F.size(b) - acc["at"], F.lit(0)))
        k = F.array_position(rest, x).cast("int")
        return F.when(k > 0, F.struct((acc["at"] + k).alias("at"), (acc["n"] + 1).alias("n"))).otherwise(acc)

    longer = F.greatest(F.size(a), F.size(b))
    return F.when(longer == 0, 0.0).otherwise(F.aggregate(a, zero, step)["n"] / longer)


def structured(a: Column, b: Column, w: Weights, g: Grammar) -> Column:
    """Weighted sum of the intents' likeness; 0 without conditions, actions and objects on the source side."""
    lines = lambda i: F.filter(F.split(i["pair_lines"], "\n"), lambda x: x != "")
    return X.bound(F.struct(lines(a).alias("a"), lines(b).alias("b")), lambda x: _structured(a, b, x["a"], x["b"], w, g))


def _structured(a: Column, b: Column, a_lines: Column, b_lines: Column, w: Weights, g: Grammar) -> Column:
    labels = marker_overlap(a["labels"], b["labels"])
    generic = F.arrays_overlap(F.concat(a["objects"], b["objects"]), F.array(*map(F.lit, g.generic))) & (labels <= 0)
    pair, obj = best_overlap(a_lines, b_lines), best_overlap(a["objects"], b["objects"])
    total = (
        w.pair * F.when(generic, F.least(pair, F.lit(0.45))).otherwise(pair)
        + w.condition * best_overlap(a["conditions"], b["conditions"])
        + w.action * marker_overlap(a["actions"], b["actions"])
        + w.object * F.when(generic, F.least(obj, F.lit(0.35))).otherwise(obj)
        + w.sequence * in_order(a_lines, b_lines)
        + w.label * labels
    )
    return F.when(F.size(a["conditions"]) + F.size(a["actions"]) + F.size(a["objects"]) == 0, 0.0).otherwise(total)


def penalties(a: Column, b: Column) -> Column:
    """reason and size of each conflict: numbers that differ, actions that differ, labels that are missing."""
    union = F.size(F.array_union(a["numbers"], b["numbers"]))
    share = F.when(union <= 1, 0.4).when(union <= 3, 0.7).otherwise(1.0)
    numbers = F.when((union > 0) & (F.size(F.array_intersect(a["numbers"], b["numbers"])) == 0), share * 0.2)
    actions = F.when((F.size(a["actions"]) > 0) & (F.size(b["actions"]) > 0) & (F.size(F.array_intersect(a["actions"], b["actions"])) == 0), 0.15)
    labels = F.when((F.size(a["labels"]) > 0) & (F.size(F.array_intersect(a["labels"], b["labels"])) == 0), 0.1)
    all_ = F.array(*(F.struct(F.lit(n).alias("reason"), p.cast("double").alias("size")) for n, p in (("numbers", numbers), ("actions", actions), ("labels", labels))))
    return F.filter(all_, lambda p: p["size"].isNotNull())


def candidates(sentences: DataFrame, templates: DataFrame, g: Grammar = Grammar(), w: Weights = Weights(), least_length: float = 0.45, least_jaccard: float = 0.2) -> DataFrame:
    """(sentence_id, template_id, score, penalty, tier): the best pairs of sentences (idx, text) and templates (idx, text).

    Candidates share rare n-grams and are of like length; fragments of the other text and texts
    equal up to case and spaces are tier exact. A sentence keeps its best row of each template.
    """
    one = lambda d: d.select(F.lit(0).alias("b"), "idx", "text")
    pairs = M.candidates(one(sentences), one(templates), "b", least_length=least_length, least_jaccard=least_jaccard)
    anchors = X.overlap(F.array_distinct(X.tokens(F.col("a_text"))), F.array_distinct(X.tokens(F.col("b_text"))))

    def compared(i: Column, j: Column) -> Column:
        number = F.when(F.size(i["numbers"]) + F.size(j["numbers"]) == 0, 1.0).otherwise(marker_overlap(i["numbers"], j["numbers"]))
        return F.struct(penalties(i, j).alias("p"), structured(i, j, w, g).alias("structured"), number.alias("number"), best_overlap(i["conditions"], j["conditions"]).alias("context"))

    # an intent is read once for a pair, and scores are written once: filters on them would repeat all of their expressions
    both = X.bound(F.struct(intent(F.col("a_text"), g).alias("i"), intent(F.col("b_text"), g).alias("j")), lambda s: compared(s["i"], s["j"]))
    same = X.compact(F.col("a_text")) == X.compact(F.col("b_text"))
    rows = cut(pairs.select("a_idx", "b_idx", same.alias("same"), M.ratio("a_text", "b_text").alias("edit"), anchors.alias("anchors"), both.alias("s")).select("a_idx", "b_idx", "same", "edit", "anchors", "s.*"), "template-pairs")
    raw = w.structured * F.col("structured") + w.edit * F.col("edit") + w.anchor * F.col("anchors") + w.number * F.col("number") + w.context * F.col("context")
    penalty = F.least(F.aggregate("p", F.lit(0.0), lambda s, x: s + x["size"]), F.lit(w.most_penalty))
    same = F.col("same")
    rows = rows.withColumn("penalty", penalty).withColumn("score", F.when(same, 1.0).otherwise(F.round(F.greatest(F.lit(0.0), raw - F.col("penalty")), 4)))
    tier = F.when(same, "exact")
    for least, name in w.tiers:
        tier = tier.when(F.greatest("score", "edit") >= least, name)
    rows = rows.withColumn("tier", tier).where("tier is not null")
    return rows.select(F.col("a_idx").alias("sentence_id"), F.col("b_idx").alias("template_id"), "score", "edit", "penalty", F.transform("p", lambda x: x["reason"]).alias("reasons"), "tier")


# How a template was found, and the score of the first two ways.
LEVELS = (("L1", 1.0), ("L1.5", 0.95), ("L2", None), ("L3", None), ("NONE", None))


def levels(sentences: DataFrame, templates: DataFrame, scored: DataFrame, synonyms: dict[str, str], least: float = 0.75, hint: float = 0.5) -> DataFrame:
    """(idx, template_id, score, level) of each sentence: equal letters and digits, equal after synonyms, or its best score.

    sentences and templates (idx, text); scored (a_idx, b_idx, score) are candidates with scores, from
    ``least`` L2 and from ``hint`` L3. Of equal templates the first counts.
    """

    def same(c: Column) -> Column:
        out = F.lower(X.collapsed(c))
        for word, standard in sorted(synonyms.items()):
            out = F.regexp_replace(out, rf"(^|[^\p{{L}}\p{{N}}]){word}([^\p{{L}}\p{{N}}]|$)", f"$1{standard}$2")
        return X.letters_digits(out)

    plain = lambda c: X.letters_digits(c)
    rows = sentences.select("idx", plain(F.col("text")).alias("k1"), same(F.col("text")).alias("k2"))
    first = lambda key, name, found: templates.select(key(F.col("text")).alias(name), F.col("idx").alias("t")).where(F.col(name) != "").groupBy(name).agg(F.min("t").alias(found))
    rows = rows.join(first(plain, "k1", "t1"), "k1", "left").join(first(same, "k2", "t2"), "k2", "left")
    best = scored.groupBy("a_idx").agg(F.max(F.struct("score", (-F.col("b_idx")).alias("first"))).alias("best"))
    rows = rows.join(best.withColumnRenamed("a_idx", "idx"), "idx", "left")
    score = F.when(F.col("t1").isNotNull(), LEVELS[0][1]).when(F.col("t2").isNotNull(), LEVELS[1][1]).otherwise(F.coalesce("best.score", F.lit(0.0)))
    level = F.when(F.col("t1").isNotNull(), "L1").when(F.col("t2").isNotNull(), "L1.5").when(F.col("best.score") >= least, "L2").when(F.col("best.score") >= hint, "L3").otherwise("NONE")
    return rows.select("idx", F.coalesce("t1", "t2", -F.col("best.first")).alias("template_id"), score.alias("score"), level.alias("level"))


def kept(rows: DataFrame, pending: float = 0.50, show: float = 0.65, severe: float = 0.18, k: int | None = None) -> DataFrame:
    """Candidates to show: exact ones go (nothing to change), low ones go, the rest by score, flagged below ``show``.

    All that are left stay, with their rank in their sentence, or its best ``k`` if a caller asks for them.
    """
    value = F.greatest("score", "edit")
    rows = rows.withColumn("value", value).where((F.col("tier") != "exact") & (F.col("value") >= pending))
    rows = rows.where(~((F.col("value") < pending + 0.04) & (F.col("penalty") >= severe)))
    rank = F.row_number().over(Window.partitionBy("sentence_id").orderBy(F.desc("value"), "template_id"))
    rows = rows.withColumns({"rank": rank, "needs_review": F.col("value") < show})
    return rows if k is None else rows.where(F.col("rank") <= k)


def bins(rows: DataFrame, key: str, order: str, size: str, most_items: int = 80, most_size: int = 8000) -> DataFrame:
    """Rows with the number of their bin: in order, a bin closes when the next row would pass a limit.

    A row larger than a bin has one of its own. Bins are of one key, whose rows meet in one task.
    """
    import pandas as pd

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order)
        number, items, used, out = 0, 0, 0, []
        for n in group[size]:
            if items and (items == most_items or used + n > most_size):
                number, items, used = number + 1, 0, 0
            items, used = items + 1, used + n
            out.append(number)
        return group.assign(bin=out)

    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + ", bin long"
    return rows.groupBy(key).applyInPandas(fill, schema)


def guide_templates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 15) -> DataFrame:
    """(doc_id, ord, chapter, text) of a guide's bullets, numbered items and table cells long enough to be templates."""
    rows = docs.select(doc_id, F.posexplode(X.lines(F.col(text))).alias("ord", "line"))
    w = Window.partitionBy(doc_id).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    heading = F.when(F.col("line").rlike(r"^#{1,6}\s"), F.trim(F.regexp_replace("line", r"^#+\s*", "")))
    rows = rows.withColumn("chapter", F.last(heading, ignorenulls=True).over(w))
    cells = F.when(F.col("line").rlike(r"^\s*\|"), F.split("line", r"\|")).when(F.col("line").rlike(r"^\s*(?:[-*+]|\d+[.)])\s"), F.array(F.regexp_replace("line", r"^\s*(?:[-*+]|\d+[.)])\s+", ""))).otherwise(F.array().cast("array<string>"))
    out = rows.select(doc_id, "ord", "chapter", F.explode(F.transform(cells, lambda c: F.trim(c))).alias("text"))
    return out.where((F.length("text") >= least) & F.col("text").rlike(r"[.!?。]$"))


def image_lines(words: DataFrame, page: str = "page", gap: float = 0.6) -> DataFrame:
    """(page, line, text) of words with their boxes (page, x, y, height, word): rows that start a gap lower open a line."""
    w = Window.partitionBy(page).orderBy("y", "x")
    new = F.coalesce((F.col("y") - F.lag("y").over(w) > gap * F.col("height")).cast("int"), F.lit(1))
    rows = words.withColumn("_new", new).withColumn("line", F.sum("_new").over(w))
    parts = F.array_sort(F.collect_list(F.struct("x", "word")))
    return rows.groupBy(page, "line").agg(F.array_join(F.transform(parts, lambda p: p["word"]), " ").alias("text"))
