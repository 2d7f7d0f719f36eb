"""Guards and scores of template candidates: which pairs may be shown, how they rank, which are kept.

Labels, anchors and words are arguments; scores of parts are columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import text as X
from lexmill.operators import matching as M
from lexmill.operators import templates as L

# Weights of segments and the least weight that their sum is divided by.
SEGMENTS = {"condition": 0.15, "action": 0.30, "object": 0.30, "result": 0.20, "additional": 0.05}
LEAST_APPLICABLE = 0.5


def letters(c: Column) -> Column:
    return F.regexp_replace(X.text_of(c), r"[^\p{L}\p{N}]+", "")


def valid_template(c: Column, mapping: str = r"\b[A-Z]\d+\s*(?:=|->)\s*\w+", least: int = 15) -> Column:
    """Long enough with an end mark, or a mapping of slots, or a label with an address."""
    t = F.trim(X.text_of(c))
    long = F.length(letters(t)) >= least
    return t.rlike(mapping) | (long & (t.rlike(r"[.!?;。！？；]$") | (t.rlike("[:：]") & t.rlike(r"@[A-Za-z0-9.-]+"))))


def fragment(source: Column, candidate: Column) -> Column:
    """Whether the candidate is too short or too long for the source, or only a part of it or more than it."""
    a, b = letters(source), letters(candidate)
    n = F.length(a)
    ratio = F.length(b) / F.greatest(n, F.lit(1))
    most = F.when(n <= 18, 2.35).when(n <= 26, 1.9).otherwise(1.55)
    part = (ratio < 0.78) & (F.contains(a, b) | F.contains(b, a))
    return (a == "") | (b == "") | (ratio < 0.65) | (ratio > most) | part


def entities_agree(a: Column, b: Column, labels: dict[str, str]) -> Column:
    """Every label (name -> pattern) that a text has, the other has with a value in common."""
    found = lambda c, p: F.array_distinct(F.regexp_extract_all(F.lower(X.text_of(c)), F.lit(p), 0))
    ok = F.lit(True)
    for pattern in labels.values():
        ok = ok & ((F.size(found(a, pattern)) == 0) | F.arrays_overlap(found(a, pattern), found(b, pattern)))
    return ok


#: How unlike the anchors of a group must be to conflict: any on both sides, none in common, under a half, or under three quarters of several.
ANCHOR_RULES = ("any", "none", "half", "most")


def anchors_agree(a: Column, b: Column, groups: dict[str, tuple[str, Sequence[str]]]) -> Column:
    """No group of anchors (name -> rule, patterns) that both texts have conflicts."""
    ok = F.lit(True)
    for rule, patterns in groups.values():
        has = lambda c, ps=patterns: F.filter(F.array(*(F.when(F.lower(X.text_of(c)).rlike(p), F.lit(k)) for k, p in enumerate(ps))), lambda x: x.isNotNull())
        x, y = has(a), has(b)
        both = (F.size(x) > 0) & (F.size(y) > 0)
        sides = (F.size(F.array_except(x, y)) > 0) & (F.size(F.array_except(y, x)) > 0)
        share = X.overlap(x, y)
        clash = {"any": F.lit(True), "none": share == 0, "half": share < 0.5, "most": (share == 0) | ((F.size(x) >= 2) & (F.size(y) >= 2) & (share < 0.75))}[rule]
        ok = ok & ~(both & sides & clash)
    return ok


def segment_total(scores: dict[str, Column], applicable: dict[str, Column]) -> Column:
    """Weighted mean of the segments that apply, over at least half of all weight."""
    total, weight = F.lit(0.0), F.lit(0.0)
    for name, w in SEGMENTS.items():
        on = applicable[name]
        total = total + F.when(on, scores[name] * w).otherwise(0.0)
        weight = weight + F.when(on, w).otherwise(0.0)
    return total / F.greatest(weight, F.lit(LEAST_APPLICABLE))


def filtered_score(semantic: Column, string: Column, negative: Column, terms: Column, term_overlap: Column, model: bool) -> Column:
    """The semantic score, or else the string's, less what a negative reason and few common terms cost."""
    far, near = (0.18, 0.08) if model else (0.12, 0.05)
    out = F.coalesce(semantic, string) - F.when(negative, 0.22).otherwise(0.0)
    out = F.greatest(F.lit(0.0), out) - F.when((terms >= 2) & (term_overlap < 0.35), far).when((terms >= 2) & (term_overlap < 0.60), near).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.0), out), 4)


# From which score a candidate is kept and shown, with and without a model, and the band between.
KEPT = {True: (0.64, 0.76), False: (0.50, 0.65)}
RESCUE, SEVERE = (0.50, 0.54), 0.18


def keep_state(score: Column, penalty: Column, surface: Column, drop: Column, severe: Column, model: bool) -> Column:
    """keep, needs_review or drop: surface rules always stay, named reasons always go, the rescue band only without a cost."""
    pending, show = KEPT[model]
    rescue = F.lit(False) if model else (score >= RESCUE[0]) & (score < RESCUE[1]) & ((penalty >= SEVERE) | severe)
    return F.when(surface, "keep").when(F.coalesce(drop, F.lit("")) != "", "drop").when(rescue | (score < pending), "drop").when(score < show, "needs_review").otherwise("keep")


def manual_fallback(state: Column, string: Column, filtered: Column, keywords: Column, source: Column, template: Column) -> Column:
    """Whether a candidate that would go is offered for a choice by hand: alike enough and not shorter than the source."""
    a, b = F.length(letters(source)), F.length(letters(template))
    return (state != "drop") | ((string >= 0.38) & (filtered >= 0.38) & (keywords >= 0.2) & (a > 0) & (b >= a))


# Weights of the recall score.
RECALL = {"markers": 4, "ui": 3, "model": 3, "numbers": 2, "actions": 2, "pairs": 8, "similarity": 8, "clause": 10, "terms": 4}
LIMITS = {"slots": 32, "filled": 24, "all": 120, "unmarked": 40}


def recall_score(parts: dict[str, Column]) -> Column:
    """Weighted sum of overlaps and similarities; parts that are not given count nothing."""
    return F.round(sum((parts[k] * float(w) for k, w in RECALL.items() if k in parts), F.lit(0.0)), 4)


def recalled(rows: DataFrame, per: str, score: str, order: Sequence[str], slots: Column | None = None) -> DataFrame:
    """The best candidates of each sentence, as many as its kind allows, with their rank.

    A limit is the operator's purpose: a sentence of slots keeps 32 rows, any other 120.
    """
    most = F.lit(LIMITS["all"]) if slots is None else F.when(slots, LIMITS["slots"]).otherwise(LIMITS["all"])
    rank = F.row_number().over(Window.partitionBy(per).orderBy(F.desc(score), *order))
    return rows.withColumn("rank", rank).where(F.col("rank") <= most)


def aligned_clauses(a: Column, b: Column, marks: str = r"[,;，；]") -> Column:
    """Mean over the clauses of a of the best bigram Jaccard with a clause of b."""
    clauses = lambda c: F.filter(F.transform(F.split(X.text_of(c), marks), lambda p: X.compact(p)), lambda p: p != "")
    return M.best_of_each(clauses(a), clauses(b))


def sentence_similarity(a: Column, b: Column, lcs: Column, longest_common: Column, g: L.Grammar = L.Grammar()) -> Column:
    """.3 bigrams + .3 common subsequence + .2 intents in order + .2 words, raised by like clauses and a long common part.

    ``lcs`` and ``longest_common`` (length of the longest common substring) come from ``matching``.
    """
    x, y = X.compact(a), X.compact(b)
    words = X.overlap(F.array_distinct(X.tokens(a)), F.array_distinct(X.tokens(b)))
    order = L.in_order(L.intent(a, g)["actions"], L.intent(b, g)["actions"])
    base = 0.3 * M.ngram_likeness(x, y)["jaccard"] + 0.3 * lcs + 0.2 * order + 0.2 * words

    def raised(p: Column) -> Column:
        base, clause = p["base"], p["clause"]
        out = F.when(clause > 0, F.greatest(base, 0.55 * base + 0.45 * clause, F.when(clause >= 0.9, 0.88).when(clause >= 0.82, 0.84).otherwise(0.0))).otherwise(base)
        part = longest_common / F.greatest(F.least(F.length(x), F.length(y)), F.lit(1))
        return F.least(F.lit(1.0), F.when((out < 0.85) & (part >= 0.75), 0.80 + (part - 0.75) * 0.8).otherwise(out))

    both = X.bound(F.struct(base.alias("base"), aligned_clauses(a, b).alias("clause")), raised)
    return F.round(F.when((x == "") | (y == ""), 0.0).when(x == y, 1.0).otherwise(both), 4)


def conflict_free(pairs: DataFrame, labels: dict[str, str], groups: dict[str, tuple[str, Sequence[str]]], a: str = "a_text", b: str = "b_text") -> DataFrame:
    """Pairs of a sentence and a valid template that is no fragment and whose entities and anchors agree."""
    x, y = F.col(a), F.col(b)
    return pairs.where(valid_template(y) & ~fragment(x, y) & entities_agree(x, y, labels) & anchors_agree(x, y, groups))


def duplicates(a: Column, b: Column) -> Column:
    """Equal up to case, spaces, quotes and marks at the end."""
    key = lambda c: F.regexp_replace(F.translate(F.lower(X.collapsed(c)), "“”‘’", "\"\"''"), r"[.。!！]+$", "")
    return key(a) == key(b)
