"""Findings against gold annotations, effectiveness, and the statistics of sessions and documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import text as X
from lexmill.operators import matching as M
from lexmill.operators.spread import cut
from lexmill.operators.stats import rate


def gold_hits(gold: DataFrame, issues: DataFrame, key: str, context: int = 40) -> DataFrame:
    """Gold rows (key, gold_id, selected, comment, rule) with found: whether any issue of their key matches.

    An issue (key, rule, original_text, blob) matches by rule, or if one text holds the other:
    the selected text or the comment in the blob, the original in the selected text, or the
    start of the selected text in the blob. Both sides meet on the key.
    """
    low = lambda c: X.compact(F.col(c))
    blob = low("i_blob")
    has = lambda whole, part: (F.length(part) >= 2) & F.contains(whole, part)
    match = (
        F.coalesce(F.col("i_rule") == F.col("rule"), F.lit(False))
        | has(blob, low("selected"))
        | has(blob, low("comment"))
        | has(low("selected"), low("i_original"))
        | has(blob, F.left(low("selected"), F.lit(context)))
    )
    found = issues.select(F.col(key).alias("_key"), F.col("rule").alias("i_rule"), F.col("original_text").alias("i_original"), F.col("blob").alias("i_blob"))
    hit = gold.join(found, (F.col(key) == F.col("_key")) & match, "left_semi").select("gold_id", F.lit(True).alias("found"))
    return gold.join(hit, "gold_id", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def gold_assignment(gold: DataFrame, issues: DataFrame, key: str, least: float = 0.5) -> DataFrame:
    """One-to-one pairs of gold texts and issues of each key (key, idx, text) with the greatest total ratio.

    No pair scores more than 1. So gold rows of a text with an equal issue for each of them, and one more for
    each gold row that is not settled this way and is alike enough to take one, lose nothing to any of these:
    they take equal issues at the end. Only the others are compared with all issues.
    """
    side = lambda rows: rows.where(F.col(key).isNotNull() & F.col("idx").isNotNull()).select(key, F.col("idx").cast("long").alias("idx"), X.text_of(F.col("text")).alias("text"))
    gold, issues = cut(side(gold), "gold"), side(issues)
    equal = cut(issues.join(gold.select(key, "text").distinct(), [key, "text"], "left_semi"), "equal-issues")
    # an id of several rows is one node, which other rows of it can take, so these copies do not count
    several = lambda rows: rows.groupBy(key, "idx").agg(F.count("*").alias("_n")).where("_n > 1").select(key, "idx")
    equal = cut(equal.join(several(issues.select(key, "idx").join(equal.select(key, "idx").distinct(), [key, "idx"], "left_semi")), [key, "idx"], "left_anti"), "equal-issues")
    shared = gold.join(several(gold), [key, "idx"], "left_semi").select(key, "text", F.lit(True).alias("_shared")).distinct()
    texts = gold.groupBy(key, "text").agg(F.count("*").alias("_n")).join(equal.groupBy(key, "text").agg(F.count("*").alias("_copies")), [key, "text"], "left").join(shared, [key, "text"], "left")
    texts = cut(texts.fillna(0, ["_copies"]).withColumn("idx", F.monotonically_increasing_id()), "gold-texts")
    like = cut(M.alike(texts, texts, key, least, few="a"), "gold-alike")
    settled = like.where("a_idx = b_idx and score = 1").select(key, F.col("a_idx").alias("idx")).join(texts, [key, "idx"]).where("_copies >= _n and _shared is null")
    while True:
        settled = cut(settled, "settled")
        others = texts.join(settled.select(key, "idx"), [key, "idx"], "left_anti")
        takers = like.join(others.select(key, F.col("idx").alias("a_idx"), "_n"), [key, "a_idx"]).groupBy(key, F.col("b_idx").alias("idx")).agg(F.sum("_n").alias("_takers"))
        fine = settled.join(takers, [key, "idx"], "left").where("_copies >= _n + coalesce(_takers, 0)").drop("_takers")
        if fine.count() == settled.count():
            break
        settled = fine
    rest = gold.join(settled.select(key, "text"), [key, "text"], "left_anti")
    chosen = cut(M.optimal(M.alike(rest, issues, key, least, few="a"), key), "gold-pairs").select(key, "a_idx", "b_idx", "score")
    left = equal.join(chosen.select(key, F.col("b_idx").alias("idx")), [key, "idx"], "left_anti")
    return chosen.unionByName(M.exact_pairs(gold.join(settled.select(key, "text"), [key, "text"], "left_semi"), left, key))


def scores(rows: DataFrame, by: Sequence[str], truth: Column, guess: Column) -> DataFrame:
    """Counts, precision, recall and F1 by group; rates are null where nothing was guessed or true."""
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(truth & guess).alias("tp"), F.count_if(~truth & guess).alias("fp"), F.count_if(truth & ~guess).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return out.withColumns({"hit_precision": rate(tp, tp + fp, empty=None), "hit_recall": rate(tp, tp + fn, empty=None), "f1": rate(2 * tp, 2 * tp + fp + fn, empty=None)})


def summary(rows: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Number of rows by each of several columns at once: grouping, name, n. One pass of grouping sets."""
    found = rows.groupingSets([[g] for g in groups], *groups).agg(F.grouping_id().alias("_id"), F.count("*").alias("n"))
    kind, name = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, g in enumerate(reversed(groups)):
        this = F.col("_id") == (1 << len(groups)) - 1 - (1 << k)
        kind, name = F.when(this, g).otherwise(kind), F.when(this, F.col(g).cast("string")).otherwise(name)
    return found.select(kind.alias("grouping"), name.alias("name"), "n")


def session_dashboard(rows: DataFrame, session: str, category: str, accepted: Column, ts: str, last: int = 20) -> DataFrame:
    """The last sessions: size, acceptance and categories, newest first."""
    out = rows.groupBy(session).agg(F.max(ts).alias("last_at"), F.count("*").alias("n"), F.count_if(accepted).alias("accepted"), F.array_sort(F.collect_set(category)).alias("categories"))
    return out.withColumn("accept_rate", rate(F.col("accepted"), F.col("n"))).orderBy(F.desc("last_at"), session).limit(last)


def document_dashboard(rows: DataFrame, document: str, run: str, score: str, guide: str) -> DataFrame:
    """Each document's latest and mean score, runs and guides, and the change from its run before."""
    from pyspark.sql import Window

    w = Window.partitionBy(document).orderBy(run)
    steps = rows.withColumn("_before", F.lag(score).over(w))
    return steps.groupBy(document).agg(F.count("*").alias("runs"), F.max_by(score, run).alias("latest"), F.round(F.avg(score), 6).alias("mean"), F.round(F.max_by(F.col(score) - F.col("_before"), run), 4).alias("change"), F.array_join(F.array_sort(F.collect_set(guide)), ",").alias("guides"))


def trigger_counts(rules: DataFrame, hits: DataFrame, key: str, ts: str) -> DataFrame:
    """Rules with how often they fired and when last; rules that never did keep 0 and null."""
    found = hits.groupBy(key).agg(F.count("*").alias("triggers"), F.max(ts).alias("last_triggered"))
    return rules.join(found, key, "left").fillna(0, ["triggers"])


def suite(annotations: DataFrame, issues: DataFrame, key: str, allowed: Sequence[str], false_positives: Sequence[str], markers: Sequence[str]) -> DataFrame:
    """A row for each key: annotations kept and ignored (allowed to be missed), issues kept and ignored (known
    false positives), empty and idle suggestions, and issues that hold each marker.

    annotations (key, selected, comment); issues (key, rule, category, original_text, suggestion).
    """
    any_of = lambda c, words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(X.compact(c), X.compact(w))) if words else F.lit(False)
    blob = F.concat_ws(" ", "rule", "category", "original_text", "suggestion")
    missed = any_of(F.concat_ws(" ", "selected", "comment"), allowed)
    gold = annotations.groupBy(key).agg(F.count_if(~missed).alias("annotations"), F.count_if(missed).alias("allowed_misses"))
    known = any_of(blob, false_positives)
    same = X.letters_digits(F.col("original_text")) == X.letters_digits(F.col("suggestion"))
    empty = F.trim(X.text_of(F.col("suggestion"))) == ""
    found = issues.groupBy(key).agg(
        F.count_if(~known).alias("issues"),
        F.count_if(known).alias("false_positives"),
        F.count_if(empty).alias("empty_suggestions"),
        F.count_if(~empty & same).alias("idle_suggestions"),
        *(F.count_if(F.contains(F.lower(blob), F.lit(m.lower()))).alias(f"has_{m}") for m in markers),
    )
    return gold.join(found, key, "full").fillna(0)
