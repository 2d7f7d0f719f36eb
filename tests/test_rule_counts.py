"""Counts of rules are added up in the tasks, and are those of the spans."""

import random

from pyspark.sql import functions as F

from lexmill.operators import ruletable


def test_counts_are_those_of_the_spans(spark, monkeypatch):
    r = random.Random(8)
    words = ["alpha", "beta", "Beta", "x_y", "é", "and", "a.b"]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(0, 9))) for _ in range(60)] + ["", None]
    docs = spark.createDataFrame([(None if k % 11 == 0 else r.randint(0, 40), t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    rules = [("alpha", r"\balpha\b", False), ("beta", r"\bbeta\b", False), ("any", r"(?i)beta|\d", True), ("part", "a", False), ("dot", r"\ba\.b\b", False), ("no", "zzz", False), ("x", r"\bx_y\b", False)]
    rules = spark.createDataFrame(rules, "rule string, pattern string, ignore_case boolean")
    want = sorted(map(tuple, ruletable.hits(docs, rules).groupBy("rule").agg(F.count_distinct("doc_id"), F.count("*")).collect()))
    assert len(want) == 6
    for most in (ruletable.REPEATED, 0):
        monkeypatch.setattr(ruletable, "REPEATED", most)
        found = ruletable.counted(docs, rules).select("rule", "docs", "hits")
        assert "original_text" not in found._jdf.queryExecution().optimizedPlan().toString()  # no row for each span
        assert sorted(map(tuple, found.collect())) == want


def test_whole_words_without_parsing():
    for p in (r"\bword\b", r"\b1é_\b", r"\ba\.b\b", r"\bw", r"w\b", r"\bw*\b", r"\ba b\b", r"\b\b", r"\B\b"):
        found = ruletable.literal(p)
        assert ruletable.whole_word(p) == (found[0] if found and found[1] and found[2] and ruletable._WORDS.fullmatch(found[0]) else None)
    assert ruletable.whole_word(r"\b1é_\b") == "1é_" and ruletable.whole_word(r"\ba\-b\b") is None
