"""Scores of templates are computed once for a pair; ratios of a batch are those of difflib."""

import random
from difflib import SequenceMatcher

from lexmill.operators import matching, templates


def test_filters_do_not_repeat_the_scores(spark):
    rows = lambda texts: spark.createDataFrame(list(enumerate(texts)), "idx long, text string")
    found = templates.kept(templates.candidates(rows(["When ready, click the green button.", "Close the window now."]), rows(["When ready, press the green button.", "close THE window now."])), pending=0.3)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan  # intents are read once, before
    assert [(r["sentence_id"], r["template_id"], r["tier"], r["reasons"]) for r in found.collect()] == [(0, 0, "fuzzy", ["actions"])]


def test_ratios_of_a_batch(spark):
    r = random.Random(5)
    texts = ["".join(r.choice("ab c") for _ in range(r.randint(0, 260))) for _ in range(30)] + ["", None]
    pairs = [(r.choice(texts), r.choice(texts)) for _ in range(300)] + [("", None)]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", matching.ratio("a", "b").alias("r")).collect()
    assert all(t["r"] == SequenceMatcher(None, t["a"] or "", t["b"] or "").ratio() for t in got) and len(got) == 301
