"""Rows that repeat: copies are not paired with each other, a content is made comparable once."""

from types import SimpleNamespace

from pyspark.sql import functions as F

from lexmill.functions import text as X
from lexmill.operators import issues
from lexmill.plans import texts


def test_copies_of_a_name_are_not_paired_with_each_other(spark):
    names = {0: "abc", 1: "abd", 2: "a name of more than 15", 3: None}
    rows = [("x", "t", 1, names[k % 4], k) for k in range(400)] + [("y", "t", 1, "abc", 900), ("x", None, 1, "abc", 901), ("x", None, 1, "abd", 902)]
    part = spark.createDataFrame(rows, "p_brand string, p_type string, p_size int, p_name string, p_partkey long")
    found = texts.edit_similarity_short(SimpleNamespace(part=part)).collect()
    assert len(found) == 6 + 4 * 99  # all pairs were 79,800
    pairs, of = {}, {}
    for r in found:
        if r["copy"]:
            of[r["b_key"]] = r["a_key"]
        else:
            pairs[r["a_key"], r["b_key"]] = r["similarity"]
    assert pairs == {(0, 1): 0.6667, (0, 2): 0.0, (0, 3): None, (1, 2): 0.0, (1, 3): None, (2, 3): 0.0}
    assert of == {k: k % 4 for k in range(4, 400)}
    assert {(r["a_key"], r["similarity"]) for r in found if r["copy"]} == {(0, 1.0), (1, 1.0), (2, 0.0), (3, None)}


def test_content_made_comparable_by_the_caller(spark):
    rows = [(1, k, t, 90, "Some Text\nof words") for k, t in enumerate(["some text", "SOMETEXT", "of  words", "none", "", None])] + [(2, 9, "a", 60, "a"), (2, 10, "a", 90, None)]
    found = spark.createDataFrame(rows, "doc long, nth int, original_text string, confidence int, content string")
    want = issues.normalized_candidates(found, "doc", "nth").select("doc", "nth").collect()
    given = found.withColumn("made", X.compact(F.col("content"))).drop("content")
    assert sorted(issues.normalized_candidates(given, "doc", "nth", content=F.col("made")).select("doc", "nth").collect()) == sorted(want) == [(1, 0), (1, 2)]
