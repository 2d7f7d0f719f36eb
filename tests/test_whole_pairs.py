"""Queries on pairs give every pair of their rule, copies included."""

from itertools import combinations
from types import SimpleNamespace

from lexmill.operators import templates
from lexmill.plans import texts


def test_all_parts_of_a_kind_are_paired(spark):
    names = ["abc", "abd", "a name of more than 15", None, "xyz"]
    rows = [("x", "t", 1, names[k % 5], k) for k in range(40)] + [("y", "t", 1, "abc", 90), ("x", None, 1, "abc", 91), ("x", None, 1, "abd", 92), ("x", "t", 1, "abc", None)]
    part = spark.createDataFrame(rows, "p_brand string, p_type string, p_size int, p_name string, p_partkey long")
    found = [tuple(r) for r in texts.edit_similarity_short(SimpleNamespace(part=part)).select("a_key", "b_key", "similarity").collect()]

    def like(a, b):
        if "a name of more than 15" in (a, b):
            return 0.0
        if a is None or b is None:
            return None
        return 1.0 if a == b else 0.0 if "xyz" in (a, b) else 0.6667

    want = {(i, j): like(names[i % 5], names[j % 5]) for i, j in combinations(range(40), 2)}
    assert len(found) == len(want) == 780
    assert {(a, b): s for a, b, s in found} == want


def test_all_templates_that_meet_the_threshold_are_kept(spark):
    rows = [(1, t, 0.5 + t / 100, 0.1, 0.0, "fuzzy") for t in range(12)] + [(2, 0, 0.9, 0.9, 0.0, "exact"), (2, 1, 0.3, 0.2, 0.0, "reference")]
    found = spark.createDataFrame(rows, "sentence_id long, template_id long, score double, edit double, penalty double, tier string")
    assert [(r["template_id"], r["rank"]) for r in templates.kept(found).orderBy("rank").collect()] == [(11 - k, k + 1) for k in range(12)]
    assert templates.kept(found, k=5).count() == 5
