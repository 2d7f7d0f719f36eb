"""Candidates where one side is small: the same pairs as by rare n-grams, counted in the other side's tasks."""

import random

import pytest

from lexmill.operators import matching


@pytest.mark.parametrize("few, members, n", [("a", 1 << 12, 3), ("b", 9, 3), ("b", 1 << 12, 2), ("a", 9, 1)])
def test_both_ways_agree(spark, monkeypatch, few, members, n):
    r = random.Random(members + n)
    texts = ["".join(r.choice("aab é😀") for _ in range(r.randint(0, 12))) for _ in range(200)] + [None, "", " ", "a", "aé"] * 2
    rows = lambda some, k: spark.createDataFrame([(r.choice(["x", "y", None, "z"]), i * 3 + k, t) for i, t in enumerate(some)], "b string, idx int, text string").repartition(3)
    small, large = rows(texts[:60] + texts[-5:], 0), rows(texts[60:], 1)
    a, b = (small, large) if few == "a" else (large, small)
    monkeypatch.setattr(matching, "MEMBERS", members)
    found = matching.candidates(a, b, "b", n=n, least_jaccard=0.25)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == -(-65 // members) and "Join" not in plan and "Exchange hashpartitioning" not in plan  # nothing meets by a shuffle
    monkeypatch.setattr(matching, "PASSES", 0)
    names = ["b", "a_idx", "b_idx", "a_text", "b_text"]
    want = matching.candidates(a, b, "b", n=n, least_jaccard=0.25).select(names).collect()
    assert sorted(found.select(names).collect()) == sorted(want) and len(want) > 20


def test_rows_of_one_id_stay_apart(spark):
    """Sentences of several turns can share an id; their n-grams are not put together."""
    a = spark.createDataFrame([("x", 1, "abcdefgh"), ("x", 1, "stuvwxyz"), ("x", 1, "klmnopqr" * 9)], "b string, idx long, text string")
    b = spark.createDataFrame([("x", 7, "abcdefgz")], "b string, idx long, text string")
    found = matching.candidates(a, b, "b").collect()
    assert [(r["a_text"], r["b_text"]) for r in found] == [("abcdefgh", "abcdefgz")]
