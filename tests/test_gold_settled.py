"""Gold rows with enough equal issues are settled without being compared; the total is that of comparing all with all."""

import random

from lexmill.operators import evaluation, matching


def test_total_is_the_greatest_and_settled_rows_are_not_compared(spark, monkeypatch):
    r = random.Random(7)
    words = ["alpha", "beta", "gamma", "delta", "omega"]
    pool = [" ".join(r.choice(words) for _ in range(4)) for _ in range(9)] + ["ab" * 150]  # the last is no match of itself for difflib
    gold = [(k, i, r.choice(pool)) for k in "xy" for i in range(8)] + [("x", 50, "quite alone"), ("x", 51, pool[-1]), (None, 1, pool[0]), ("z", 1, pool[0])]
    issues = [(k, i, r.choice(pool) + r.choice(["", "", "", "s"])) for k in "xy" for i in range(14)] + [("x", 60 + i, "quite alone") for i in range(2)] + [("x", 70, pool[-1]), ("x", 3, pool[1]), ("y", None, pool[0])]
    frame = lambda rows: spark.createDataFrame(rows, "k string, idx long, text string").repartition(3)
    a, b = frame(gold), frame(issues)
    want = matching.optimal(matching.alike(a, b, "k", 0.6), "k").collect()
    compared, alike = [], matching.alike

    def recorded(x, y, *args, **kw):
        compared.append({t["text"] for t in x.select("text").collect()})
        return alike(x, y, *args, **kw)

    monkeypatch.setattr(matching, "alike", recorded)
    found = evaluation.gold_assignment(a, b, "k", 0.6).collect()
    assert abs(sum(t["score"] for t in found) - sum(t["score"] for t in want)) < 1e-9 and len(found) > 12
    for side in ("a_idx", "b_idx"):
        assert len({(t["k"], t[side]) for t in found}) == len(found)
    scores = {(t["k"], t["a_idx"], t["b_idx"]): t["score"] for t in alike(a, b, "k", 0.6).groupBy("k", "a_idx", "b_idx").agg({"score": "max"}).withColumnRenamed("max(score)", "score").collect()}
    assert all(scores[t["k"], t["a_idx"], t["b_idx"]] == t["score"] for t in found)
    assert "quite alone" not in compared[-1] and pool[-1] in compared[-1]


def test_a_small_side_meets_the_other_in_its_tasks(spark, monkeypatch):
    r = random.Random(3)
    texts = ["".join(r.choice("abc d") for _ in range(r.randint(0, 9))) for _ in range(90)] + [None, ""]
    rows = lambda some, k: spark.createDataFrame([(r.choice([0, 1, None]), i + k, t) for i, t in enumerate(some)], "b int, idx int, text string")
    a, b = rows(texts[:20], 0), rows(texts[20:], 5)
    monkeypatch.setattr(matching, "MEMBERS", 8)
    for few, (x, y) in (("a", (a, b)), ("b", (b, a))):
        want = sorted(matching.alike(x, y, "b", 0.6).collect())
        assert sorted(matching.alike(x, y, "b", 0.6, few=few).collect()) == want and len(want) > 20
