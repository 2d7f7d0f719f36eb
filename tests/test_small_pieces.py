"""Small pieces of work are not compared by whole rows of bits; groups of pairs are read in a row."""

import random

from lexmill.operators import matching


def test_small_pieces_wait_for_each_other(monkeypatch):
    r = random.Random(3)
    text = lambda: "".join(r.choice("abc d") for _ in range(r.randint(0, 90)))
    work = [([text() for _ in range(r.randint(0, 9))], [text() for _ in range(r.randint(0, 9))]) for _ in range(40)]
    wide = matching._all_in_order
    calls = []
    monkeypatch.setattr(matching, "_all_in_order", lambda *a: calls.append(1) or wide(*a))
    found = [sorted(x) for x in matching.near_each(work, 0.5)]
    assert not calls and sum(map(len, found)) > 20
    monkeypatch.setattr(matching, "WIDE", 0)
    assert [sorted(x) for x in matching.near_each(work, 0.5)] == found and calls


def test_groups_are_read_in_a_row(spark):
    r = random.Random(4)
    rows = [(float("nan") if k == 7 else None if k == 8 else float(k), a, b, r.randint(1, 9) / 10) for k in range(9) for a in range(6) for b in range(5)]
    pairs = spark.createDataFrame(rows, "k double, a_idx int, b_idx long, score double")
    for choose, best in ((matching.greedy, matching._first_free), (matching.optimal, matching._best_sum)):
        found = choose(pairs, "k")
        assert "InPandas" not in found._jdf.queryExecution().executedPlan().toString()
        got = sorted((repr(p["k"]), p["a_idx"], p["b_idx"], p["score"]) for p in found.collect())
        want = []
        for key in {repr(p[0]) for p in rows}:
            own = [p for p in rows if repr(p[0]) == key]
            want += [(key, *own[k][1:]) for k in best(*(list(c) for c in list(zip(*own, strict=True))[1:]))]
        assert got == sorted(want) and len(got) == 45
