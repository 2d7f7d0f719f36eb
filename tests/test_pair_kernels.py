"""Kernels of pairs of texts: the same figures as the plain versions, and time that long texts allow."""

import random
import time
import tracemalloc
from difflib import SequenceMatcher

import pyarrow as pa

from pyspark.sql import functions as F

from lexmill.functions import text as X
from lexmill.operators import cat, matching


def _texts(seed, letters="abcé😀 "):
    r = random.Random(seed)
    text = lambda: "".join(r.choice(letters) for _ in range(r.choice([0, 1, 2, 7, 40, 130])))
    for _ in range(300):
        a, b = text(), text()
        yield from ((a, b), (a, a), (a + b, b + a), (a, b + a + b))


def _plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for k, y in enumerate(b):
            before, row[k + 1] = row[k + 1], before + 1 if x == y else max(row[k], row[k + 1])
    return row[-1] / max(len(a), len(b)) if a and b else 0.0


def test_common_subsequence_as_before():
    assert all(matching._lcs(a, b) == _plain_lcs(a, b) for a, b in list(_texts(1))[:500])
    r = random.Random(2)
    a, b = ("".join(r.choice("etaoin shrdlu") for _ in range(6000)) for _ in range(2))
    began = time.process_time()
    assert 0.4 < matching._lcs(a, b) < 1
    assert time.process_time() - began < 0.12  # a bit for each character; a step over numbers for each took 0.2 and more


def test_longest_common_part_as_before():
    want = lambda a, b: SequenceMatcher(None, a, b, autojunk=False).find_longest_match().size
    assert all(matching._common_part(a, b) == want(a, b) for a, b in _texts(3))
    r = random.Random(4)
    a, b = ("".join(r.choice("etaoin shrdlu") for _ in range(20000)) for _ in range(2))
    began = time.process_time()
    assert 5 < matching._common_part(a, b) < 20 and matching._common_part(a, "x" + a) == 20000
    assert time.process_time() - began < 1  # difflib took over ten seconds


def test_char_diff_holds_few_objects(spark):
    """Only some rows' runs are Python objects; the others are already columns of Arrow."""
    texts = list(_texts(5))[:300] + [(None, "a"), ("a", None), (None, None)]
    rows = spark.createDataFrame(texts, "a string, b string").coalesce(1)
    found = [([tuple(r) for r in d], a, b) for d, a, b in rows.select(matching.char_diff("a", "b"), "a", "b").collect()]
    assert all(d == matching.edit_script(a or "", b or "") for d, a, b in found) and len(found) == 303
    r = random.Random(6)
    sides = [pa.array(["".join(r.choice("etaoin shrdlu") for _ in range(200)) for _ in range(128)]) for _ in range(2)]
    tracemalloc.start()
    assert sum(map(len, matching._diff_batches([tuple(sides)]))) == 128
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 << 20  # half of what dictionaries of the runs of all rows take


def test_likeness_of_ngrams_as_by_arrays(spark):
    texts = [t for t in _texts(7, "ab é😀") if max(map(len, t)) < 60][:80]
    rows = spark.createDataFrame(texts, "a string, b string")
    grams = F.array_distinct(F.concat(*(X.char_ngrams(F.col("a"), n) for n in (2, 3, 4))))
    covered = F.size(F.filter(grams, lambda g: F.contains("b", g))) / F.greatest(F.size(grams), F.lit(1))
    found = matching.ngram_likeness(F.col("a"), F.col("b"))
    out = rows.select(found["jaccard"], X.jaccard(X.char_ngrams(F.col("a")), X.char_ngrams(F.col("b"))), found["covered"], covered).collect()
    assert len(out) > 50 and all(r[0] == r[1] and r[2] == r[3] for r in out)
    for like in (matching.clause_similarity(F.col("a"), F.col("b"), F.lit(0.5)), cat.aligned_clauses(F.col("a"), F.col("b"))):
        plan = rows.select(like)._jdf.queryExecution().optimizedPlan().toString()
        assert "array_distinct" not in plan and "array_intersect" not in plan  # these compare all pairs of n-grams


def test_best_clause_of_each(spark):
    rows = spark.createDataFrame([("abcd, x", "abce; abcd"), ("", "a"), ("a", ""), (None, None), ("abcd,abxy", "bcda,zzab")], "a string, b string")
    found = [r[0] for r in rows.select(cat.aligned_clauses(F.col("a"), F.col("b"))).collect()]
    assert found == [0.5, 0.0, 0.0, 0.0, (0.5 + 0.2) / 2]


def test_ratios_that_end_early_are_those_of_difflib():
    rng = random.Random(11)
    for size in (0, 1, 7, 60, 260):
        for _ in range(60):
            a, b = ("".join(rng.choice("abcd e") for _ in range(rng.randint(size // 2, size))) for _ in range(2))
            b = b if rng.random() < 0.5 else a[: len(a) // 2] + b[len(a) // 2 :]
            m = SequenceMatcher(None, a, b)
            assert matching._ratio(m, 0.0) == m.ratio()
            for least in (0.4, 0.6, m.ratio(), 0.8):
                assert matching._ratio(m, least) in ((m.ratio(),) if m.ratio() >= least else (m.ratio(), 0.0))


def test_sentences_of_both_sides_are_made_once(spark):
    """The text is taken apart once for both sides, not for each count and join of the comparison."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def made(text):
        seen.add(1)
        return text

    rows = [(p, i, f"line {i} of the pair {p} " + "xyz" * (i % 3)) for p in range(3) for i in range(5)]
    side = lambda: spark.createDataFrame(rows, "pair long, idx long, text string").select("pair", "idx", made("text").alias("text"))
    assert matching.with_exact(side(), side(), "pair", 0.8).count() == 15
    assert seen.value == 30


def test_all_in_order_are_the_pairs_one_by_one(monkeypatch):
    import numpy as np

    calls = []
    monkeypatch.setattr(matching, "common_letters", lambda *a: calls.append(a))  # letters tell little at 0.6
    texts = [t for pair in list(_texts(4))[:60] for t in pair] + ["", "x" * 64, "x" * 65, "abcé😀 " * 60]
    for bits in (40, 1 << 16):
        monkeypatch.setattr(matching, "BITS", bits)
        for least in (0.6, 0.3, 0.0):
            xs, ys, _, _, i, j = matching._able(texts[::2], texts[1::2], least)
            p, q = (k.ravel() for k in np.meshgrid(range(len(xs)), range(len(ys)), indexing="ij"))
            size = np.array([len(xs[k]) + len(ys[n]) for k, n in zip(p, q, strict=True)])
            able = 2.0 * matching.common_in_order(xs, ys, p, q) >= least * size - 1e-9
            assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == sorted(zip(p[able].tolist(), q[able].tolist(), strict=True)) and 0 < len(i)
    assert not calls


def test_in_turn_indexes_a_text_once(spark, monkeypatch):
    made = []
    monkeypatch.setattr(matching, "SequenceMatcher", lambda *a: made.append(a) or SequenceMatcher(*a))
    r = random.Random(6)
    left, right = ([(k, "".join(r.choice("ab c") for _ in range(r.randint(0, 220)))) for k in range(12)] for _ in "ab")
    found = list(matching._in_turn(left, right, 0.0))
    used, want = set(), []
    for i, x in left:
        s, j = max(((SequenceMatcher(None, x, y).ratio(), -j) for j, y in right if j not in used), default=(0.0, 0))
        if s > 0:
            used.add(-j)
            want.append((i, -j, s))
    assert found == want and len(made) <= len(right)
    rows = spark.createDataFrame([(None, 0, "ab"), (None, 1, "ab"), ("x", 0, None), ("x", 1, "abc")], "b string, idx int, text string")
    out = matching.aligned_in_order(rows, rows.where("idx = 1"), "b", least=0.1)
    assert "CoGroup" not in out._jdf.queryExecution().executedPlan().toString()  # groups are read in a row, not sent one by one
    assert sorted(map(tuple, out.collect()), key=str) == [("x", 1, 1, 1.0, "exact"), (None, 0, 1, 1.0, "exact")]
