"""The k best chunks of each question: the same as all pairs scored and ranked, without a row for each pair."""

import random

import pytest
from pyspark.sql import functions as F

from lexmill.functions import text as X
from lexmill.operators import retrieval
from lexmill.plans import all_queries


def plain(chunks, questions, k, title, most):
    """All pairs scored in Spark, then ranked."""
    rows = retrieval.term_scores(chunks, questions, ["doc", "idx"], title=title)
    grams = lambda c: X.char_ngrams(X.compact(c))
    met = rows.join(chunks, ["doc", "idx"]).join(questions, "question_id")
    common = F.least(F.size(F.array_intersect(grams(F.col("text")), grams(F.col("question")))), F.lit(most))
    met = met.withColumn("score", F.round(F.col("score") + 0.25 * common, 4))
    return retrieval.best(met, "question_id", [F.desc("score"), "doc", "idx"], k)


@pytest.mark.parametrize("title, most, passes", [(None, 0, 1), ("title", 0, 5), (None, 12, 3)])
def test_same_as_all_pairs(spark, monkeypatch, title, most, passes):
    monkeypatch.setattr(retrieval, "QUESTIONS", -(-40 // passes))
    r = random.Random(passes)
    words = [f"w{int(r.paretovariate(0.6)) % 900}" for _ in range(9000)] + ["éa", "Ünd", "中文"] * 20
    text = lambda n: " ".join(r.choices(words, k=n))
    rows = [(d, i, None if r.random() < 0.02 else text(r.randint(0, 40)), r.choice(["w1 w2", "W3", None, "w77"])) for d in range(150) for i in range(20)]
    rows += [(d, 0, rows[5][2], "w1 w2") for d in range(1000, 1400)]  # equal chunks: ties go by key
    chunks = spark.createDataFrame(rows, "doc long, idx int, text string, title string").repartition(3)
    questions = spark.createDataFrame([(f"q{n}", text(r.randint(0, 30)) if n else None) for n in range(40)], "question_id string, question string")
    names = ["question_id", "doc", "idx", "score", "rank"]
    found = retrieval.top_scores(chunks, questions, ["doc", "idx"], 7, title=title, most_bigrams=most).select(names).collect()
    assert sorted(found) == sorted(plain(chunks, questions, 7, title, most).select(names).collect())


@pytest.mark.parametrize("name", ["qa_context", "qa_score_topk", "qa_lexical_topk", "manual_pages_topk"])
def test_pairs_are_not_shuffled(spark, name):
    """Only each task's best chunks go over the network: once to their question."""
    plan = all_queries().QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1, plan
