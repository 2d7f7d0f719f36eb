"""Lists of words: no row for each occurrence is shuffled, however Spark estimates the lists' sizes."""

import pytest

from lexmill.operators import proofing


@pytest.mark.parametrize("listed", [1 << 20, 1])
def test_unknown_words_are_not_shuffled_one_by_one(spark, monkeypatch, listed):
    monkeypatch.setattr(proofing, "LISTED", listed)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the lists were large
    try:
        docs = spark.createDataFrame([(1, "The quick quick Fox Acme acme"), (1, "quick zebra zebra"), (2, None)], "doc_id int, text string")
        words = lambda *w: spark.createDataFrame([(x,) for x in w], "word string")
        found = proofing.unknown_words(docs, words("THE", "fox", None), words("Acme", None))
        plan = found._jdf.queryExecution().sparkPlan().toString()
        assert sorted(tuple(r) for r in found.collect()) == [(1, "acme", 1), (1, "quick", 3), (1, "zebra", 2)]
        below = plan[plan.index("SortMergeJoin") :] if "SortMergeJoin" in plan else ""
        assert "Generate" not in below  # a join by shuffle sees counts, not occurrences
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
