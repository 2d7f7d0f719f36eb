"""Queries of whole words and their SQL agree beside letters that are not ASCII: no word begins or ends there."""

import duckdb
import pytest

from lexmill.plans import all_queries

TEXTS = (
    "Réan de an dé an uñ a éa a use. an b2b Ña idea éa idea",
    "éy y yé and éand the The éthe Theé une the the",
    "thé éene the éthf thf thb enb éenb ñthc",
    "éder derñ der der éund the éthe la les desé",
    "éder der der éles the the quéque élos",
    "한국 the and of to",
    "да the and of to",
    "action actioné 7 é7 caution. A1 = é",
    "éA1 = x and action 7. A1 = x",
    "nationé 7 words here that end in a mark.",
)
NAMES = ("article_usage", "cat_guards", "language_by_script", "mixed_terms", "reference_integrity")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("words"))
    spark.createDataFrame([(k, x, "en") for k, x in enumerate(TEXTS)], "doc_id long, text string, lang string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(k // 5, k % 5, "user", x) for k, x in enumerate(TEXTS)], "conv_id long, turn long, role string, text string").write.parquet(f"{at}/conversations.parquet")
    return at


@pytest.mark.parametrize("name", NAMES)
def test_sql_agrees(spark, folder, name):
    registry = all_queries()
    found = registry.QUERIES[name](spark, folder)
    duck = duckdb.connect()
    for t in ("documents", "conversations"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    sql = duck.execute(registry.ORACLE_SQL[name])
    assert found.columns == [d[0] for d in sql.description]
    assert sorted(map(tuple, found.collect())) == sorted(sql.fetchall())
