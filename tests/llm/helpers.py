"""Small tables with the awkward cases every operator must take."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("aeioubcdfgt") for _ in range(r.randint(2, 8))) for _ in range(n))


def odd_rows():
    """Null and empty texts, blanks, ties, repeated rows, null ids and labels, a long text without spaces."""
    text = words(1, 40)
    return [
        (1, None, "en", "a", 0),
        (2, "", "en", "a", 0),
        (3, " \t\n ", None, None, 4),
        (4, text, "en", "a", len(text)),
        (5, text, "en", "b", len(text)),
        (6, text + " extra", "en", "b", 0),
        (6, text + " extra", "en", "b", 0),
        (None, "one two three", "fr", "b", 13),
        (7, "x" * 50_000, None, "b", 50_000),
        (8, words(2, 3000), "fr", None, 0),
        (9, "12345 !!! ???", "en", "a", 13),
        (10, "Ünïcödé ＦＵＬＬ <|endoftext|> 中文 😀 end", "fr", "a", 0),
    ]


def odd_docs(spark):
    return spark.createDataFrame(odd_rows(), DOCS)


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


def with_clashes(df, *names):
    """The table with further columns that carry the names of results."""
    from pyspark.sql import functions as F

    for n in names:
        df = df.withColumn(n, F.lit("clash"))
    return df
