"""Queries by name, each with the SQL that gives the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Numbers of rows within a document stay below this, so id * NTH + number names a row of an id below 2^31.
NTH = 1 << 31

#: In SQL, what Spark's ``\\b`` before a word is: RE2's own knows ASCII letters only and begins a word after "é".
BEGIN = r"(?:^|[^\p{L}\p{Nd}\p{Mn}_])"


def ascii_words(c: str) -> str:
    """SQL: the text with a low line for every other letter, digit or mark, so that RE2's ``\\b`` sees none of them as a gap."""
    return rf"regexp_replace({c}, '[^\P{{L}}a-zA-Z]|[^\P{{Nd}}0-9]|\p{{Mn}}', '_', 'g')"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """The tables of a folder as DataFrames: ``t.events`` reads ``events.parquet``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._dir}/{name}.parquet")


def query(sql: str | None = None):
    """Register a function of the tables under its own name."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add
