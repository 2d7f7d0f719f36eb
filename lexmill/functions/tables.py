"""Functions for SQL: table functions from texts to spans, and similarities, registered with a session."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
import regex
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf, udtf

_compiled: dict[str, regex.Pattern] = {}


def _pattern(p: str) -> regex.Pattern:
    if p not in _compiled:
        if len(_compiled) > 256:
            _compiled.clear()
        _compiled[p] = regex.compile(p)
    return _compiled[p]


class TextSpans:
    """A row for each match of a pattern in a text: nth from 0, start and end in code points, the matched text."""

    def eval(self, text: str, pattern: str) -> Iterator[tuple[int, int, int, str]]:
        if text is not None and pattern is not None:
            for k, m in enumerate(_pattern(pattern).finditer(text)):
                yield k, m.start(), m.end(), m[0]


class SentenceSpans:
    """A row for each sentence: up to its end marks or the end of its line, trimmed, of ``least`` characters or more."""

    def eval(self, text: str, least: int) -> Iterator[tuple[int, int, int, str]]:
        k = 0
        for m in _pattern(r"[^.!?\n]+[.!?]*").finditer(text or ""):
            whole = m[0]
            start = m.start() + len(whole) - len(whole.lstrip(" "))
            whole = whole.strip(" ")
            if len(whole) >= (least or 0):
                yield k, start, start + len(whole), whole
                k += 1


_ROWS = "nth int, start int, end int, span string"


def register(spark: SparkSession) -> None:
    """Make ``text_spans(text, pattern)``, ``sentence_spans(text, least)`` and ``similarity(a, b)`` known to SQL.

    The first two are table functions, for ``FROM t, LATERAL text_spans(t.text, '...')``.
    """
    spark.udtf.register("text_spans", udtf(TextSpans, returnType=_ROWS, useArrow=True))
    spark.udtf.register("sentence_spans", udtf(SentenceSpans, returnType=_ROWS, useArrow=True))

    @pandas_udf("double")
    def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])

    spark.udf.register("similarity", similarity)
