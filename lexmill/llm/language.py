"""Language identification by rank-order profiles of character n-grams.

A profile lists a language's most frequent n-grams (one to three letters, words set off by a
separator) by rank. A document's own most frequent n-grams are compared with each profile: an
n-gram counts the distance between its two ranks, or the full depth where the profile lacks
it. The language with the least sum is predicted.

Profiles are counted over all training rows: tasks count their n-grams, sums by language and
n-gram meet in one aggregation, and the first ``depth`` of each language are kept. That is all
the driver sees.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEPTH = 400
ORDERS = 3
UNDETERMINED = "und"
#: Training texts counted at once, in characters.
CHUNK = 1 << 20

_letters: list[np.ndarray] = []
_OTHER = re.compile(r"[\W\d_]")


def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def grams(text: str) -> np.ndarray:
    """n-grams of 1 to 3 letters of a text as integers, repeats included; a separator counts as 1, a letter as its code point."""
    a = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32).astype(np.int64)
    a = np.where(letters()[a], a, 1)
    a = np.concatenate(([1], a[(a > 1) | (np.concatenate(([65], a[:-1])) > 1)], [1]))
    letter = a > 1
    two = (a[:-1] << 21) | a[1:]
    three = (two[:-1] << 21) | a[2:]
    # an n-gram has a letter, and separators only at its ends
    return np.concatenate((a[letter], two[letter[:-1] | letter[1:]], three[letter[1:-1]]))


def pieces(text: str) -> Iterator[str]:
    """A text cut between words into pieces of about ``CHUNK`` characters; their n-grams are together the text's."""
    at = 0
    while len(text) - at > CHUNK:
        gap = _OTHER.search(text, at + CHUNK)
        while gap and text[gap.start()].isalpha():  # letters that the pattern does not count as such
            gap = _OTHER.search(text, gap.end())
        if not gap:
            break
        yield text[at : gap.start()]
        at = gap.start()
    yield text[at:]


def counted(parts: Iterator[str]) -> tuple[np.ndarray, np.ndarray]:
    """n-grams and how often they occur in all ``parts``."""
    codes, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    for part in parts:
        more, n = np.unique(grams(part), return_counts=True)
        if len(codes):
            both, at = np.unique(np.concatenate((codes, more)), return_inverse=True)
            codes, counts = both, np.bincount(at, np.concatenate((counts, n))).astype(np.int64)
        else:
            codes, counts = more, n
    return codes, counts


def top(codes: np.ndarray, counts: np.ndarray, depth: int) -> np.ndarray:
    """The most frequent n-grams in order; ties by code."""
    return codes[np.argsort(-counts, kind="stable")[:depth]]


class Profiles:
    """Ranks of each language's n-grams, in one sorted table."""

    def __init__(self, ranked: dict[str, list[int]], depth: int):
        self.names, self.depth = sorted(ranked), depth
        self.codes = np.array(sorted({c for v in ranked.values() for c in v}), np.int64)
        self.ranks = np.full((len(self.codes) + 1, len(self.names)), -1, np.int64)
        for k, name in enumerate(self.names):
            self.ranks[np.searchsorted(self.codes, ranked[name]), k] = np.arange(len(ranked[name]))

    def predict(self, text: str | None) -> tuple[str, float]:
        mine = top(*counted(pieces(text)), self.depth) if text else np.empty(0, np.int64)
        if not len(mine) or not self.names:
            return UNDETERMINED, 0.0
        at = np.searchsorted(self.codes, mine)
        at[at == len(self.codes)] = 0
        at = np.where(self.codes[at] == mine, at, len(self.codes))
        ranks = self.ranks[at]
        away = np.where(ranks < 0, self.depth, np.abs(ranks - np.arange(len(mine))[:, None])).sum(axis=0)
        best = int(np.argmin(away))
        return self.names[best], float(max(0.0, 1.0 - away[best] / (self.depth * len(mine))))


def learn(rows: DataFrame, text: str = "text", lang: str = "lang", depth: int = DEPTH) -> Profiles:
    """Profiles of every language of ``rows``; rows without a text or a language are skipped."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list[str]] = {}
        sizes: dict[str, int] = {}
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def add(name: str) -> None:
            codes, counts = counted(p for joined in ["\n".join(waiting.pop(name))] for p in pieces(joined))
            sizes[name] = 0
            if name in sums:
                old, before = sums[name]
                both, at = np.unique(np.concatenate((old, codes)), return_inverse=True)
                codes, counts = both, np.bincount(at, np.concatenate((before, counts))).astype(np.int64)
            sums[name] = codes, counts

        for batch in batches:
            for body, name in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                body = body.as_py()
                waiting.setdefault(name, []).append(body)
                sizes[name] = sizes.get(name, 0) + len(body)
                if sizes[name] >= CHUNK:
                    add(name)
        for name in list(waiting):
            add(name)
        for name, (codes, counts) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes), pa.string()), pa.array(codes), pa.array(counts)], names=["lang", "gram", "n"])

    known = rows.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where("text is not null and lang is not null")
    counts = known.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    ranked: dict[str, list[int]] = {}
    for r in counts.withColumn("rank", rank).where(F.col("rank") <= depth).orderBy("lang", "rank").collect():
        ranked.setdefault(r["lang"], []).append(r["gram"])
    return Profiles(ranked, depth)


def language(profiles: Profiles, text: Column) -> Column:
    """lang_pred and score of a text as a struct."""

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([profiles.predict(t) for t in texts], columns=["lang_pred", "score"])

    return predict(text)


def identify(docs: DataFrame, profiles: Profiles, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, lang_pred and score (0 to 1, higher: nearer to the profile) of every row.

    ``und`` with score 0 where the text is null or has no letter, or no language was learned.
    Repeated rows and null ids give a row each; ties of distance go to the first language by
    name; other columns are ignored; an empty table gives an empty result.
    """
    found = docs.select(F.col(doc_id).alias("doc_id"), language(profiles, F.col(text)).alias("found"))
    return found.select("doc_id", "found.lang_pred", "found.score")
