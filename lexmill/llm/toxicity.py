"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton over folded text.

Folding. Compatibility forms, look-alike letters of other alphabets, invisible characters and
digits or signs that stand for letters inside a word are undone; everything but letters
becomes one space, so that an entry is anchored at the start of a word.

Lexicon. Word beginnings and whole words of labelled documents, weighted by the lower
confidence bound of their log odds. A longer entry stays only if it says more than the shorter
one. Exceptions are whole words, alone or with the word before or after, that hold an entry but
are common in clean documents; a match inside one counts nothing.

Score. The weights found, as such and normalised by length, give a probability through a
logistic curve fitted to the same documents. Learning reads at most ``sample`` labelled rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm._common import cut

#: Labelled rows that learning reads at most, by hash of their id.
SAMPLE = 20_000
SHORTEST, LONGEST = 3, 12
#: Features that a task counts before it hands their sums on.
FEATURES_HELD = 1 << 18

# Letters that look like Latin ones, and characters that stand for letters.
LOOKALIKES = dict(zip("аеорсухіјѕԁһӏкмтвнοανρτυικɑɡıℓ", "aeopcyxijsdhlkmtbhoavptuikagil", strict=True))
STANDINS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l"}
INVISIBLE = "­​‌‍⁠﻿"

_FOLD = {ord(k): v for k, v in LOOKALIKES.items()} | {ord(c): None for c in INVISIBLE}
_INSIDE = re.compile(r"(?<=[^\W\d_])[" + re.escape("".join(STANDINS)) + r"]+(?=[^\W\d_])")
_OTHER = re.compile(r"[\W\d_]+")


def folded(text: str | None) -> str:
    """Lower-case words of letters, one space before and after each."""
    text = text or ""
    if not text.isascii():
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text)
        text = text.lower().translate(_FOLD)
    else:
        text = text.lower()
    text = _INSIDE.sub(lambda m: "".join(STANDINS[c] for c in m[0]), text)
    return f" {_OTHER.sub(' ', text).strip()} "


@dataclass
class Lexicon:
    """Entries and exceptions as they appear in folded text: ' begin', ' word ', ' two words '."""

    weights: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    curve: tuple[float, float, float] = (-3.0, 1.0, 1.0)

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for e, w in self.weights.items():
            a.add_word(e, (len(e), w))
        for e in self.exceptions:
            a.add_word(e, (len(e), None))
        a.make_automaton()
        return a


def hits(text: str, automaton) -> list[tuple[int, int, float]]:
    """(start, end, weight) of the words of a folded text that hold an entry and are not excepted."""
    if not len(automaton):
        return []
    best: dict[int, tuple[int, float]] = {}
    spared: dict[int, int] = {}  # start -> farthest end
    for end, (size, weight) in automaton.iter(text):
        start = end + 1 - size
        if weight is None:
            spared[start] = max(end + 1, spared.get(start, 0))
        elif start not in best or best[start][1] < weight:
            best[start] = end + 1, weight
    if not spared or not best:
        return [(s, e, w) for s, (e, w) in best.items()]
    out, reach, ahead, k = [], 0, sorted(spared), 0
    for s in sorted(best):  # an exception that began before covers a match if it also ends after it
        while k < len(ahead) and ahead[k] <= s:
            reach = max(reach, spared[ahead[k]])
            k += 1
        if best[s][0] > reach:
            out.append((s, *best[s]))
    return out


def features(text: str, found: list[tuple[int, int, float]]) -> tuple[float, float]:
    """The weights found: as such, damped, and for the number of words."""
    total, words = sum(w for _, _, w in found), text.count(" ")
    return math.log1p(total), total / math.sqrt(words + 10)


def _odds(toxic: int, clean: int, n_toxic: int, n_clean: int) -> tuple[float, float]:
    """Log odds of a document frequency, and their lower confidence bound."""
    odds = math.log((toxic + 0.5) / (n_toxic + 1)) - math.log((clean + 0.5) / (n_clean + 1))
    return odds, odds - 1.5 * math.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))


def _begins(text: str) -> set[str]:
    out = set()
    for w in set(text.split()):
        if len(w) >= SHORTEST:
            out.add(f" {w} ")
            out.update(f" {w[:k]}" for k in range(SHORTEST, min(len(w), LONGEST) + 1))
    return out


def _counted(rows: DataFrame, of) -> DataFrame:
    """Documents with each feature: feature, toxic, clean; ``of`` makes a set from a folded text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())

        def made() -> Iterator[pa.RecordBatch]:
            every = list(seen[0].keys() | seen[1].keys())
            columns = [pa.array(every, pa.string()), *(pa.array([seen[k][x] for x in every], pa.int64()) for k in (1, 0))]
            seen[0].clear()
            seen[1].clear()
            yield pa.RecordBatch.from_arrays(columns, names=["feature", "toxic", "clean"])

        for batch in batches:
            for body, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                seen[1 if toxic else 0].update(of(folded(body.as_py())))
                if len(seen[0]) + len(seen[1]) >= FEATURES_HELD:
                    yield from made()
        yield from made()

    return rows.mapInArrow(count, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[float, ...]:
    """Logistic regression by Newton steps; the first weight is the constant's."""
    x = np.column_stack((np.ones(len(x)), x))
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", doc_id: str = "doc_id", sample: int = SAMPLE, most: int = 5000) -> Lexicon:
    """A lexicon of at most ``most`` entries from at most ``sample`` labelled documents.

    Null labels and ids are skipped; an id labelled twice counts as its larger label; without
    a toxic and a clean document the lexicon is empty and every score small. An id that several
    rows have counts once, with the least of their texts.
    """
    chosen = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(doc_id).agg((F.max(label) > 0).alias("toxic")).orderBy(F.xxhash64(doc_id), doc_id).limit(sample)
    rows = docs.select(F.col(doc_id), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(chosen), doc_id)
    rows = cut(rows.groupBy(doc_id).agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).select("text", "toxic"), "toxicity-sample")
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return Lexicon({})
    n_toxic, n_clean = n[True], n[False]

    least = max(3, n_toxic // 200)
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
    bound = odds - 1.5 * F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    found = _counted(rows, _begins).where(F.col("toxic") >= least).withColumn("bound", bound).where("bound > 0.75").orderBy(F.desc("bound"), "feature").limit(4 * most).collect()
    weights: dict[str, float] = {}
    for r in sorted(found, key=lambda r: (len(r["feature"]), r["feature"])):
        e = r["feature"]
        shorter = max((weights[e[:k]] for k in range(SHORTEST + 1, len(e)) if e[:k] in weights), default=0.0)
        if r["bound"] > shorter + 0.1:
            weights[e] = r["bound"]
    weights = dict(sorted(weights.items(), key=lambda kv: (-kv[1], kv[0]))[:most])

    a = Lexicon(weights).automaton()

    def phrases(t: str) -> set[str]:
        out = set()
        for s, _, _ in hits(t, a):
            stop = t.index(" ", s + 1) + 1
            after, before = t.find(" ", stop) + 1, t.rfind(" ", 0, s)
            out.add(t[s:stop])
            if after:
                out.add(t[s:after])
            if before >= 0:
                out.add(t[before:stop])
        return out

    spared = _counted(rows, phrases).where(F.col("clean") >= max(3, n_clean // 2000)).collect() if weights else []
    exceptions = needed({r["feature"] for r in spared if _odds(r["toxic"], r["clean"], n_toxic, n_clean)[0] < 0.5}, a)

    lexicon = Lexicon(weights, exceptions)
    seen = rows.select(_features(lexicon, F.col("text")).alias("f"), "toxic").select("f.*", "toxic").toPandas()
    return Lexicon(weights, exceptions, fit_curve(seen[["damped", "dense"]].to_numpy(), seen["toxic"].to_numpy().astype(float)))


def needed(exceptions: set[str], automaton) -> list[str]:
    """Exceptions without the phrases whose words that hold an entry are all exceptions by themselves: these spare nothing more."""
    return sorted(e for e in exceptions if len(ws := e.split()) < 2 or any(f" {w} " not in exceptions and hits(f" {w} ", automaton) for w in ws))


def _features(lexicon: Lexicon, text: Column) -> Column:
    @F.pandas_udf("damped double, dense double")
    def measure(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        a = lexicon.automaton()
        for texts in batches:
            yield pd.DataFrame([features(t, hits(t, a)) for t in map(folded, texts)], columns=["damped", "dense"])

    return measure(text)


def toxicity(lexicon: Lexicon, text: Column) -> Column:
    """The score of a text as a column, from 0 to 1."""
    c, damped, dense = lexicon.curve

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        a = lexicon.automaton()
        for texts in batches:
            x = np.array([features(t, hits(t, a)) for t in map(folded, texts)]).reshape(-1, 2)
            yield pd.Series(1 / (1 + np.exp(-np.clip(c + damped * x[:, 0] + dense * x[:, 1], -30, 30))))

    return score(text)


def score_toxicity(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, score and predicted (1 if score >= threshold, else 0) of every row.

    Null and empty texts get the score of a text without matches. Repeated rows and null ids
    give a row each; other columns are ignored; an empty table gives an empty result.
    """
    scored = docs.select(F.col(doc_id).alias("doc_id"), toxicity(lexicon, F.col(text)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def matches(docs: DataFrame, lexicon: Lexicon, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, entry (the folded words that matched) and weight, a row for each match."""

    @F.pandas_udf("array<struct<entry:string,weight:double>>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        a = lexicon.automaton()
        for texts in batches:
            yield pd.Series([[{"entry": t[s:e].strip(), "weight": w} for s, e, w in hits(t, a)] for t in map(folded, texts)])

    return docs.select(F.col(doc_id).alias("doc_id"), F.inline(find(F.col(text))))
