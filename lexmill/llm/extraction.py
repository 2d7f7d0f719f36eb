"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

Each block is main text or not. Its score is the sum of the weights of its features (elements
and names around it, and its text); pairs of neighbouring labels have weights of their own.
Weights maximise the likelihood of labelled pages; a page is decoded by Viterbi.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.html_blocks import Block, blocks, features, text_features
from lexmill.llm.html_labelled import labelled_pages

#: Labelled pages that a model is trained on.
TRAIN_PAGES = 1600


@dataclass
class Crf:
    weights: dict[str, float]
    #: step[a][b]: weight of label b after label a; start[b]: of label b at the start
    step: tuple[tuple[float, float], tuple[float, float]]
    start: tuple[float, float]

    def __post_init__(self):
        self._around: dict[frozenset[str], float] = {}

    def scores(self, page: list[Block]) -> list[float]:
        """Score of label 1 over label 0 for each block."""
        out, known = [], self.weights
        for k, b in enumerate(page):
            around = self._around.get(b.around)
            if around is None:
                if len(self._around) >= 1 << 16:
                    self._around.clear()
                around = self._around[b.around] = sum(known.get(f, 0.0) for f in sorted(b.around))
            out.append(around + sum([known.get(f, 0.0) for f in text_features(page, k)]))
        return out

    def decode(self, scores: Sequence[float]) -> list[int]:
        """The likeliest labels (Viterbi); ties go to 0."""
        if not scores:
            return []
        (s00, s01), (s10, s11) = self.step
        no, yes = self.start[0], self.start[1] + scores[0]
        came: list[tuple[int, int]] = []
        for s in scores[1:]:
            a, b = (no + s00, 0) if no + s00 >= yes + s10 else (yes + s10, 1)
            c, d = (no + s01, 0) if no + s01 >= yes + s11 else (yes + s11, 1)
            came.append((b, d))
            no, yes = a, c + s
        out = [int(yes > no)]
        for back in reversed(came):
            out.append(back[out[-1]])
        return out[::-1]

    def main_text(self, html: str | None) -> str:
        page = blocks(html, known=self.weights)
        return "\n".join(b.text for b, y in zip(page, self.decode(self.scores(page)), strict=True) if y)


class Labelled:
    """Labelled pages as arrays: the features of each block and its label, -1 beyond a page's end."""

    def __init__(self, pages: Sequence[str]):
        seen = [p for h in pages if (p := blocks(h, marks=True))]
        found = [features(p) for p in seen]
        self.names = {f: i for i, f in enumerate(sorted({f for p in found for b in p for f in b}))}
        self.n, self.longest = len(seen), max(map(len, seen))
        self.y = np.full((self.n, self.longest), -1)
        rows, cols = [], []
        for i, p in enumerate(seen):
            for k, b in enumerate(p):
                self.y[i, k] = int(b.mark == "1")
                rows += [i * self.longest + k] * len(found[i][k])
                cols += [self.names[f] for f in found[i][k]]
        self.rows, self.cols = np.array(rows), np.array(cols)

    def slopes(self, w: np.ndarray, trans: np.ndarray, start: np.ndarray, ridge: float) -> tuple[float, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Log likelihood of the labels less the ridge's penalty, and its slopes, by the forward-backward recursion."""
        n, longest, y = self.n, self.longest, self.y
        there = y >= 0
        e = np.zeros((n, longest, 2))
        e[:, :, 1] = np.bincount(self.rows, w[self.cols], n * longest).reshape(n, longest)
        ahead = np.zeros((n, longest, 2))
        ahead[:, 0] = start + e[:, 0]
        for k in range(1, longest):
            both = ahead[:, k - 1, :, None] + trans
            ahead[:, k] = np.where(there[:, k, None], np.logaddexp(both[:, 0], both[:, 1]) + e[:, k], ahead[:, k - 1])
        total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
        behind = np.zeros((n, longest, 2))
        pairs = np.zeros((2, 2))
        for k in range(longest - 2, -1, -1):
            after = e[:, k + 1] + behind[:, k + 1]
            both = trans + after[:, None, :]
            behind[:, k] = np.where(there[:, k + 1, None], np.logaddexp(both[:, :, 0], both[:, :, 1]), behind[:, k + 1])
            p = np.exp(ahead[:, k, :, None] + both - total[:, None, None])
            pairs += (p * there[:, k + 1, None, None]).sum(axis=0)
        chance = np.exp(ahead + behind - total[:, None, None])[:, :, 1] * there
        off = ((y == 1) - chance) * there
        seen_pairs, later = np.zeros((2, 2)), there[:, 1:]
        np.add.at(seen_pairs, (y[:, :-1][later], y[:, 1:][later]), 1)
        starts, p0 = np.bincount(y[:, 0], minlength=2), chance[:, 0].sum()
        likelihood = (e[:, :, 1] * (y == 1)).sum() + (seen_pairs * trans).sum() + starts @ start - total.sum() - ridge / 2 * ((w**2).sum() + (trans**2).sum() + (start**2).sum())
        slopes = np.bincount(self.cols, off.ravel()[self.rows], len(self.names)) - ridge * w, seen_pairs - pairs - ridge * trans, starts - np.array([n - p0, p0]) - ridge * start
        return float(likelihood), slopes


def fit(pages: Sequence[str], ridge: float = 1.0, rounds: int = 120) -> Crf:
    """Weights of most likelihood on labelled pages (see ``html_labelled``), by gradient steps with momentum."""
    seen = Labelled(pages)
    found = np.zeros(len(seen.names)), np.zeros((2, 2)), np.zeros(2)
    rates, speeds = ([np.zeros_like(v) for v in found] for _ in range(2))
    for t in range(1, rounds + 1):
        _, slopes = seen.slopes(*found, ridge)
        for v, g, m, r in zip(found, slopes, speeds, rates, strict=True):
            m += 0.1 * (g - m)
            r += 0.01 * (g * g - r)
            v += 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(r / (1 - 0.99**t)) + 1e-6)
    w, trans, start = found
    return Crf({f: float(w[i]) for f, i in seen.names.items()}, tuple(tuple(map(float, r)) for r in trans), tuple(map(float, start)))


@cache
def default_model(pages: int = TRAIN_PAGES, seed: int = 5) -> Crf:
    return fit(labelled_pages(pages, seed))


def main_text(model: Crf, html: Column) -> Column:
    """The main text of a page as a column; null pages give an empty text."""

    @F.pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series([model.main_text(h) for h in pages], dtype=object)

    return extract(html)


def extract_pages(pages: DataFrame, model: Crf | None = None, html: str = "html", page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row.

    The blocks of main text in page order, one to a line. Null, empty and broken pages, and
    pages without main text, give an empty text. Repeated rows and null ids give a row each;
    other columns are ignored; an empty table gives an empty result.
    """
    out = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), main_text(model or default_model(), F.col(html)).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
