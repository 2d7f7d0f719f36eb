"""What rows of a batch have in common with each member of a bounded set, counted at once in a task."""

from __future__ import annotations

import numpy as np

#: Features of the most members, which meet by a product of matrices; the others meet one by one.
COMMONEST = 256


class Members:
    """Which of n members have each feature; features are numbered by falling number of members."""

    def __init__(self, of: list[list[int]], n: int):
        self.n = n
        self.dense = np.zeros((min(len(of), COMMONEST), n), np.float32)
        for at, row in zip(of, self.dense, strict=False):
            np.add.at(row, at, 1)
        rest = of[COMMONEST:]
        self.starts = np.cumsum([0, *map(len, rest)])
        self.members = np.array([k for at in rest for k in at], np.int64)

    def sums(self, n: int, row: np.ndarray, feature: np.ndarray, values: list[np.ndarray]) -> list[np.ndarray]:
        """For each of n rows and each member the sum of each of the values of the features that both have."""
        often = feature < len(self.dense)
        f = feature[~often] - COMMONEST
        times = self.starts[f + 1] - self.starts[f] if len(f) else np.empty(0, np.int64)
        first = np.repeat(self.starts[f], times) if len(f) else times
        place = np.arange(len(first)) - np.repeat(np.cumsum(times) - times, times)
        pair = np.repeat(row[~often], times) * self.n + self.members[first + place]
        out = []
        for v in values:
            m = np.zeros((n, len(self.dense)), np.float32)
            m[row[often], feature[often]] = v[often]
            total = np.bincount(pair, np.repeat(v[~often], times), n * self.n).reshape(n, self.n)
            out.append((m @ self.dense).astype(np.int64) + total.astype(np.int64))
        return out
