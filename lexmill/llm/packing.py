"""Packing documents into fixed windows by order-preserving dynamic programming.

Each task reads its documents in order, encodes them and lays the ids end to end. Where a
window may end is a set of cut positions: the end of a document costs nothing, the end of a
sentence a small truncation penalty. Only where more than ``stretch`` ids have neither, a window
may also end within, at every ``stride`` ids, for as large a penalty as so much padding; so a
window breaks a sentence only where else it would stay emptier than that. The program chooses
the cuts that minimise padding plus penalties:

    best[j] = penalty[j] + min over i with pos[j] - pos[i] <= window of best[i] + padding(i, j)

As the padding is ``window - (pos[j] - pos[i])``, the minimum is that of ``best[i] + pos[i]``
over a sliding range of positions, which a monotone queue yields in constant time. Lengths
that are a power of two need no padding and are tried as transitions of their own.

The stream is solved run by run; the last window of a run opens the next one, so a task pads
only at its end. Nothing is shuffled and no task holds more than one run and one batch.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lexmill.llm._common import field
from lexmill.llm.tokens import encoder

#: Ids solved at once.
RUN = 1 << 19


def cuts(ids: np.ndarray, ends: np.ndarray, opens: np.ndarray, stretch: int, stride: int, sentence: float, hard: float) -> tuple[np.ndarray, np.ndarray]:
    """Cut positions inside and at the end of one document, and their penalties."""
    n = len(ids)
    at = np.flatnonzero(ends[ids[:-1]] & opens[ids[1:]]) + 1
    edges = np.concatenate(([0], at, [n]))
    if (wide := np.flatnonzero(np.diff(edges) > stretch)).size:
        more = np.concatenate([np.arange(edges[k] + stride, edges[k + 1], stride) for k in wide])
    else:
        more = np.empty(0, np.int64)
    pos = np.concatenate((at, more, [n]))
    pen = np.concatenate((np.full(len(at), sentence), np.full(len(more), hard), [0.0]))
    order = np.argsort(pos, kind="stable")
    return pos[order], pen[order]


def solve(pos: list[int], pen: list[float], window: int, shortest: int = 256) -> list[int]:
    """Positions of the cuts that cost least, the last position included.

    ``pos`` ascends, its gaps are at most ``window``, the start 0 is implied.
    """
    pos, pen = [0, *pos], [0.0, *pen]
    powers = [p for k in range(window.bit_length()) if shortest <= (p := 1 << k) < window]
    best, back, at = [0.0] * len(pos), [0] * len(pos), {0: 0}
    queue = deque([(0.0, 0)])  # best[i] + pos[i], ascending
    for j in range(1, len(pos)):
        p = pos[j]
        while pos[queue[0][1]] < p - window:
            queue.popleft()
        key, i = queue[0]
        cost = key + window - p
        for w in powers:
            k = at.get(p - w)
            if k is not None and best[k] < cost:
                cost, i = best[k], k
        best[j], back[j] = cost + pen[j], i
        at[p] = j
        key = best[j] + p
        while queue and queue[-1][0] > key:
            queue.pop()
        queue.append((key, j))
    out, j = [], len(pos) - 1
    while j:
        out.append(pos[j])
        j = back[j]
    return out[::-1]


class _Stream:
    """The ids of one task, laid end to end; windows are taken off the front."""

    def __init__(self, window: int, first_sequence: int):
        self.window, self.sequence = window, first_sequence
        self.docs: list[tuple] = []  # (doc_id, ids, offset in the document, its length)
        self.pos: list[np.ndarray] = []
        self.pen: list[np.ndarray] = []
        self.n = 0

    def add(self, doc_id, ids: np.ndarray, pos: np.ndarray, pen: np.ndarray) -> None:
        self.docs.append((doc_id, ids, 0, len(ids)))
        self.pos.append(pos + self.n)
        self.pen.append(pen)
        self.n += len(ids)

    def take(self, last: bool) -> list[tuple]:
        """Pieces of all windows but, unless ``last``, the one that ends the run."""
        if not self.n:
            return []
        pos, pen = np.concatenate(self.pos), np.concatenate(self.pen)
        found = solve(pos.tolist(), pen.tolist(), self.window)
        if not last:
            found.pop()
        out, start, docs = [], 0, deque(self.docs)
        for end in found:
            offset = 0
            while start < end:
                doc_id, ids, skipped, total = docs.popleft()
                size = min(len(ids), end - start)
                out.append((doc_id, skipped, size, ids[:size].tobytes(), total, self.sequence, offset))
                if size < len(ids):
                    docs.appendleft((doc_id, ids[size:], skipped + size, total))
                start, offset = start + size, offset + size
            self.sequence += 1
        left = pos > start
        self.docs, self.pos, self.pen, self.n = list(docs), [pos[left] - start], [pen[left]], self.n - start
        return out


def pack(
    docs: DataFrame,
    tokenizer: str,
    window: int = 2048,
    end_id: int | None = 1,
    sentence_penalty: float = 1.0,
    hard_penalty: float = 128.0,
    stretch: int = 128,
    stride: int = 16,
    text: str = "text",
    doc_id: str = "doc_id",
) -> DataFrame:
    """One row for each piece of a document in a window.

    doc_id; start, the document's ids before the piece; length; ids, little-endian unsigned
    32-bit; doc_tokens, the document's ids in all; sequence_id; offset, the piece's place in
    the window. A window is shorter than ``window`` only where padding fills it or where its
    length is a power of two.

    Null texts count as empty: such a document is its end id alone, or without an end id gives
    no row. Repeated rows are packed each. Other columns are ignored.
    Windows follow the order in which a task reads its rows.
    """
    schema = T.StructType(
        [
            field(docs, doc_id, "doc_id"),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids", T.BinaryType()),
            T.StructField("doc_tokens", T.LongType()),
            T.StructField("sequence_id", T.LongType()),
            T.StructField("offset", T.LongType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        ends, opens = np.zeros(max(enc.size, (end_id or 0) + 1), bool), np.zeros(max(enc.size, (end_id or 0) + 1), bool)
        for i in range(enc.size):
            s = enc.piece(i)
            ends[i] = s.rstrip(" \"')]")[-1:] in set(".!?…。！？\n") and bool(s)
            opens[i] = s[:1].isspace()
        ends |= np.array([i < enc.size and "\n" in enc.piece(i) for i in range(len(ends))])
        tail = np.array([] if end_id is None else [end_id], "<u4")
        stream = _Stream(window, TaskContext.get().partitionId() << 33)
        types = None

        def rows(found: list[tuple]) -> Iterator[pa.RecordBatch]:
            for k in range(0, len(found), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found[k : k + 4096]), types, strict=True)], names=schema.names)

        for batch in batches:
            types = types or [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                body = body.as_py()
                ids = np.concatenate((enc.array(body), tail)).astype("<u4", copy=False) if body else tail
                if not len(ids):
                    continue
                stream.add(key, ids, *cuts(ids, ends, opens, min(stretch, window), stride, sentence_penalty, hard_penalty))
                if stream.n >= RUN:
                    yield from rows(stream.take(False))
        yield from rows(stream.take(True))

    return docs.select(doc_id, text).mapInArrow(run, schema)
