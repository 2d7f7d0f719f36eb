"""Language-model scores by context-tree weighting over binary-decomposed bytes.

Model. A byte is eight binary decisions; each decision, given the bits before it in its byte,
has a tree of contexts: the last 0, 1, ... ``DEPTH`` bytes. A node has a Krichevsky-Trofimov
estimate from its own counts, and its weighted probability is half that of its own counts and
half the product of its children's. From these block probabilities follows how much the node
trusts itself over the child on the path, so a prediction mixes the estimates of all depths.
A path ends at the deepest context that training has seen.

Training counts words and (DEPTH + 1)-grams of bytes in the tasks, sums them in one
aggregation, and folds the tree level by level with DataFrame functions, then goes down again
from the root, so that each node knows what a path that ends there predicts. All nodes stay in
tables, and so do the probabilities of all grams seen. The most frequent grams, at most
``GRAMS``, are broadcast, which bounds their size whatever the corpus; the rest of a document's
grams meet their probabilities in a join, and grams that training has not seen meet the nodes
of their paths.

Beside it stands a smoothed unigram model of words. Its most frequent words are broadcast, at
most ``FREQUENT``; the rest of a document's words meet their counts in a join.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.llm._common import cut, field

DEPTH = 5
GRAMS = 1 << 21
FREQUENT = 1 << 18
#: Bytes handled at once.
CHUNK = 1 << 22
_WORD, _GRAM, _TEXTS = 0, 1, 2
_SPACE = re.compile(rb"[ \t-\r]")


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return (text or "").encode().lower().split()


def parts_of(text: str | None, chunk: int | None = None) -> Iterator[tuple[bytes, list[bytes], bytes]]:
    """The words of a text in parts of about ``chunk`` bytes, with what stands before and after them.

    Before are the ``DEPTH`` bytes ahead of the part, line ends at the start of a text; after it a
    space, or the line end that ends a text. The parts' bytes, one after the other, are the words
    joined by single spaces and the end.
    """
    body, at, before = (text or "").encode().lower().rstrip(), 0, b"\n" * DEPTH
    chunk = CHUNK if chunk is None else chunk
    while len(body) - at > chunk and (gap := _SPACE.search(body, at + chunk)):
        words, at = body[at : gap.start()].split(), gap.end()
        if words:
            yield before, words, b" "
            before = (before + b" ".join(words[-DEPTH:]) + b" ")[-DEPTH:]
    yield before, body[at:].split(), b"\n"


def grams(texts: list[bytes], depth: int = DEPTH, before: bytes | None = None, after: bytes = b"\n") -> tuple[np.ndarray, np.ndarray]:
    """The byte and the ``depth`` before it, as one number, for each byte and the end of each text; where each text begins.

    Before a text stand line ends, and one ends it, unless ``before`` and ``after`` say else.
    """
    pad = b"\n" * depth if before is None else before
    a = np.frombuffer(b"".join(pad + t + after for t in texts), np.uint8).astype(np.int64)
    code = _joined(a, depth + 1)
    sizes = np.fromiter((len(t) + len(after) for t in texts), np.int64, len(texts))
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
    keep = np.ones(len(code), bool)
    ends = np.cumsum(sizes + depth)[:-1] - depth
    for k in range(depth):
        keep[ends + k] = False
    return code[keep], starts


def _joined(a: np.ndarray, n: int) -> np.ndarray:
    """n bytes in a row as one number, for each place: from the numbers of their halves."""
    if n == 1:
        return a
    left = _joined(a, n - n // 2)
    right = left if n % 2 == 0 else _joined(a, n // 2)
    size = len(a) - n + 1
    code = left[:size] << (8 * (n // 2))
    code |= right[n - n // 2 : n - n // 2 + size]
    return code


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind, key, n of a task's texts: hashed words, grams, and the number of texts."""
    words: Counter[bytes] = Counter()
    seen: list[tuple[np.ndarray, np.ndarray]] = []
    texts = 0

    def rows(kind: int, keys, counts) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys, pa.int64()), pa.array(counts, pa.int64())], names=["kind", "key", "n"])

    def merged() -> tuple[np.ndarray, np.ndarray]:
        keys, at = np.unique(np.concatenate([k for k, _ in seen]), return_inverse=True)
        return keys, np.bincount(at, np.concatenate([n for _, n in seen])).astype(np.int64)

    def word_rows() -> pa.RecordBatch:
        keys = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)).view(np.int64)
        return rows(_WORD, keys, np.fromiter(words.values(), np.int64, len(words)))

    waiting: list[bytes] = []

    def add(*more) -> None:
        nonlocal seen
        seen.append(np.unique(grams(*more)[0], return_counts=True))
        if sum(len(k) for k, _ in seen) > 1 << 21:
            seen = [merged()]

    size = 0
    for batch in batches:
        for body in batch.column(0):
            texts += 1
            for before, w, after in parts_of(body.as_py()):
                words.update(w)
                part = b" ".join(w)
                if after == b"\n" and len(part) < CHUNK and before == b"\n" * DEPTH:
                    waiting.append(part)
                    size += len(part) + 1
                else:
                    add([part], DEPTH, before, after)
                if size >= CHUNK:
                    add(waiting)
                    waiting, size = [], 0
                if len(words) > 1 << 19:
                    yield word_rows()
                    words.clear()
    if waiting:
        add(waiting)
    if words:
        yield word_rows()
    if seen:
        yield rows(_GRAM, *merged())
    yield rows(_TEXTS, [0], [texts])


def _log_gamma(x: Column) -> Column:
    """log Gamma for x > 0: Stirling's series at x + 7, and the way back."""
    y = x + 7.0
    way = x
    for k in range(1, 7):
        way = way * (x + float(k))
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) - F.log(way)


def _decisions(key: Column) -> Column:
    """The eight decisions of a gram's last byte: the bits before, after a 1, and the bit."""
    byte = key.bitwiseAND(255)
    return F.array(
        *(
            F.struct(F.shiftright(byte, 8 - j).bitwiseOR(1 << j).alias("bits"), F.shiftright(byte, 7 - j).bitwiseAND(1).alias("bit"))
            for j in range(8)
        )
    )


def _last(context: Column, k: int) -> Column:
    return context.bitwiseAND((1 << (8 * k)) - 1)


def tree(counts: DataFrame, depth: int = DEPTH) -> list[DataFrame]:
    """The nodes of each depth from 0, from rows (key, n) of grams.

    context, bits; n0, n1; mixed, the probability of a 1 where a path ends at the node; sure and
    open, what the path to it has settled of this and the weight that it leaves to the nodes below.
    """
    n = F.col("n")
    rows = counts.select(F.shiftright("key", 8).alias("context"), "n", F.inline(_decisions(F.col("key"))))
    level = rows.groupBy("context", "bits").agg(F.sum(F.when(F.col("bit") == 0, n).otherwise(0)).alias("n0"), F.sum(F.when(F.col("bit") == 1, n).otherwise(0)).alias("n1"))
    n0, n1 = F.col("n0").cast("double"), F.col("n1").cast("double")
    own = _log_gamma(n0 + 0.5) + _log_gamma(n1 + 0.5) - _log_gamma(n0 + n1 + 1.0) - math.log(math.pi)
    level = level.withColumns({"own": own, "below": F.lit(None).cast("double")})
    levels = []
    for k in range(depth, -1, -1):
        if k < depth:
            level = level.groupBy(_last(F.col("context"), k).alias("context"), "bits").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("weighted").alias("below"))
            level = level.withColumn("own", own)
        both = F.greatest("own", "below") + F.log1p(F.exp(-F.abs(F.col("own") - F.col("below")))) - math.log(2)
        level = cut(level.withColumn("weighted", F.coalesce(both, F.col("own"))), f"ctw-{k}")
        levels.insert(0, level)
    trust = F.when(F.col("below").isNull(), 1.0).otherwise(1 / (1 + F.exp(F.least(F.lit(700.0), F.col("below") - F.col("own")))))
    p, sure, left = (n1 + 0.5) / (n0 + n1 + 1.0), F.col("sure"), F.col("open")
    for k, level in enumerate(levels):
        if k:
            above = _few(levels[k - 1].select(F.col("context").alias("up"), "bits", "sure", "open"), k - 1)
            level = level.withColumn("up", _last(F.col("context"), k - 1)).join(above, ["up", "bits"])
        else:
            level = level.withColumns({"sure": F.lit(0.0), "open": F.lit(1.0)})
        said = [(sure + left * p).alias("mixed"), (sure + left * trust * p).alias("sure"), (left * (1 - trust)).alias("open")]
        levels[k] = cut(level.select("context", "bits", "n0", "n1", *said), f"ctw-down-{k}")
    return levels


def _few(nodes: DataFrame, k: int) -> DataFrame:
    """Nodes of depth k for a join: at most 256^k contexts, which are broadcast where this is few."""
    return F.broadcast(nodes) if k < 2 else nodes


def _gram_logs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, n and log10 probability of the grams seen, from deepest contexts with their nodes, ascending by bits."""
    for batch in batches:
        context, nodes = batch.column(0).to_numpy(), batch.column(1)
        row = np.repeat(np.arange(len(context)), nodes.value_lengths().to_numpy(zero_copy_only=False))
        bits, mixed, *n = (nodes.flatten().field(f).to_numpy(zero_copy_only=False) for f in ("bits", "mixed", "n0", "n1"))
        keys = row << 8 | bits
        ends = [np.flatnonzero((bits >= 128) & (n[bit] > 0)) for bit in (0, 1)]
        at = np.concatenate(ends)
        byte = np.concatenate([(bits[e] << 1 | bit) & 255 for bit, e in enumerate(ends)])
        logs = np.zeros(len(at))
        for j in range(8):
            p = mixed[np.searchsorted(keys, row[at] << 8 | byte >> (8 - j) | 1 << j)]
            logs += np.log10(np.where(byte >> (7 - j) & 1, p, 1 - p))
        times = np.concatenate([n[bit][e] for bit, e in enumerate(ends)])
        yield pa.RecordBatch.from_arrays([pa.array(context[row[at]] << 8 | byte), pa.array(times), pa.array(logs)], names=["key", "n", "log"])


@dataclass
class Model:
    #: frequent grams, ascending, and their log10 probabilities
    keys: np.ndarray
    logs: np.ndarray
    #: hashes of frequent words, ascending, and their counts
    words: np.ndarray
    counts: np.ndarray
    train_tokens: int
    distinct: int
    texts: int
    depth: int = DEPTH
    name: str = ""
    #: (key, n, log) of all grams seen, and the nodes of each depth; these stay on the driver's side
    grams: DataFrame | None = None
    levels: list[DataFrame] | None = None

    def norm(self) -> float:
        return self.train_tokens + 0.5 * (self.distinct + 1)

    def logs_of(self, keys: DataFrame) -> DataFrame:
        """(key, log): log10 probability of the last byte of each gram after the others, for distinct keys."""
        met = cut(keys.join(self.grams.select("key", "log"), "key", "left"), "ctw-met")
        rows = met.where("log is null").select("key", F.inline(_decisions(F.col("key"))))
        for k in range(self.depth, -1, -1):
            nodes = self.levels[k].select((F.col("context") * 256 + F.col("bits")).alias("node"), F.col("mixed").alias(f"mixed{k}"))
            rows = rows.withColumn("node", _last(F.shiftright("key", 8), k) * 256 + F.col("bits")).join(_few(nodes, k), "node", "left").drop("node")
        mixed = F.coalesce(*(f"mixed{k}" for k in range(self.depth, -1, -1)), F.lit(0.5))
        unseen = rows.groupBy("key").agg(F.sum(F.log10(F.when(F.col("bit") == 1, mixed).otherwise(1 - mixed))).alias("log"))
        return met.where("log is not null").unionByName(unseen)

    def log10_of(self, codes: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each gram after the others."""
        kinds, place = np.unique(codes, return_inverse=True)
        keys = self.grams.sparkSession.createDataFrame([(int(k),) for k in kinds], "key long")
        return self.logs_of(keys).toArrow().sort_by("key")["log"].to_numpy()[place]

    def frequent(self, codes: np.ndarray) -> np.ndarray:
        """The same for frequent grams, nan for others."""
        if not len(self.keys):
            return np.full(len(codes), np.nan)
        at = np.minimum(np.searchsorted(self.keys, codes), len(self.keys) - 1)
        return np.where(self.keys[at] == codes, self.logs[at], np.nan)

    def scores(self, texts: list[bytes], memo: Memo, before: bytes | None = None, after: bytes = b"\n") -> tuple[np.ndarray, pa.Array]:
        """For each text (words joined by one space) with its end: log10 probability of its frequent grams, and key and times of the others."""
        codes, starts = grams(texts, self.depth, before, after)
        at = memo.place(codes)
        logs = memo.logs[at]
        new = memo.keys[at] != codes
        if new.any():
            kinds, place = np.unique(codes[new], return_inverse=True)
            found = self.frequent(kinds)
            logs[new] = found[place]
            memo.put(kinds, found)
        odd = np.flatnonzero(np.isnan(logs))
        logs[odd] = 0.0
        text, key = np.searchsorted(starts, odd, "right") - 1, codes[odd]
        order = np.lexsort((key, text))
        text, key = text[order], key[order]
        first = np.flatnonzero(np.concatenate(([True], (text[1:] != text[:-1]) | (key[1:] != key[:-1])))[: len(key)])
        times = np.diff(np.append(first, len(key)))
        offsets = np.searchsorted(text[first], np.arange(len(texts) + 1)).astype(np.int32)
        rows = pa.StructArray.from_arrays([pa.array(key[first]), pa.array(times.astype(np.int64))], names=["key", "times"])
        return np.add.reduceat(logs, starts), pa.ListArray.from_arrays(pa.array(offsets), rows)


class Memo:
    """Probabilities of grams that a worker met lately, a place for each."""

    def __init__(self, places: int = 1 << 21):
        self.keys, self.logs = np.full(places, -1, np.int64), np.zeros(places)
        self.shift = np.uint64(65 - places.bit_length())

    def place(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).view(np.int64)

    def put(self, keys: np.ndarray, logs: np.ndarray) -> None:
        at = self.place(keys)
        self.keys[at] = keys
        stays = self.keys[at] == keys  # of several for one place the last
        self.logs[at[stays]] = logs[stays]


def learn(rows: DataFrame, text: str = "text") -> tuple[Model, DataFrame]:
    """The model of all texts of ``rows`` (null: empty), and the counts (key, n) of all words."""
    counts = rows.select(F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(_count, "kind int, key long, n long")
    counts = cut(counts.groupBy("kind", "key").agg(F.sum("n").alias("n")), "ctw-counts")
    words = counts.where(F.col("kind") == _WORD).select("key", "n")
    total = words.agg(F.count("*").alias("distinct"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    texts = counts.where(F.col("kind") == _TEXTS).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    levels = tree(counts.where(F.col("kind") == _GRAM).select("key", "n"))
    nodes = levels[DEPTH].groupBy("context").agg(F.sort_array(F.collect_list(F.struct("bits", "mixed", "n0", "n1"))).alias("nodes"))
    seen = cut(nodes.mapInArrow(_gram_logs, "key long, n long, log double"), "ctw-grams")
    best = seen.where(_size("n") >= _least_size(seen, GRAMS)).select("key", "log").toArrow().sort_by("key")
    often = words.where(_size("n") >= _least_size(words, FREQUENT)).toArrow().sort_by("key")
    model = Model(best["key"].to_numpy(), best["log"].to_numpy(), often["key"].to_numpy(), often["n"].to_numpy(), total["n"] + texts, total["distinct"] + (texts > 0), texts, name=uuid.uuid4().hex, grams=seen, levels=levels)
    return model, words


def _size(n: str) -> Column:
    """A class of like counts."""
    return F.floor(F.log2(n) * 16)


def _least_size(counted: DataFrame, most: int) -> int:
    """The least class of counts from which on there are no more than ``most`` rows."""
    total, least = 0, 1 << 20
    for r in counted.groupBy(_size("n").alias("size")).count().orderBy(F.desc("size")).collect():
        total += r["count"]
        if total > most:
            break
        least = r["size"]
    return least


class _Known(dict):
    """Word -> log10 of its share if it is frequent, else nan."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.logs = model, np.log10((model.counts + 0.5) / model.norm())

    def __missing__(self, word: bytes) -> float:
        h = xxhash.xxh64_intdigest(word)
        h -= (h >> 63) << 64
        at = int(np.searchsorted(self.model.words, h))
        value = float(self.logs[at]) if at < len(self.logs) and self.model.words[at] == h else math.nan
        if len(word) <= 64:
            if len(self) >= 1 << 19:
                self.clear()
            self[word] = value
        return value


_kept: dict[str, tuple[_Known, Memo]] = {}


def score(docs: DataFrame, model: Model, words: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Scores of every row under a model and its word counts.

    doc_id; n_tokens, its words and one end; n_known, those seen in training; train_tokens;
    base_score, log10 probability under the unigram model; score, log10 probability of the
    words, joined by single spaces, and the end under context-tree weighting; n_bytes of these;
    bits_per_byte, its code length.

    Null texts count as empty: an end alone. Repeated rows and null ids give a row each; other
    columns are ignored; an empty table gives an empty result; a model of no texts gives every
    bit a half.
    """
    sent = docs.sparkSession.sparkContext.broadcast(replace(model, grams=None, levels=None))
    schema = T.StructType(
        [
            field(docs, doc_id, "doc_id"),
            T.StructField("row", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("known", T.LongType()),
            T.StructField("base", T.DoubleType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("rare", T.ArrayType(T.LongType())),
            T.StructField("grams", T.ArrayType(T.StructType([T.StructField("key", T.LongType()), T.StructField("times", T.LongType())]))),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        if m.name not in _kept:  # one model at a time, over all tasks of a worker
            _kept.clear()
            _kept[m.name] = _Known(m), Memo()
        (known, memo), row = _kept[m.name], TaskContext.get().partitionId() << 33
        end = math.log10(((m.texts or 0) + 0.5) / m.norm())

        def looked_up(words: list[bytes]) -> tuple[float, int, np.ndarray]:
            """Base score of the frequent words, their number, and hashes of the others."""
            logs = np.fromiter(map(known.__getitem__, words), np.float64, len(words))
            odd = np.flatnonzero(np.isnan(logs))
            return np.nansum(logs), len(words) - len(odd), np.fromiter((xxhash.xxh64_intdigest(words[j]) for j in odd), np.uint64, len(odd)).view(np.int64)

        def made(ids, row, tokens, seen, base, scores, sizes, rare, odd) -> pa.RecordBatch:
            columns = [ids, pa.array(np.arange(row, row + len(ids))), pa.array(tokens, pa.int64()), pa.array(seen, pa.int64()), pa.array(base, pa.float64()), pa.array(scores, pa.float64()), pa.array(sizes, pa.int64())]
            return pa.RecordBatch.from_arrays([*columns, pa.array(rare, pa.list_(pa.int64())), odd], names=schema.names)

        def together(ids, row, waiting: list[list[bytes]]) -> pa.RecordBatch:
            base, seen, rare = zip(*map(looked_up, waiting), strict=True)
            texts = [b" ".join(ws) for ws in waiting]
            scores, odd = m.scores(texts, memo)
            return made(ids, row, [len(ws) + 1 for ws in waiting], [n + (m.texts > 0) for n in seen], [b + end for b in base], scores, [len(t) + 1 for t in texts], rare, odd)

        def by_parts(one, row, text: str) -> pa.RecordBatch:
            """A long text: what its parts say, added up."""
            tokens, seen, base, total, size, rare, odd = 1, m.texts > 0, end, 0.0, 0, [], []
            for before, ws, after in parts_of(text, CHUNK):
                b, n, h = looked_up(ws)
                part = b" ".join(ws)
                s, o = m.scores([part], memo, before, after)
                tokens, seen, base, total, size = tokens + len(ws), seen + n, base + b, total + float(s[0]), size + len(part) + len(after)
                rare.append(h)
                odd.append(o.flatten())
            return made(one, row, [tokens], [int(seen)], [base], [total], [size], [np.concatenate(rare)], pa.ListArray.from_arrays(pa.array([0, sum(map(len, odd))], pa.int32()), pa.concat_arrays(odd)))

        for batch in batches:
            ids, bodies = batch.column(0), batch.column(1)
            at, waiting, size = 0, [], 0
            for i in range(len(bodies)):
                text = bodies[i].as_py()
                long = text is not None and len(text) > CHUNK
                if (long or size >= CHUNK) and waiting:
                    yield together(ids.slice(at, len(waiting)), row, waiting)
                    row, at, waiting, size = row + len(waiting), at + len(waiting), [], 0
                if long:
                    yield by_parts(ids.slice(i, 1), row, text)
                    row, at = row + 1, i + 1
                    continue
                waiting.append(words_of(text))
                size += len(text or "")
            if waiting:
                yield together(ids.slice(at), row, waiting)
                row += len(waiting)

    rows = cut(docs.select(doc_id, text).mapInArrow(run, schema), "ctw-scores")
    met = rows.select("row", F.explode("rare").alias("key")).groupBy("row", "key").agg(F.count("*").alias("times"))
    met = met.join(words, "key", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + 0.5) / model.norm())).alias("rest"),
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("found"),
    )
    odd = rows.select("row", F.inline("grams"))
    odd = odd.join(model.logs_of(odd.select("key").distinct()), "key").groupBy("row").agg(F.sum(F.col("times") * F.col("log")).alias("deep"))
    out = rows.drop("rare", "grams").join(met, "row", "left").join(odd, "row", "left")
    out = out.withColumn("score", F.col("score") + F.coalesce("deep", F.lit(0.0)))
    return out.select(
        "doc_id",
        "n_tokens",
        (F.col("known") + F.coalesce("found", F.lit(0))).alias("n_known"),
        F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest", F.lit(0.0))).alias("base_score"),
        "score",
        "n_bytes",
        (-F.col("score") * math.log2(10) / F.col("n_bytes")).alias("bits_per_byte"),
    )
