"""Exact top-k search by BM25 over a sharded inverted index with block-max WAND.

Index. Each task turns its rows into shards of at most ``SHARD`` documents and about ``POSTINGS``
postings. Within a shard, documents lie in order of their most frequent term and of their length,
so that neighbours are alike; postings by term are cut into blocks of ``BLOCK`` documents, each
with its greatest impact. Document frequencies, the number of documents and their mean length are
summed over all shards, so every shard scores with global statistics.

Search. The WAND bound of a block of documents is the sum over the query's frequent terms of weight
times the greatest impact in the block, and the best that its other terms give one of the block's
documents. Blocks are taken in falling order of their bounds, in ``WAVES``; their documents are
scored whole, and the k-th best score so far is the threshold that the next blocks' bounds must
reach. A block that stays below it is never scored. ``BATCH`` queries go together: the impacts of a
shard's frequent terms in a block are a matrix of float32, and a product with the weights of the
queries that the block is live for scores it for all of them. The error of such sums has a bound
(all are of positive numbers), which widens every comparison; what may be among the best k is then
scored in double precision from its own terms. So each shard's top k is exact, and so is their
merge. Scores are rounded to six digits, so that equal documents tie; a tie goes to the smaller id
within a shard already, and no shard gives a query more than k hits.

Queries reach the shards in blocks of at most ``SENT`` bytes, each broadcast in turn.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.llm._common import cut

K1, B = 1.2, 0.75
SHARD, POSTINGS = 1 << 14, 1 << 22
BLOCK = 64
#: Blocks that are scored before the threshold is looked at again: so many first, then all that are left.
WAVES = (8, 64)
#: A score this much below another may be equal to it when both are rounded.
SLACK = 1.000001e-6
SENT = 32 << 20
#: Terms that one in so many documents of a shard have, so many at most, are frequent: columns of its matrices.
FREQUENT, COLUMNS = 32, 512
#: Queries that are scored together, and documents whose terms are looked at together.
BATCH, EXACT = 256, 256

_SPACES = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 65 <= c <= 90 and c + 32 or 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of all other than ASCII characters; A-Z in lower case."""
    return (text or "").encode().translate(_SPACES).split()


class _Hashes(dict):
    """Term -> 64-bit hash as a signed number."""

    def __missing__(self, term: bytes) -> int:
        h = xxhash.xxh64_intdigest(term)
        h -= (h >> 63) << 64
        if len(term) <= 64:
            if len(self) >= 1 << 17:
                self.clear()
            self[term] = h
        return h


def _shard(ids: pa.Array, found: list[tuple[np.ndarray, np.ndarray]], number: int) -> list:
    """A shard's index as one row; like documents become neighbours."""
    common = np.array([t[np.argmax(n)] if len(t) else 0 for t, n in found])
    lens = np.array([n.sum() for _, n in found], np.uint32)
    order = np.lexsort((np.arange(len(found)), lens, common))
    ids, lens, found = ids.take(pa.array(order)), lens[order], [found[k] for k in order]
    sizes = [len(t) for t, _ in found]
    terms, tfs = np.concatenate([t for t, _ in found]), np.concatenate([n for _, n in found])
    docs = np.repeat(np.arange(len(found), dtype=np.uint16), sizes)
    order = np.argsort(terms, kind="stable")  # documents stay in order within a term
    terms, starts = np.unique(terms[order], return_index=True)
    return [number, ids, lens.tobytes(), terms.tobytes(), starts.astype(np.uint32).tobytes(), docs[order].tobytes(), tfs[order].astype(np.uint32).tobytes()]


def index(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """A row for each shard: shard, ids, and the lengths and postings as packed numbers.

    Null and empty texts are documents without terms.
    """
    schema = T.StructType([T.StructField("shard", T.LongType()), T.StructField("ids", T.ArrayType(docs.schema[doc_id].dataType)), *(T.StructField(n, T.BinaryType()) for n in ("lens", "terms", "starts", "docs", "tfs"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, number = _Hashes(), TaskContext.get().partitionId() << 24
        ids, found, kinds, size = [], [], None, 0

        def made() -> pa.RecordBatch:
            row = _shard(pa.concat_arrays(ids), found, number)
            return pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(row[1])], pa.int32()), row[1]), *(pa.array([x], pa.binary()) for x in row[2:])], names=schema.names)

        for batch in batches:
            kinds, bodies, at = batch.column(0), batch.column(1), 0
            for i in range(len(bodies)):
                words = terms_of(bodies[i].as_py())
                terms, counts = np.unique(np.fromiter(map(hashes.__getitem__, words), np.int64, len(words)), return_counts=True)
                found.append((terms, counts.astype(np.uint32)))
                size += len(terms)
                if len(found) == SHARD or size >= POSTINGS:
                    ids.append(kinds.slice(at, i + 1 - at))
                    yield made()
                    ids, found, at, number, size = [], [], i + 1, number + 1, 0
            ids.append(kinds.slice(at))
        if found:
            yield made()

    return docs.select(doc_id, text).mapInArrow(run, schema)


@dataclass
class Shard:
    ids: pa.Array
    terms: np.ndarray
    starts: np.ndarray
    docs: np.ndarray
    impacts: np.ndarray
    #: first posting of each (term, block), its block and greatest impact; first entry of each term: not needed for a search
    entries: np.ndarray | None
    blocks: np.ndarray | None
    tops: np.ndarray | None
    firsts: np.ndarray | None
    #: place of each document in the order of ids, null first
    order: np.ndarray
    #: blocks whose documents were scored, and blocks in all, over all queries
    scored: int = 0
    bounded: int = 0

    def __post_init__(self) -> None:
        n, df = len(self.ids), np.diff(self.starts)
        often = np.flatnonzero(df * FREQUENT >= n)
        often = np.sort(often[np.argsort(-df[often], kind="stable")[:COLUMNS]])
        #: column of each frequent term, -1 for the others
        self.column = np.full(len(df), -1, np.int32)
        self.column[often] = np.arange(len(often))
        size = (n + BLOCK - 1) // BLOCK
        #: impacts of frequent terms by block, column and document of the block, and their greatest by column and block
        self.matrix = np.zeros((size, len(often), BLOCK), np.float32)
        for c, term in enumerate(often):
            p = slice(self.starts[term], self.starts[term + 1])
            self.matrix[self.docs[p] // BLOCK, c, self.docs[p] % BLOCK] = self.impacts[p]
        self.greatest = self.matrix.max(2).T.copy()
        #: postings by document: where each document's begin, their places and terms
        self.begins = np.concatenate([[0], np.cumsum(np.bincount(self.docs, minlength=n))])
        self.postings = np.argsort(self.docs.astype(np.uint16), kind="stable").astype(np.int32)
        self.terms_of = np.repeat(np.arange(len(df), dtype=np.int32), df)[self.postings]
        self.weights = np.zeros(len(df))

    @classmethod
    def of(cls, row: dict, mean: float) -> Shard:
        lens, tfs = np.frombuffer(row["lens"], np.uint32), np.frombuffer(row["tfs"], np.uint32)
        terms, starts = np.frombuffer(row["terms"], np.int64), np.frombuffer(row["starts"], np.uint32).astype(np.int64)
        docs = np.frombuffer(row["docs"], np.uint16).astype(np.int32)
        impacts, below = tfs * (K1 + 1), (K1 * (1 - B + B * lens / max(mean, 1e-9)))[docs]
        below += tfs
        impacts /= below
        order = np.empty(len(lens), np.int64)
        order[pc.array_sort_indices(row["ids"], null_placement="at_start").to_numpy()] = np.arange(len(lens))
        return cls(row["ids"], terms, np.append(starts, len(docs)), docs, impacts, None, None, None, None, order)

    def search(self, queries: list[tuple[int, np.ndarray, np.ndarray]], k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query, documents, scores) of each query."""
        for first in range(0, len(queries), BATCH):
            batch, own = queries[first : first + BATCH], []
            for _, terms, weights in batch:
                at = np.searchsorted(self.terms, terms)
                at[at == len(self.terms)] = 0
                there = self.terms[at] == terms if len(self.terms) else np.zeros(len(terms), bool)
                own.append((at[there], weights[there]))
            for (name, _, _), found in zip(batch, self.top_each(own, k), strict=True):
                yield name, *found

    def top(self, at: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best documents that share a term, best first, and their rounded scores; ``at`` are the places of the query's terms."""
        return self.top_each([(at, weights)], k)[0]

    def top_each(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """``top`` of each of some queries."""
        n, (size, columns, _) = len(self.ids), self.matrix.shape
        frequent = np.zeros((len(queries), columns), np.float32)
        sums = np.zeros((len(queries), size * BLOCK), np.float32)
        for q, (at, w) in enumerate(queries):
            column = self.column[at]
            rare = column < 0
            frequent[q, column[~rare]] = w[~rare]
            p, v = _ranges(self.starts[at[rare]], self.starts[at[rare] + 1], w[rare])
            sums[q] = np.bincount(self.docs[p], self.impacts[p] * v, size * BLOCK)
        of_block = sums.reshape(len(queries), size, BLOCK)
        bounds = frequent @ self.greatest + of_block.max(2)
        error = (np.count_nonzero(frequent, axis=1, keepdims=True) + 16) * 2.0**-23  # of a sum, as a part of it
        place = np.empty(bounds.shape, np.int64)
        np.put_along_axis(place, np.argsort(-bounds, axis=1, kind="stable"), np.arange(size)[None, :], 1)
        done, least, first = np.zeros(bounds.shape, bool), np.zeros(len(queries)), 0
        self.bounded += bounds.size
        for wave in (*WAVES, size):
            live = (place >= first) & (place < first + wave) & (bounds > 0) & (bounds * (1 + error) >= least[:, None] - SLACK)
            if not live.any():
                break
            first += wave
            for b in np.flatnonzero(live.any(0)):
                some = np.flatnonzero(live[:, b])
                of_block[some, b] += frequent[some] @ self.matrix[b]
            done |= live
            self.scored += int(np.count_nonzero(live))
            if n > k:
                for q in np.flatnonzero(live.any(1)):
                    scores = of_block[q, done[q]].ravel()
                    if len(scores) > k:
                        least[q] = np.partition(scores, len(scores) - k)[len(scores) - k] * (1 - error[q, 0])
        return [self._exact(of_block[q], done[q], least[q] - SLACK, error[q, 0], *queries[q], k) for q in range(len(queries))]

    def _exact(self, sums: np.ndarray, done: np.ndarray, least: float, error: float, at: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best of the documents whose sums, known but for an error, may be ``least`` or more."""
        b, i = np.nonzero((sums > 0) & (sums * (1 + error) >= least) & done[:, None])
        hit = b * BLOCK + i
        self.weights[at] = weights
        exact = np.zeros(len(hit))
        for k0 in range(0, len(hit), EXACT):
            some = hit[k0 : k0 + EXACT]
            p, own = _ranges(self.begins[some], self.begins[some + 1], np.arange(len(some)))
            exact[k0 : k0 + EXACT] = np.bincount(own, self.impacts[self.postings[p]] * self.weights[self.terms_of[p]], len(some))
        self.weights[at] = 0.0
        scores = np.floor(exact * 1e6 + 0.5) / 1e6
        best = np.lexsort((self.order[hit], -scores))[:k]
        return hit[best], scores[best]


def _ranges(starts: np.ndarray, stops: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges in order, and the value of the range of each."""
    sizes = stops - starts
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - ends + sizes, sizes), np.repeat(values, sizes)


def _frequencies(shards: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for terms, starts, docs in zip(*(batch.column(i) for i in range(3)), strict=True):
                terms, starts = np.frombuffer(terms.as_py(), np.int64), np.frombuffer(starts.as_py(), np.uint32).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(np.diff(np.append(starts, len(docs.as_py()) // 2)))], names=["term", "df"])

    return shards.select("terms", "starts", "docs").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def _totals(shards: DataFrame) -> tuple[int, int]:
    """Number of documents and of terms in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lens = [np.frombuffer(x.as_py(), np.uint32) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([sum(map(len, lens))], pa.int64()), pa.array([int(sum(x.sum() for x in lens))], pa.int64())], names=["n", "terms"])

    r = shards.select("lens").mapInArrow(run, "n long, terms long").agg(F.sum("n"), F.sum("terms")).first()
    return r[0] or 0, r[1] or 0


def _query_terms(queries: DataFrame, text: str, query_id: str) -> DataFrame:
    @F.pandas_udf("array<long>")
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hashes = _Hashes()
        for texts in batches:
            yield pd.Series([np.unique(np.array([hashes[w] for w in terms_of(t)], np.int64)) for t in texts])

    return queries.select(F.col(query_id).cast("long").alias("query_id"), F.explode(hashed(F.col(text))).alias("term")).distinct()


def top_k(docs: DataFrame, queries: DataFrame, k: int = 10, text: str = "text", doc_id: str = "doc_id", query_text: str = "text", query_id: str = "query_id") -> DataFrame:
    """query_id, rank, doc_id and score (rounded to 6 digits) of the k best documents of each query.

    A query is the distinct terms of its whole text; rows with one query_id are one query. A
    document without a common term is no hit, so a query may have fewer than k, and a null or
    empty text, of a query or a document, none. Ties go to the smaller doc_id, null first;
    repeated rows are hits each. Other columns are ignored; empty tables give an empty result.
    """
    spark = docs.sparkSession
    shards = cut(index(docs, text, doc_id), "search-index")
    n, total = _totals(shards)
    mean = total / n if n else 0.0
    weight = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms = _query_terms(queries.where(F.col(query_id).isNotNull()), query_text, query_id).join(_frequencies(shards), "term").select("query_id", F.struct((-weight).alias("w"), "term").alias("t"))
    terms = cut(terms.groupBy("query_id").agg(F.array_sort(F.collect_list("t")).alias("t")).select("query_id", "t.w", "t.term"), "search-queries")
    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("score", T.DoubleType())])

    def found(block: list[tuple[int, np.ndarray, np.ndarray]]) -> DataFrame:
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    row = {name: batch.column(j)[i] for j, name in enumerate(("ids", "lens", "terms", "starts", "docs", "tfs"))}
                    shard = Shard.of({name: x.values if name == "ids" else x.as_buffer() for name, x in row.items()}, mean)
                    who, hits, scores = [], [], []
                    for query, hit, score in shard.search(sent.value, k):
                        who.append(np.full(len(hit), query))
                        hits.append(hit)
                        scores.append(score)
                    ids = shard.ids.take(pa.array(np.concatenate(hits)))
                    row = shard = None  # before the next one is made
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(who), pa.int64()), ids, pa.array(np.concatenate(scores), pa.float64())], names=schema.names)

        return cut(shards.select("ids", "lens", "terms", "starts", "docs", "tfs").mapInArrow(run, schema), "search-hits")

    parts, block, size = [], [], 0
    for r in terms.toLocalIterator():
        block.append((r["query_id"], np.array(r["term"], np.int64), -np.array(r["w"], np.float64)))
        size += 16 * len(r["term"]) + 200
        if size >= SENT:
            parts.append(found(block))
            block, size = [], 0
    if block or not parts:
        parts.append(found(block) if block else spark.createDataFrame([], schema))
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return reduce(DataFrame.union, parts).withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


SEARCH_SQL = """
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')) AS term
  FROM documents),
tf AS (SELECT doc_id, term, count(*)::DOUBLE AS tf FROM words GROUP BY ALL),
lens AS (SELECT doc_id, sum(tf) AS len FROM tf GROUP BY doc_id),
stats AS (SELECT (SELECT count(*) FROM documents)::DOUBLE AS n, (SELECT sum(len) FROM lens)::DOUBLE AS total),
df AS (SELECT term, count(*)::DOUBLE AS df FROM tf GROUP BY term),
idf AS (SELECT term, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM df, stats),
scored AS (
  SELECT q.doc_id AS query_id, d.doc_id,
         round(sum(idf * d.tf * 2.2::DOUBLE / (d.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / (total / n)))), 6) AS score
  FROM tf q JOIN idf USING (term) JOIN tf d USING (term) JOIN lens ON lens.doc_id = d.doc_id, stats
  WHERE q.doc_id % 100 = 0 GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score
FROM scored QUALIFY rank <= 10
"""
