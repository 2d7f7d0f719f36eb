"""Importance resampling towards a target: documents are drawn by how much like the target their n-grams are.

Each task runs SQL on DuckDB over its own batches of texts: words are unnested, a window puts
the next words beside each, and a registered function gives the CRC-32 of the 1- to 3-word runs,
whose remainder is the feature's bucket. A document's bucket counts, and one row of the task's
own sums, are spilled as Parquet to the shared folder. Spark merges the sums of the tasks to the
two distributions over buckets, scores the documents' counts by their log ratio, and ranks the
scores plus Gumbel noise, which draws without replacement in proportion to the weights.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm._common import cut, field, free_name, positions

#: Characters of text that one run of the SQL sees; a longer text comes in pieces.
PIECE = 1 << 20
#: Longest run of words that is a feature.
GRAMS = 3

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"
_PART = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")

#: head and tail are the words of a piece and those after it that finish its last runs.
_SQL = rf"""
WITH cut AS (
  SELECT doc, regexp_extract_all(translate(head, '{_UPPER}', '{_UPPER.lower()}'), '{_WORD}') AS words,
    regexp_extract_all(translate(tail, '{_UPPER}', '{_UPPER.lower()}'), '{_WORD}') AS more
  FROM pieces
),
words AS (
  SELECT doc, len(words) AS own, unnest(words || more) AS a, generate_subscripts(words || more, 1) AS i FROM cut
),
runs AS (
  SELECT doc, i <= own AS counts, a, lead(doc) OVER () AS doc2, lead(a) OVER () AS b, lead(doc, 2) OVER () AS doc3, lead(a, 2) OVER () AS c
  FROM words
),
features AS (
  SELECT doc, unnest([a, CASE WHEN doc2 = doc THEN a || ' ' || b END, CASE WHEN doc3 = doc THEN a || ' ' || b || ' ' || c END]) AS f
  FROM runs WHERE counts
)
SELECT doc * $buckets + crc(f) % $buckets AS k, count(*) AS n FROM features WHERE f IS NOT NULL GROUP BY 1
"""


def _crc(texts: pa.Array) -> pa.Array:
    """CRC-32 of the UTF-8 bytes of each text."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    found = np.fromiter(map(zlib.crc32, texts.cast(pa.large_binary()).to_numpy(zero_copy_only=False)), np.int64, len(texts))
    return pa.array(found)


def _connection() -> duckdb.DuckDBPyConnection:
    # the worker's share of memory; nothing goes to a local disk
    con = duckdb.connect(config={"threads": "1", "memory_limit": "800MB", "temp_directory": ""})
    con.create_function("crc", _crc, ["VARCHAR"], "BIGINT", type="arrow")
    return con


def _pieces(text: str, size: int) -> Iterator[tuple[str, str]]:
    """Heads that make up the text, cut where no word is, each with the next words as its tail."""
    at = 0
    while len(text) - at > size:
        end = at + size
        if _PART.match(text, end - 1):
            end = _PART.match(text, end - 1).end()
        tail, stop = [], end
        while len(tail) < GRAMS - 1 and (found := _PART.search(text, stop)):
            tail.append(found[0])
            stop = found.end()
        yield text[at:end], " ".join(tail)
        at = end
    yield text[at:], ""


def bucket_counts(docs: DataFrame, text: str, doc_id: str, buckets: int, piece: int = PIECE) -> DataFrame:
    """doc_id, n_words, n_features, and the buckets of the text's features with their counts, of each row.

    A row that ``sums`` has the sums of one task instead. Null texts have no words.
    """
    id_type = field(docs, doc_id).dataType

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con, total, n_rows, n_all = _connection(), np.zeros(buckets, np.int64), 0, 0
        for batch in batches:
            rows, texts = batch.column(0), batch.column(1).to_pylist()
            found: list[tuple[np.ndarray, np.ndarray]] = [None] * len(texts)
            waiting, size = [], 0

            def run():
                nonlocal waiting, size
                pieces = pa.table({"doc": pa.array(range(len(waiting)), pa.int64()), "head": pa.array([h for _, h, _ in waiting], pa.string()), "tail": pa.array([t for _, _, t in waiting], pa.string())})
                con.register("pieces", pieces)
                got = con.execute(_SQL, {"buckets": buckets}).fetchnumpy()
                con.unregister("pieces")
                keys, counts = np.asarray(got["k"], np.int64), np.asarray(got["n"], np.int64)
                order = np.argsort(keys, kind="stable")
                keys, counts = keys[order], counts[order]
                edges = np.searchsorted(keys, np.arange(len(waiting) + 1) * buckets)
                for k, (doc, _, _) in enumerate(waiting):
                    b, n = keys[edges[k] : edges[k + 1]] - k * buckets, counts[edges[k] : edges[k + 1]]
                    if found[doc] is not None:
                        both = np.zeros(buckets, np.int64)
                        both[found[doc][0]] += found[doc][1]
                        both[b] += n
                        b = np.flatnonzero(both)
                        n = both[b]
                    found[doc] = (b, n)
                waiting, size = [], 0

            for doc, t in enumerate(texts):
                for head, tail in _pieces(t or "", piece):
                    waiting.append((doc, head, tail))
                    size += len(head)
                    if size >= piece:
                        run()
            run()
            features = np.array([n.sum() for _, n in found], np.int64)
            for b, n in found:
                total[b] += n
            n_rows, n_all = n_rows + len(texts), n_all + int(features.sum())
            yield out(rows, False, features, [len(b) for b, _ in found], np.concatenate([b for b, _ in found] or [total[:0]]), np.concatenate([n for _, n in found] or [total[:0]]))
        con.close()
        if n_rows:
            seen = np.flatnonzero(total)
            yield out(pa.nulls(1, rows.type), True, np.array([n_all]), [len(seen)], seen, total[seen])

    def out(rows, sums, features, lengths, b, n):
        # k words have 3 k - 3 runs of up to three words, but one word has 1 and two have 3
        offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(b.astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(n))]
        words = np.where(features <= 1, features, (features + GRAMS) // GRAMS)
        return pa.RecordBatch.from_arrays([rows, pa.array([sums] * len(rows)), pa.array(words), pa.array(features), *lists], ["doc_id", "sums", "n_words", "n_features", "bucket", "n"])

    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return slim.mapInArrow(counted, f"doc_id {id_type.simpleString()}, sums boolean, n_words long, n_features long, bucket array<int>, n array<long>")


def _sums(counts: DataFrame, name: str) -> DataFrame:
    """The tasks' sums added up by bucket: at most a row for each bucket."""
    pairs = counts.where("sums").select(F.explode(F.arrays_zip("bucket", "n")).alias("pair"))
    return pairs.groupBy(F.col("pair.bucket").alias("bucket")).agg(F.sum("pair.n").alias(name))


def gains(source: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """For each bucket floor(1000 ln of its smoothed frequency in the target over that in the source)."""
    both = source.join(target, "bucket", "full").select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t"))
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for b, x, y in both.collect():  # a number for each bucket, whatever the input
        s[b], t[b] = x, y
    s, t = s.astype(float), t.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def _weight(gain: np.ndarray, bucket: Column, n: Column) -> Column:
    @F.pandas_udf("long")
    def weight(buckets: pd.Series, counts: pd.Series) -> pd.Series:
        return pd.Series([int(gain[b] @ c) for b, c in zip(buckets, counts)], dtype="int64")

    return weight(bucket, n)


def importance_sample(docs: DataFrame, target: DataFrame, buckets: int, percent: int, least_words: int, seed: int, text: str = "text", doc_id: str = "doc_id", target_text: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of ``docs``; rank is null if it is not drawn.

    Features are all runs of one to three words of the lower-cased (A-Z) whole text, repeats
    included; a word is letters a-z, digits and characters beyond ASCII. weight is the sum of
    the gains of the features' buckets, 0 without features; score adds noise from the id alone
    (that of the empty text for null ids). Of the N rows with ``least_words`` words or more,
    ``percent`` * N / 100, rounded down, of highest score are drawn; ties go to the smaller id,
    null ids last. Null and empty texts have no features; repeated rows are scored and drawn
    each; other columns are ignored; empty tables give an empty result or no features.
    """
    counts = cut(bucket_counts(docs, text, doc_id, buckets), "bucket-counts")
    of_target = target.withColumn(nothing := free_name(target, "nothing"), F.lit(0))
    of_target = cut(bucket_counts(of_target, target_text, nothing, buckets), "bucket-counts-target")
    gain = gains(_sums(counts, "s"), _sums(of_target, "t"), buckets)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    may = (F.col("n_words") >= least_words).alias("may")
    scored = counts.where("not sums").select("doc_id", "n_features", may, _weight(gain, F.col("bucket"), F.col("n")).alias("weight")).withColumn("score", F.col("weight") + noise)
    scored = cut(scored, "scores")
    draw = scored.where("may").count() * percent // 100
    order = [F.col("may").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    placed = positions(scored, order, at="rank")
    drawn = F.when(F.col("may") & (F.col("rank") <= draw), F.col("rank").cast("long"))
    return placed.select("doc_id", "n_features", "weight", "score", drawn.alias("rank"))
