"""Near-duplicate embeddings: cross-polytope hashing after fast Hadamard rotations.

A vector is padded to a power of two, rotated by three rounds of random signs and a fast
Hadamard transform, and hashed to its largest coordinate with its sign; ``functions`` such
hashes make a bucket of one of ``tables``. Multiprobe: a vector also enters the buckets that
swap one hash for its second largest coordinate. Vectors that share a bucket are candidates;
every candidate pair is verified by cosine in double precision.

Rows get keys of their own, so ids may repeat or be null. Equal vectors are one row with a
count. Buckets of one vector go before any vector is moved. A bucket of many is cut into chunks
and each pair of chunks is a piece of work of its own, so no task holds a whole bucket. Pairs are
never written: a piece of work yields, for each vector, the links it found and one neighbour of
its component there. A pair that meets in several buckets counts in the first of them only.

Close copies of one vector share most of their buckets. Each vector has a home, the first of its
hot buckets; in its other hot buckets it is not compared with vectors of the same home, which it
has met there. So a large group of copies is compared about once, not once in each bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm._common import cut, join_spread
from lexmill.operators.graph import components

#: Vectors of one bucket that a piece of work compares with each other or with as many others: an
#: eighth of the bucket between these, so that the pieces of a large bucket spread over the tasks.
SMALLEST, CHUNK = 64, 1024
#: The same of hot buckets, those of more than ``CHUNK`` vectors.
HOT_CHUNK = 2048
SALTS = 16


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row, normalised; the width is a power of two."""
    n, width = x.shape
    step = 1
    while step < width:
        y = x.reshape(n, width // (2 * step), 2, step)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(n, width)
        step *= 2
    return x / np.sqrt(width)


def buckets(x: np.ndarray, tables: int, functions: int, seed: int) -> np.ndarray:
    """Bucket numbers of unit rows, (rows, tables, functions + 1): the own bucket, then the probes."""
    n, d = x.shape
    width = 1 << max(1, (d - 1).bit_length())
    x = np.concatenate((x, np.zeros((n, width - d))), axis=1)
    rng = np.random.default_rng([seed, d])
    out = np.empty((n, tables, functions + 1), np.int64)
    for t in range(tables):
        first, second = np.empty((functions, n), np.int64), np.empty((functions, n), np.int64)
        for f in range(functions):
            y = x
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], width))
            size = np.abs(y)
            best = np.argmax(size, axis=1)
            rows = np.arange(n)
            size[rows, best] = -1
            next_ = np.argmax(size, axis=1)
            first[f], second[f] = 2 * best + (y[rows, best] > 0), 2 * next_ + (y[rows, next_] > 0)
        for p in range(functions + 1):
            code = np.full(n, t, np.int64)
            for f in range(functions):
                code = code * 2 * width + (second[f] if p == f + 1 else first[f])
            out[:, t, p] = code
    return out


def _unit(vectors) -> np.ndarray:
    x = np.array(list(vectors), np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no square overflows or vanishes
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _codes(vector: Column, tables: int, functions: int, seed: int) -> Column:
    @F.pandas_udf("array<long>")
    def codes(vectors: pd.Series) -> pd.Series:
        out: list = [None] * len(vectors)
        sizes = vectors.map(len).to_numpy()
        for d in np.unique(sizes):
            at = np.flatnonzero(sizes == d)
            for i, c in zip(at, buckets(_unit(vectors.iloc[at]), tables, functions, seed).reshape(len(at), -1), strict=True):
                out[i] = c
        return pd.Series(out)

    return codes(vector)


def _least_shared(a: np.ndarray, b: np.ndarray, probes: int) -> np.ndarray:
    """The least bucket that both of two rows of codes hold. Tables ascend, and so do their numbers."""
    none = np.iinfo(np.int64).max
    out = np.full(len(a), none)
    for t in range(0, a.shape[1], probes):
        x, y = a[:, t : t + probes], b[:, t : t + probes]
        shared = np.where((x[:, :, None] == y[:, None, :]).any(axis=2), x, none).min(axis=1)
        out = np.where(out == none, shared, out)
    return out


def _met_before(a: np.ndarray, b: np.ndarray, bucket: int) -> np.ndarray:
    """Which rows of codes of a and of b share a bucket before this one, by products of what they hold."""
    both = np.intersect1d(a[a < bucket], b[b < bucket])
    out = np.zeros((len(a), len(b)), bool)

    def held(codes: np.ndarray, some: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(some, codes), len(some) - 1)
        rows, places = np.nonzero(some[at] == codes)
        m = np.zeros((len(codes), len(some)), np.float32)
        m[rows, at[rows, places]] = 1
        return m

    for k in range(0, len(both), 1 << 10):
        some = both[k : k + (1 << 10)]
        out |= held(a, some) @ held(b, some).T > 0
    return out


def _linked(ids: np.ndarray, counts: np.ndarray, codes: np.ndarray, x: np.ndarray, side: np.ndarray, bucket: int, least: float, probes: int) -> pd.DataFrame:
    """Links among the vectors of a piece of work: a row for each linked vector."""
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    found = x[left] @ x[right].T >= least
    dense = np.count_nonzero(found) > 16 * (len(left) + len(right))
    if dense:  # the least bucket that both have is where the pair counts
        found &= ~_met_before(codes[left], codes[right], bucket)
    a, b = np.nonzero(found)
    a, b = left[a], right[b]
    ahead = (side[a] != side[b]) | (a < b)  # within one chunk both orders were found
    a, b = a[ahead], b[ahead]
    if not dense:
        first = np.empty(len(a), bool)
        for k in range(0, len(a), 1 << 14):
            part = slice(k, k + (1 << 14))
            first[part] = _least_shared(codes[a[part]], codes[b[part]], probes) == bucket
        a, b = a[first], b[first]
    links = np.bincount(a, counts[b], len(ids)) + np.bincount(b, counts[a], len(ids))
    root = np.arange(len(ids))
    while True:  # least position over the links found here
        new = root.copy()
        np.minimum.at(new, a, root[b])
        np.minimum.at(new, b, root[a])
        new = np.minimum(new, new[new])
        if (new == root).all():
            break
        root = new
    some = np.flatnonzero(links > 0)
    return pd.DataFrame({"rep": ids[some], "links": links[some].astype(np.int64), "near": ids[root[some]]})


def _compare(least: float, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pd.DataFrame] = []

        def work(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
            keys = rows[["label", "size", "bucket", "i", "j"]].to_numpy()
            starts = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1))))
            ids, counts, side = rows["rep"].to_numpy(), rows["n"].to_numpy(), rows["side"].to_numpy()
            for s, e in zip(starts, [*starts[1:], len(rows)], strict=True):
                if e - s > 1:
                    order = s + np.argsort(ids[s:e], kind="stable")
                    part = rows.iloc[order]
                    yield _linked(ids[order], counts[order], np.array(list(part["codes"]), np.int64), _unit(part["vector"]), side[order], int(keys[s, 2]), least, probes)

        def made(frames: Iterator[pd.DataFrame]) -> Iterator[pa.RecordBatch]:
            frames = [f for f in frames if len(f)]
            if frames:
                yield pa.RecordBatch.from_pandas(pd.concat(frames), schema=pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("near", pa.int64())]), preserve_index=False)

        for batch in batches:
            rows = batch.to_pandas()
            if not len(rows):
                continue
            waiting.append(rows)
            rows = pd.concat(waiting, ignore_index=True)
            last = rows[["label", "size", "bucket", "i", "j"]].to_numpy()
            done = int((last != last[-1]).any(axis=1).sum())  # sorted: the last piece may go on
            if done:
                yield from made(work(rows.iloc[:done]))
            waiting = [rows.iloc[done:]]
        if waiting:
            yield from made(work(pd.concat(waiting, ignore_index=True)))

    return run


def _pieces(met: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rep, i, j, side) of the pieces of work of buckets (keys, rep, m): chunks i and j, all with all."""
    chunk = F.greatest(F.lit(min(SMALLEST, CHUNK)), F.least(F.lit(CHUNK), F.ceil(F.col("m") / 8)))
    met = met.withColumn("chunks", F.ceil(F.col("m") / chunk).cast("int")).withColumn("c", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("long"))
    met = met.select(*keys, "rep", "c", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("chunks") - 1).cast("long"))).alias("o"))
    return met.select(*keys, "rep", *_ends())


def _ends():
    own = F.when(F.col("c") == F.col("o"), 2).otherwise((F.col("c") > F.col("o")).cast("int"))
    return F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), own.alias("side")


def _hot_pieces(met: DataFrame, keys: list[str]) -> DataFrame:
    """The same of hot buckets: chunks of vectors of one other home are not paired with each other.

    Homes with few vectors in a bucket share their chunks with those at home there.
    """
    homes = met.groupBy("rep").agg(F.min("bucket").alias("home"))
    met = met.join(homes, "rep")
    sizes = met.groupBy(*keys, "home").agg(F.count("*").alias("at_home"))
    apart = (F.col("home") != F.col("bucket")) & (F.col("at_home") >= HOT_CHUNK // 2)
    sizes = sizes.withColumn("part", F.when(apart, F.col("home")).otherwise(F.lit(-1).cast("long")))
    parts = sizes.groupBy(*keys, "part").agg(F.ceil(F.sum("at_home") / HOT_CHUNK).cast("int").alias("chunks"))
    named = sizes.select(*keys, "home", "part").join(parts, [*keys, "part"])
    met = met.join(named, [*keys, "home"]).withColumn("n", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    others = parts.select(*keys, F.col("part").alias("other"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("k"))
    met = met.select(*keys, "rep", "part", "n").join(others, keys).where((F.col("part") != F.col("other")) | (F.col("part") == -1))
    met = met.select(*keys, "rep", F.xxhash64("part", "n").alias("c"), F.xxhash64("other", "k").alias("o"))
    return met.select(*keys, "rep", *_ends())


def embedding_classes(
    table: DataFrame, least: float = 0.93, tables: int = 8, functions: int = 3, seed: int = 7, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label"
) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row.

    Rows link if their labels are equal and not null, their vectors of one length, and their
    cosine is ``least`` or more. Null, empty and zero vectors and those with null or non-finite
    components link with nothing. Each row counts for itself: rows that repeat a vector link with
    each other, whether or not they repeat the vec_id, and rows of one vec_id with different
    vectors have links of their own. component_id is the least vec_id that is not null among the
    rows reachable, null if there is none; kept is false where either is null. Labels may be of
    any type that compares. Other columns are ignored; an empty table gives an empty result.
    """
    spark = table.sparkSession
    v = F.col(embedding)
    fine = F.col(label).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = table.select(F.monotonically_increasing_id().alias("row"), F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), v.alias("vector"), F.coalesce(fine, F.lit(False)).alias("fine"))
    rows = cut(rows, "embedding-rows")
    equal = ["label", "vector"]
    reps = rows.where("fine").groupBy(*equal).agg(F.min("row").alias("rep"), F.min("vec_id").alias("least"), F.count("*").alias("n"))

    hashed = cut(reps.withColumn("codes", _codes(F.col("vector"), tables, functions, seed)).withColumn("size", F.size("vector")), "embedding-codes")
    reps = hashed.select(*equal, "rep", "least", "n")
    keys = ["label", "size", "bucket"]
    dealt = hashed.select("label", "size", "rep", F.explode("codes").alias("bucket"))
    sizes = cut(dealt.groupBy(*keys).agg(F.count("*").alias("m")).where("m > 1"), "embedding-sizes")
    shared = sizes.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    met = cut(join_spread(dealt, sizes, keys, "m", shared), "embedding-buckets")
    pieces = _pieces(met.where(F.col("m") <= CHUNK), keys).unionByName(_hot_pieces(met.where(F.col("m") > CHUNK), keys))
    work = pieces.join(hashed.select("rep", "n", "vector", "codes"), "rep")
    order = [*keys, "i", "j"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = work.select(*order, "side", "rep", "n", "codes", "vector").repartition(parts, *order).sortWithinPartitions(*order).mapInArrow(_compare(least, functions + 1), "rep long, links long, near long")
    found = cut(found, "embedding-links")

    roots = components(found.select(F.col("rep").alias("a"), F.col("near").alias("b")))
    linked = found.groupBy("rep").agg(F.sum("links").alias("links")).join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    info = hashed.select("rep", "least", "n").join(linked, "rep", "left").where("n > 1 or links is not null")
    info = cut(info.select("rep", "least", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("root")), "embedding-info")
    named = info.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("size"))
    info = join_spread(info, named, ["root"], "size", info.count()).select("rep", "n_links", "component_id")

    # a vector that many rows repeat is met by as many salts as spread it
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
    twice = reps.where("n > 1").select(*equal, "rep", salts)
    fine_rows = salted.where("fine").join(twice, [*equal, "salt"], "left").select("row", "vec_id", "salt", F.coalesce("rep", "row").alias("rep"))
    out = fine_rows.join(info.select("*", salts), ["rep", "salt"], "left").select("vec_id", "n_links", F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    others = rows.where("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = out.union(others)
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
