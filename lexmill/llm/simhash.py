"""SimHash near-duplicates: fingerprints joined on pigeonhole blocks, verified by Hamming distance.

A fingerprint has four blocks of 16 bits. Two fingerprints that differ in at most two bits
agree on at least two whole blocks, so they share one of six keys of two blocks. Keys of few
fingerprints are joined and every pair verified. A key that many fingerprints share would give
a square of pairs; its fingerprints are linked through neighbours instead, which is exact as
well: two fingerprints differ in at most two bits just if some 64-bit value differs from each
of them in at most one. Each is dealt to its 65 such values and linked to the least
fingerprint there whose distance is verified. Equal fingerprints are one node throughout.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm._common import cut, free_name, join_spread
from lexmill.operators.graph import components

#: Fingerprints that share a key up to which its pairs are joined; beyond, neighbours link them.
PAIRED = 64
SALTS = 16

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def hashes_of(text: str | None, words: int, seed: int) -> np.ndarray:
    """Hashes of the word shingles of a text, repeats included."""
    w = (text or "").encode().lower().split()
    if len(w) >= words:
        parts = map(b" ".join, zip(*(w[k:] for k in range(words))))
    else:
        parts = [b" ".join(w)] if w else []
    return np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(seed)), np.uint64)


def fingerprint_of(hashes: np.ndarray) -> int:
    """64 bits, each 1 if it is set in over half of the hashes; 0 for none."""
    counts = np.empty(64, np.int64)
    each = hashes.view(np.uint8).reshape(-1, 8)
    for k in range(8):
        counts[8 * k : 8 * k + 8] = np.bincount(each[:, k], minlength=256) @ _BITS
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: Column, words: int = 3, seed: int = 42) -> Column:
    """SimHash of a text's word shingles as a signed long; null texts have no words."""

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        found = np.fromiter((fingerprint_of(hashes_of(t, words, seed)) for t in texts), np.uint64, len(texts))
        return pd.Series(found.view(np.int64))

    return fp(text)


def close_links(fingerprints: DataFrame, fp: str = "fp") -> DataFrame:
    """Links (a, b) whose components are those of all pairs of distinct values at distance 2 or less."""
    block = lambda k: F.shiftrightunsigned(fp, 16 * k).bitwiseAND(0xFFFF)
    keys = [F.struct(F.lit(t).alias("t"), F.shiftleft(block(i), 16).bitwiseOR(block(j)).alias("key")) for t, (i, j) in enumerate(combinations(range(4), 2))]
    dealt = fingerprints.select(fp, F.inline(F.array(*keys)))
    sizes = cut(dealt.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1"), "simhash-sizes")
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shared = cut(join_spread(dealt, sizes, ["t", "key"], "n", total).select("t", "key", "n", F.col(fp).alias("a")), "simhash-keys")
    few = shared.where(F.col("n") <= PAIRED)
    pairs = few.join(few.select("t", "key", F.col("a").alias("b")), ["t", "key"]).where("a < b and bit_count(a ^ b) <= 2").select("a", "b")
    many = shared.where(F.col("n") > PAIRED).select("a").distinct()
    near = F.array(F.col("a"), *(F.col("a").bitwiseXOR(F.lit(1 << k if k < 63 else -(1 << 63)).cast("long")) for k in range(64)))
    met = many.select("a", F.explode(near).alias("mid"))
    least = met.groupBy("mid").agg(F.min("a").alias("b"), F.count("*").alias("n")).where("n > 1").select("mid", "b")  # at most 65 have a value
    linked = met.join(least, "mid").where("a <> b and bit_count(a ^ b) <= 2").select("a", "b")
    return pairs.union(linked).distinct()


def simhash_classes(docs: DataFrame, words: int = 3, seed: int = 42, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row.

    Words are cut at ASCII white space after lower-casing A-Z. Texts with fewer words than a
    shingle hash the whole sequence; null, empty and blank texts have fingerprint zero and link
    like any other. component_id is the least doc_id reachable over links; null ids never name
    one (a component of null ids only has a null one). Repeated rows each give a row; other
    columns are ignored; an empty table gives an empty result.
    """
    rows = cut(docs.select(F.col(doc_id).alias("doc_id"), fingerprint(F.col(text), words, seed).alias("fp")), "simhash")
    nodes = cut(_classes(rows), "simhash-nodes")
    named = nodes.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n"))
    classes = join_spread(nodes.select("fp", "root"), named, ["root"], "n", nodes.count()).select("fp", "component_id")
    # a fingerprint that many rows share is met by as many salts as spread it
    salted = classes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    return rows.join(salted, ["fp", "salt"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def simhash_representatives(docs: DataFrame, words: int = 3, seed: int = 42, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The columns of ``docs``, one row of each component of ``simhash_classes``.

    It is the row of least doc_id, null ids last; of several such rows, one. Rows are told apart
    by themselves, not by their ids: documents of one id stay both unless their texts are near
    duplicates, and a row without an id goes if another row of its component stays.
    """
    row, fp = free_name(docs, "row"), free_name(docs, "fp")
    rows = cut(docs.select("*", F.monotonically_increasing_id().alias(row), fingerprint(F.col(text), words, seed).alias(fp)), "simhash-rows")
    slim = rows.select(F.col(doc_id).alias("doc_id"), F.col(row).alias("row"), F.col(fp).alias("fp"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    kept = _classes(slim, first).groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias(row))
    return rows.join(kept, row, "left_semi").select(*docs.columns)


def _classes(rows: DataFrame, first: Column | None = None) -> DataFrame:
    """root of each fingerprint with a doc_id of its rows, or with ``first``, an aggregate of them."""
    first = F.min("doc_id").alias("doc_id") if first is None else first
    nodes = cut(rows.groupBy("fp").agg(first), "simhash-fingerprints")
    roots = components(close_links(nodes.select("fp")))
    return nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
