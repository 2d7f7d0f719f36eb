"""Token counts by a map-side two-tier lookup.

A text is split into pre-tokens. The first tier is a broadcast hash table (flat arrays, see
``Lengths``) of the lengths of frequent pre-tokens, at most ``FREQUENT`` of them, counted over a
sample of bounded size (see ``frequent_lengths``); it only saves work, and no result depends on
which pre-tokens it holds. The second tier is a cache
in each Python worker, of bounded size, filled by encoding what the table misses. No pre-token
ever crosses a shuffle.

A byte-level BPE never joins bytes across a single space between two other characters, so
such spaces cut the text into pre-tokens that encode independently. Texts with any other
white space beside a space (two in a row, one at an end) are encoded whole.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Callable, Iterator, Mapping
from itertools import accumulate, pairwise
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pre-tokens longer than this are encoded each time, so that the cache's size in bytes is bounded too.
LONGEST = 80
CACHED, CACHED_WORDS = 3 << 18, 1 << 17
#: Parts of the table that frequent pre-tokens are counted in, characters of each part, its entries that are looked at,
#: entries of the table of all, and how many pre-tokens a task counts at once.
PARTS, PART_CHARS, PART_FREQUENT, FREQUENT, COUNTED = 16, 1 << 22, 1 << 14, 1 << 16, 1 << 20


# The word pattern of byte-level vocabularies, and the letters that stand for bytes
# in them (printable ones for themselves, the rest in order from U+0100).
BYTE_LEVEL_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_LETTERS = {b: chr(b) for b in _PRINTABLE} | {b: chr(0x100 + k) for k, b in enumerate(b for b in range(256) if b not in set(_PRINTABLE))}


END_OF_TEXT = "<|endoftext|>"
#: Runs of white space from which texts go to the library that has no limit of them; the other fails near a million.
LONG_BLANKS = re.compile(r"\s{100000}")


class _Irregular(Exception):
    pass


class Encoder:
    """Texts to ids with the library a vocabulary file belongs to (``.json``, ``.tiktoken`` or ``.model``).

    A byte-level vocabulary gives the same ids from its ``.json`` and its ``.tiktoken`` file; the
    latter is read as one whose word pattern is ``BYTE_LEVEL_WORDS`` and whose only special
    string ends texts. It encodes whole texts about three times as fast, but for those with very
    long runs of white space, which the ``.json`` file of the same name encodes.
    """

    def __init__(self, path: str):
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            tok.no_truncation()
            tok.no_padding()
            self.ids: Callable[[str], list[int]] = lambda text: tok.encode(text, add_special_tokens=False).ids
            spec = json.loads(Path(path).read_text())
            pre = spec.get("pre_tokenizer") or {}
            self.splits = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
            self.size, self.piece = tok.get_vocab_size(), lambda i: tok.decode([i], skip_special_tokens=False)
            self.vocabulary = tok.get_vocab
            self.specials = [t.content for t in tok.get_added_tokens_decoder().values()]
            self.model, self.words = tok.model, {}
        elif path.endswith(".tiktoken"):
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.size, self.specials = len(ranks) + 1, [END_OF_TEXT]
            tik = tiktoken.Encoding(Path(path).stem, pat_str=BYTE_LEVEL_WORDS.pattern, mergeable_ranks=ranks, special_tokens={END_OF_TEXT: len(ranks)})
            self.ids = lambda text: tik.encode(text, allowed_special="all")
            self.array = lambda text: self._whole(tik, text)
            self.sibling = path.removesuffix("tiktoken") + "json"
            self.splits, self.vocabulary = False, dict
            self.piece = lambda i: tik.decode([i])
        elif path.endswith(".model"):
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            self.ids = lambda text: sp.encode(text, num_threads=1)
            self.splits, self.size = False, sp.get_piece_size()
            self.piece = lambda i: sp.id_to_piece(i).replace("▁", " ")
            self.vocabulary, self.specials = dict, []
        else:
            raise ValueError(f"not a vocabulary file this operator knows: {path}")

    def array(self, text: str) -> np.ndarray:
        return np.array(self.ids(text), np.uint32)

    def _whole(self, tik, text: str) -> np.ndarray:
        """The ids of a text; where its runs of white space are too long for the pattern, by the ``.json`` file beside it."""
        if not LONG_BLANKS.search(text):
            return tik.encode_to_numpy(text, allowed_special="all")
        return encoder(self.sibling).array(text)

    def chunk_ids(self, chunk: str) -> list[int]:
        """ids of a space and a pre-token: the vocabulary's word pattern, then the library's model for each word."""
        if "<" in chunk and any(s in chunk for s in self.specials):
            return self.ids(" " + chunk)
        if chunk.isascii() and chunk.isalpha():
            return [t.id for t in self.model.tokenize("Ġ" + chunk)]  # letters after a space are one word
        out: list[int] = []
        for word in BYTE_LEVEL_WORDS.findall(" " + chunk):
            known = self.words.get(word)
            if known is None:
                known = [t.id for t in self.model.tokenize("".join(map(BYTE_LETTERS.__getitem__, word.encode())))]
                if len(word) <= LONGEST:
                    if len(self.words) >= CACHED_WORDS:
                        self.words.clear()
                    self.words[word] = known
            out += known
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each path and Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Cache(dict):
    """Pre-token -> value, made from its ids where it is missing. Emptied when full."""

    def __init__(self, enc: Encoder, value: Callable[[list[int]], object], first: Lengths | None = None):
        super().__init__()
        self.enc, self.value, self.first = enc, value, first if first is not None else Lengths({})

    def __missing__(self, chunk: str):
        known = self.first.get(chunk)
        if known is None:
            if not chunk or chunk[0].isspace() or chunk[-1].isspace():
                raise _Irregular
            known = self.value(self.enc.chunk_ids(chunk))
        if len(chunk) <= LONGEST:
            if len(self) >= CACHED:
                self.clear()
            self[chunk] = known
        return known


def values(text: str, cache: Cache) -> list | None:
    """The cached value of each pre-token in order, or None if the text must be encoded whole."""
    if not cache.enc.splits:
        return None
    head, *rest = text.split(" ")
    try:
        if not head or head[-1].isspace():
            return None
        out = [cache.value(cache.enc.ids(head))]
        out += map(cache.__getitem__, rest)
    except _Irregular:
        return None
    return out


class Lengths(Mapping):
    """Pre-token -> number of tokens as an open-addressed hash table of flat arrays; texts are compared, so it never errs.

    An entry takes its bytes and 14 to 22 more. A pre-token of ``LONGEST`` characters fits 16 bits.
    """

    def __init__(self, lengths: dict[str, int]):
        words = [w.encode() for w in lengths]
        self.text = b"".join(words)
        self.ends = array("I", accumulate(map(len, words), initial=0))
        self.tokens = array("H", lengths.values())
        self.slots = array("i", [-1]) * (1 << max(2 * len(words), 1).bit_length())
        mask = len(self.slots) - 1
        for k, word in enumerate(words):
            at = zlib.crc32(word) & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = k

    def __len__(self) -> int:
        return len(self.tokens)

    def __iter__(self) -> Iterator[str]:
        return (self.text[a:b].decode() for a, b in pairwise(self.ends))

    def __getitem__(self, word: str) -> int:
        if (n := self.get(word)) is None:
            raise KeyError(word)
        return n

    def get(self, word: str, default: int | None = None) -> int | None:
        key, mask = word.encode(), len(self.slots) - 1
        at = zlib.crc32(key) & mask
        while (k := self.slots[at]) >= 0:
            if self.text[self.ends[k] : self.ends[k + 1]] == key:
                return self.tokens[k]
            at = (at + 1) & mask
        return default


def _most_frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row: the most frequent pre-tokens of this part's first ``PART_CHARS`` characters that come more than once, and how often."""
    seen: Counter[str] = Counter()
    left = PART_CHARS
    for batch in batches:
        for body in batch.column(0) if left > 0 else ():
            text = body.as_py() or ""
            seen.update(w for w in text.split(" ")[1:] if 0 < len(w) <= LONGEST)
            if len(seen) > COUNTED:
                seen = Counter({w: n for w, n in seen.items() if n > 1})
            left -= len(text)
            if left <= 0:
                break
    best = [(w, n) for w, n in seen.items() if n > 1 and not (w[0].isspace() or w[-1].isspace())]
    best = sorted(best, key=lambda kv: (-kv[1], kv[0]))[:PART_FREQUENT]
    yield pa.RecordBatch.from_arrays([pa.array([[w for w, _ in best]], pa.list_(pa.string())), pa.array([[n for _, n in best]], pa.list_(pa.int64()))], names=["words", "n"])


def frequent_lengths(docs: DataFrame, path: str, text: str = "text") -> Lengths:
    """Frequent pre-tokens (without their leading space) and their numbers of tokens; none for vocabularies that do not split at spaces.

    Each task counts its own part and gives one row of at most ``PART_FREQUENT`` pre-tokens. Spark
    starts tasks until ``PARTS`` rows are there, so what is read, counted and sent to the driver does not grow with the table.
    """
    enc = encoder(path)
    if not enc.splits:
        return Lengths({})
    seen: Counter[str] = Counter()
    for row in docs.select(F.col(text).alias("text")).mapInArrow(_most_frequent, "words array<string>, n array<long>").take(PARTS):
        seen.update(dict(zip(row["words"], row["n"], strict=True)))
    best = sorted(seen.items(), key=lambda kv: (-kv[1], kv[0]))[:FREQUENT]
    return Lengths({w: len(enc.chunk_ids(w)) for w, _ in best})


_caches: dict[str, Cache] = {}


def length_of(text: str | None, cache: Cache) -> int:
    if not text:
        return 0
    found = values(text, cache)
    return len(cache.enc.ids(text)) if found is None else sum(found)


def token_lengths(spark: SparkSession, path: str, frequent: Lengths | None = None):
    """A vectorised function text -> number of tokens; null and empty texts have none.

    ``frequent`` has the lengths of pre-tokens that need not be encoded (see ``frequent_lengths``).
    """
    table = spark.sparkContext.broadcast(frequent if frequent is not None else Lengths({}))

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if path not in _caches:
            _caches[path] = Cache(encoder(path), len)
        cache = _caches[path]
        cache.first = table.value
        for texts in batches:
            yield pd.Series(np.fromiter((length_of(t, cache) for t in texts), np.int64, len(texts)))

    return count


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row.

    Null texts count as empty (no bytes, no tokens). Repeated rows and null ids give a row
    each; other columns are ignored; an empty table gives an empty result.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        F.octet_length(body).cast("long").alias("n_bytes"),
        token_lengths(docs.sparkSession, tokenizer, frequent_lengths(docs, tokenizer, text))(F.col(text)).alias("n_tokens"),
    ).withColumn("over_limit", F.col("n_tokens") > limit)
