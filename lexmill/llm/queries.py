"""The thin queries of this subpackage over the standard tables, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm._common import small_batches, train_remainder
from lexmill.llm.exact import EXACT_SQL
from lexmill.llm.mixing import MIX_SQL
from lexmill.llm.search import SEARCH_SQL
from lexmill.llm.trie import TRIE_SQL


def bpe_path(kind: str = "json") -> str:
    """The byte-level vocabulary; as ``tiktoken`` it gives the same ids faster."""
    import public_tokenizers

    return public_tokenizers.path(f"byte_bpe_50k.{kind}")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.llm.embeddings import embedding_classes

    return embedding_classes(_table(spark, sf_dir, "embeddings"), least=0.93)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.llm.packing import pack

    pieces = pack(_table(spark, sf_dir, "documents"), bpe_path("tiktoken"), window=2048, end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.llm.simhash import simhash_classes

    return simhash_classes(_table(spark, sf_dir, "documents"), words=3, seed=42)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.llm.language import identify, learn

    docs = _table(spark, sf_dir, "documents")
    profiles = learn(docs.where(train_remainder("doc_id", 4) != 2))
    return identify(docs, profiles).select("doc_id", (train_remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op5_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.llm.extraction import extract_pages

    return extract_pages(_table(spark, sf_dir, "pages"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.llm.tokens import token_counts

    return token_counts(_table(spark, sf_dir, "documents"), bpe_path(), limit=512)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.llm.mixing import mix

    return mix(_table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, cap=2.0)


def op8_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.llm.search import top_k

    docs = _table(spark, sf_dir, "documents")
    queries = docs.where(F.col("doc_id") % 100 == 0).select(F.col("doc_id").alias("query_id"), "text")
    return top_k(docs, queries, k=10)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.llm.toxicity import learn, score_toxicity

    docs, train = _table(spark, sf_dir, "documents"), train_remainder("doc_id", 4) != 2
    lexicon = learn(docs.where(train), _table(spark, sf_dir, "labels").where(train), "toxic")
    return score_toxicity(docs, lexicon).select("doc_id", (train_remainder("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def op10_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.llm.ctw import learn, score

    docs = _table(spark, sf_dir, "documents")
    model, words = learn(docs.where(train_remainder("doc_id", 5) != 1))
    scored = score(docs, model, words)
    held_out = (train_remainder("doc_id", 5) == 1).alias("held_out")
    return scored.select("doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte")


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.llm.exact import exact_duplicates

    return exact_duplicates(_table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.llm.trie import numbered_turns, prefix_trie, with_shared_heads

    turns, members = with_shared_heads(numbered_turns(_table(spark, sf_dir, "conversations")), every=100, at_most=6)
    return prefix_trie(turns, members)


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.llm.importance import importance_sample

    docs, target = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    return importance_sample(docs, target, buckets=10_000, percent=5, least_words=20, seed=42)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_classes": op1_embedding_classes,
    "op2_packing": op2_packing,
    "op3_simhash": op3_simhash,
    "op4_language": op4_language,
    "op5_extraction": op5_extraction,
    "op6_token_counts": op6_token_counts,
    "op7_mixing": op7_mixing,
    "op8_search": op8_search,
    "op9_toxicity": op9_toxicity,
    "op10_ctw": op10_ctw,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_importance": op13_importance,
}

ORACLE_SQL: dict[str, str] = {"op7_mixing": MIX_SQL, "op8_search": SEARCH_SQL, "op11_exact_dedup": EXACT_SQL, "op12_prefix_trie": TRIE_SQL}
