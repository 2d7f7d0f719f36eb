"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and is written
and read again before the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import language as _language
from lexmill.llm import toxicity as _toxicity
from lexmill.llm._common import cut, discard, free_name, scratch, small_batches
from lexmill.llm.mixing import mixed_documents
from lexmill.llm.packing import pack
from lexmill.llm.queries import bpe_path
from lexmill.llm.simhash import simhash_representatives

#: A text whose distance to the nearest profile leaves a lower score is in no language that was
#: learned, or in none: prose in these has 0.44 and more, other languages and codes 0.0 to 0.3.
LEAST_LANGUAGE_SCORE = 0.35
#: A toxicity score from which a document goes; the operator calls it toxic from there, too.
TOXIC = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str, wanted: Sequence[str] | None = None) -> DataFrame:
    """Keeps documents in one of the languages ``wanted``, or of all that the table is labelled with."""
    small_batches(spark)
    found = free_name(docs, "found_language")
    profiles = _language.learn(docs)
    known = F.col(found)["lang_pred"].isin([*(profiles.names if wanted is None else wanted)]) & (F.col(found)["score"] >= LEAST_LANGUAGE_SCORE)
    return docs.withColumn(found, _language.language(profiles, F.col("text"))).where(known).select(*docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that are not toxic, as the labelled ones among them show it."""
    small_batches(spark)
    score = free_name(docs, "toxicity")
    lexicon = _toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.withColumn(score, _toxicity.toxicity(lexicon, F.col("text"))).where(F.col(score) < TOXIC).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates, that of least id; ids may repeat or be null."""
    small_batches(spark)
    return simhash_representatives(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the curriculum takes, in training order."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens: a row for each piece, with its ids."""
    small_batches(spark)
    return pack(docs, bpe_path("tiktoken"), window=2048, end_id=1)


STAGES = [
    ("language ID", language),
    ("toxicity", toxicity),
    ("SimHash near-dedup", near_duplicates),
    ("mixing sources to target weights", mixing),
    ("packing", packing),
]

#: No SQL has the stages' models; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for k, (_, stage) in enumerate(STAGES):
        with scratch(spark):
            docs = cut(stage(spark, docs, sf_dir), f"pipeline-{k}", keep=True)
        discard(before)
        before = docs
    return docs
