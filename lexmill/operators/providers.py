"""Boundaries to outside services: a protocol, and a deterministic fallback for each.

A provider maps a batch of prompts to answers. The fallback answers from the row itself, so a
plan runs without a network and gives the same result every time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.operators.spread import cut, join_spread


class Provider(Protocol):
    name: str

    def answer(self, prompts: Sequence[str]) -> list[str]: ...


class Echo:
    """Answers with the first sentence of the prompt's last line."""

    name = "fallback"

    def answer(self, prompts: Sequence[str]) -> list[str]:
        return [p.strip().rpartition("\n")[2].partition(".")[0].strip() for p in prompts]


def answered(rows: DataFrame, prompt: Column, providers: Sequence[Callable[[], Provider]] = (Echo,), batch: int = 64) -> DataFrame:
    """Rows with answer and provider: the first provider that does not fail, for each batch.

    Equal prompts are sent once.
    """
    kept = rows.withColumn("_prompt", F.coalesce(prompt, F.lit("")))

    @F.pandas_udf("answer string, provider string")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        open_ = [make() for make in providers]
        for prompts in batches:
            out = []
            for k in range(0, len(prompts), batch):
                part = prompts.iloc[k : k + batch].tolist()
                for p in open_:
                    try:
                        out += [(a, p.name) for a in p.answer(part)]
                        break
                    except Exception:
                        if p is open_[-1]:
                            raise
            yield pd.DataFrame(out, columns=["answer", "provider"])

    once = kept.select("_prompt").distinct().select("_prompt", ask("_prompt").alias("_a"))
    return kept.join(once, "_prompt").select(*rows.columns, "_a.*")


class Checker(Protocol):
    name: str

    def check(self, texts: Sequence[str]) -> list[list[tuple[int, int, str]]]: ...


class Repeats:
    """Finds words said twice and runs of end marks: (start, end, message) in code points."""

    name = "fallback"
    found = ((regex.compile(r"(?i)\b(\p{L}+)\s+\1\b"), "repeated word"), (regex.compile(r"[!?]{2,}"), "repeated mark"))

    def check(self, texts: Sequence[str]) -> list[list[tuple[int, int, str]]]:
        return [[(m.start(), m.end(), why) for p, why in self.found for m in p.finditer(t)] for t in texts]


def chunked(rows: DataFrame, text: str, size: int, keep: Sequence[str]) -> DataFrame:
    """keep, chunk (its number), offset and text of pieces that make up each text.

    A piece ends after a sentence or a line, else after white space, at most ``size`` characters
    on; what has no white space stays whole. Null and empty texts have no pieces.
    """
    ends = rf"(?s).{{1,{size}}}(?:(?<=[.!?])(?=\s)|(?<=\n)|\z)|.{{1,{size}}}(?<=\s)|\S+|."
    pieces = F.regexp_extract_all(F.col(text), F.lit(ends), 0)
    out = rows.withColumn("_row", F.monotonically_increasing_id()).select("_row", *keep, F.posexplode(pieces).alias("chunk", "piece"))
    before = F.sum(F.length("piece")).over(Window.partitionBy("_row").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    return out.select(*keep, "chunk", F.coalesce(before, F.lit(0)).alias("offset"), F.col("piece").alias("text"))


def checked(rows: DataFrame, checker: Callable[[], Checker] = Repeats, size: int = 2000, text: str = "text", keep: Sequence[str] = ("doc_id",), batch: int = 64) -> DataFrame:
    """keep, start, end, message and original_text of what a checker finds in each text.

    The checker sees texts piece by piece (see ``chunked``), each distinct piece once, however
    many texts hold it; places in a piece are mapped to places in its texts. What a checker finds
    within a sentence is what it finds in the whole text.
    """
    pieces = chunked(rows, text, size, keep).withColumn("_key", F.sha2("text", 256))
    places = cut(pieces.select(*keep, "offset", "_key"), "checked-pieces")

    @F.pandas_udf("array<struct<start:int,end:int,message:string,original_text:string>>")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        service = checker()
        for texts in batches:
            out: list = []
            for k in range(0, len(texts), batch):
                part = texts.iloc[k : k + batch].tolist()
                out += [[{"start": s, "end": e, "message": m, "original_text": t[s:e]} for s, e, m in found] for t, found in zip(part, service.check(part), strict=True)]
            yield pd.Series(out)

    once = pieces.groupBy("_key").agg(F.first("text").alias("_text"), F.count("*").alias("_n"))
    found = cut(once.select("_key", "_n", ask("_text").alias("_found")).where(F.size("_found") > 0), "checked-answers")
    met = join_spread(places, found, ["_key"], "_n", places.count()).select(*keep, "offset", F.inline("_found"))
    place = lambda c: (F.col("offset") + F.col(c)).cast("int").alias(c)
    return met.select(*keep, place("start"), place("end"), "message", "original_text")
