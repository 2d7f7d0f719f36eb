"""Rules as a table: thousands of literals and patterns tried in one pass over the texts.

Literals, whole words or not, are found by one automaton that reads a text once. Each other rule
is reduced to texts of which one must occur wherever it matches; these make a second automaton,
and only the rules whose texts it meets are then tried. Both are built once for each Python
worker. What comes out is what each pattern alone would find.
"""

from __future__ import annotations

import hashlib
import re._constants as C
import re._parser as parser
import warnings
from collections import Counter
from collections.abc import Iterator, Sequence

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.operators.spread import cut

#: Characters of patterns that one pass takes; a longer table is taken in several.
PASS = 1 << 21


def folded(text: str) -> str:
    """A text in a form that does not depend on case; what matches without case is equal in it."""
    return text.replace("İ", "i").replace("ı", "i").casefold()


def _needles(items) -> list[str] | None:
    """Texts of which every match holds one, as long as can be told; None if nothing is sure."""
    best, run = None, ""

    def offer(found: list[str] | None) -> None:
        nonlocal best
        if found and all(found) and (best is None or min(map(len, found)) > min(map(len, best))):
            best = found

    for op, value in items:
        if op is C.LITERAL:
            run += chr(value)
            continue
        if op is C.AT:
            continue
        offer([run] if run else None)
        run = ""
        if op is C.SUBPATTERN:
            offer(_needles(value[3]))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and value[0] >= 1:
            offer(_needles(value[2]))
        elif op is C.BRANCH:
            each = [_needles(x) for x in value[1]]
            offer([n for x in each for n in x] if all(each) else None)
        elif op is C.ATOMIC_GROUP:
            offer(_needles(value))
    offer([run] if run else None)
    return best


def needles(pattern: str) -> list[str] | None:
    """The same of a pattern; patterns that only the ``regex`` library reads have none."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return _needles(parser.parse(pattern))
    except Exception:
        return None


def literal(pattern: str) -> tuple[str, bool, bool] | None:
    """The text that a pattern is, and whether a word must begin or end at its ends; None for other patterns."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            parsed = parser.parse(pattern)
    except Exception:
        return None
    items = list(parsed)
    bound = (C.AT, C.AT_BOUNDARY)
    left, right = bool(items) and items[0] == bound, len(items) > 1 and items[-1] == bound
    body = items[left : len(items) - right]
    if not body or parsed.state.flags != C.SRE_FLAG_UNICODE or any(op is not C.LITERAL for op, _ in body):
        return None
    return "".join(chr(v) for _, v in body), left, right


_WORD, _WORDS = regex.compile(r"\w"), regex.compile(r"\w+")
#: A whole word without any sign that patterns give a meaning.
_PLAIN = regex.compile(r"\\b(\w+)\\b")


def whole_word(pattern: str) -> str | None:
    """The word that a pattern is, if it is a literal of one whole word."""
    if plain := _PLAIN.fullmatch(pattern):
        return plain[1]
    found = literal(pattern)
    return found[0] if found and found[1] and found[2] and _WORDS.fullmatch(found[0]) else None


#: Compiled patterns that a worker keeps.
COMPILED = 4096


class Automaton:
    def __init__(self, rules: Sequence[tuple[str, str, bool]]):
        """rules: name, pattern, and whether case does not matter."""
        self.rules = rules
        self.compiled: dict[int, regex.Pattern] = {}
        self.in_word: dict[str, bool] = {}
        self.always: list[int] = []
        self.whole: dict[str, list[int]] = {}  # literals that are one whole word: the words of a text are looked up
        plain: dict[str, list[tuple[int, bool, bool]]] = {}
        of: dict[str, list[int]] = {}
        for k, (_, pattern, any_case) in enumerate(rules):
            if not any_case and (found := literal(pattern)):
                if found[1] and found[2] and _WORDS.fullmatch(found[0]):
                    self.whole.setdefault(found[0], []).append(k)
                else:
                    plain.setdefault(found[0], []).append((k, *found[1:]))
                continue
            found = needles(pattern)
            for n in {folded(n) for n in found} if found else ():
                of.setdefault(n, []).append(k)
            if not found:
                self.always.append(k)
        self.literals, self.words = self._made(plain), self._made(of)

    @staticmethod
    def _made(words: dict[str, list]):
        out = ahocorasick.Automaton()
        for w, which in words.items():
            out.add_word(w, (len(w), which))
        if not words:
            return None
        out.make_automaton()
        return out

    def _edge(self, text: str, at: int) -> bool:
        """Whether a word begins or ends at a place."""
        inside = []
        for k in (at - 1, at):
            c = text[k] if 0 <= k < len(text) else ""
            if c not in self.in_word:
                if len(self.in_word) > 1 << 16:
                    self.in_word.clear()
                self.in_word[c] = bool(_WORD.match(c))
            inside.append(self.in_word[c])
        return inside[0] != inside[1]

    def spans(self, text: str) -> list[tuple[str, int, int, str]]:
        out = []
        if self.whole:
            for m in _WORDS.finditer(text):
                if (which := self.whole.get(m[0])) is not None:
                    out += [(self.rules[k][0], *m.span(), m[0]) for k in which]
        if self.literals is not None:
            free: dict[int, int] = {}  # where a rule's last match ended
            for last, (size, which) in self.literals.iter(text):
                start, end = last + 1 - size, last + 1
                left = right = None
                for k, at_start, at_end in which:
                    if start < free.get(k, 0):
                        continue
                    if at_start:
                        left = self._edge(text, start) if left is None else left
                    if at_end:
                        right = self._edge(text, end) if right is None else right
                    if (at_start and not left) or (at_end and not right):
                        continue
                    free[k] = end
                    out.append((self.rules[k][0], start, end, text[start:end]))
        tried = set(self.always)
        if self.words is not None:
            for _, (_, which) in self.words.iter(folded(text)):
                tried.update(which)
        for k in sorted(tried):
            name, pattern, any_case = self.rules[k]
            p = self.compiled.get(k)
            if p is None:
                if len(self.compiled) >= COMPILED:
                    self.compiled.clear()
                p = self.compiled[k] = regex.compile(pattern, regex.IGNORECASE if any_case else 0, cache_pattern=False)
            out += [(name, m.start(), m.end(), m[0]) for m in p.finditer(text) if m[0]]
        return out


_automata: dict[str, Automaton] = {}


def _automaton(key: str, rules: Sequence[tuple[str, str, bool]]) -> Automaton:
    """One automaton for each table and Python worker."""
    if key not in _automata:
        _automata.clear()
        _automata[key] = Automaton(rules)
    return _automata[key]


#: Texts whose spans are Python objects at the same time.
TEXTS = 64


def _spans(key: str, shared: Broadcast):
    @F.arrow_udf("array<struct<rule:string,start:int,end:int,original_text:string>>")
    def spans(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = _automaton(key, shared.value)
        for texts in batches:
            yield pa.concat_arrays([_columns(automaton, texts.slice(k, TEXTS).to_pylist()) for k in range(0, max(len(texts), 1), TEXTS)])

    return spans


def _columns(automaton: Automaton, texts: list[str | None]) -> pa.ListArray:
    found = [automaton.spans(t) if t else [] for t in texts]
    rule, start, end, text = zip(*(s for each in found for s in each), strict=True) if any(found) else ((), (), (), ())
    columns = [pa.array(c, kind) for c, kind in ((rule, pa.string()), (start, pa.int32()), (end, pa.int32()), (text, pa.string()))]
    ends = np.cumsum([0, *map(len, found)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, ["rule", "start", "end", "original_text"]))


def word_rules(words: DataFrame, word: str, rule: str | None = None) -> DataFrame:
    """(rule, pattern, ignore_case) of literals that are whole words; ``rule`` names them, else the words do."""
    special = r"([\\.^$*+?{}\[\]|()\-#&~ ])"
    pattern = F.concat(F.lit(r"\b"), F.regexp_replace(word, special, r"\\$1"), F.lit(r"\b"))
    return words.select(F.col(rule or word).alias("rule"), pattern.alias("pattern"), F.lit(False).alias("ignore_case"))


def _tables(rules: DataFrame) -> list[tuple[str, Broadcast]]:
    """The rules that have a pattern, in broadcast parts of at most ``PASS`` characters, each with a name."""
    slim = rules.where("pattern <> '' and rule is not null").select(F.col("rule").cast("string").alias("rule"), "pattern", F.coalesce("ignore_case", F.lit(False)).alias("ignore_case"))
    size = slim.agg(F.coalesce(F.sum(F.length("pattern") + F.length("rule")), F.lit(0))).first()[0]
    passes = -(-size // PASS) or 1
    out = []
    for k in range(passes):
        part = slim if passes == 1 else slim.where(F.pmod(F.xxhash64("rule", "pattern"), F.lit(passes)) == k)
        table = [tuple(r) for r in part.collect()]
        out.append((hashlib.sha256(repr(table).encode()).hexdigest(), rules.sparkSession.sparkContext.broadcast(table)))
    return out


def hits(docs: DataFrame, rules: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """keep, rule, start, end (code points) and original_text of every match of every rule, and the rules' other columns.

    ``rules`` has rule (a name of its own), pattern (in the ``regex`` library's dialect) and
    ignore_case; a user's table is read when the query is built. It is collected and broadcast
    in parts of at most ``PASS`` characters, each a pass over the texts. Rules without a pattern
    and empty matches go; null texts match nothing.
    """
    tables, found = _tables(rules), None
    for key, shared in tables:
        one = docs.select(*keep, F.inline(_spans(key, shared)(F.col(text))))
        found = one if found is None else found.unionByName(one)
    others = [c for c in rules.columns if c not in ("rule", "pattern", "ignore_case")]
    if not others:
        return found
    about = rules.select(F.col("rule").cast("string").alias("rule"), *others)
    return found.join(F.broadcast(about) if len(tables) == 1 else about, "rule").select(*keep, "rule", "start", "end", "original_text", *others)


#: Ids of several rows that tasks hold; of more, every id goes on with its counts.
REPEATED = 1 << 14
#: Words or rules that a task counts before it sends the counts on, and rows that are sent together.
COUNTED, ROWS = 1 << 18, 1 << 13


def counted(docs: DataFrame, rules: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(rule, docs, hits): in how many different keys each rule of ``hits`` matches, and how often, for those that match.

    A task adds up what its rows with a key of their own hold; only keys of several rows go on one by one.
    Words of the texts are counted whatever the rules are, and then meet the rules that are whole words in a join.
    """
    spark = docs.sparkSession
    several = docs.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key)
    ids = [r[0] for r in several.limit(REPEATED + 1).collect()]
    repeated = None if len(ids) > REPEATED else spark.sparkContext.broadcast(frozenset(ids))
    kind = docs.schema[key].dataType.simpleString()

    def tallied(found_in, column: str) -> DataFrame:
        """Counts of what ``found_in()`` finds in a text, under the name ``column``."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            find, own, n_docs, n_hits, out, of_key = found_in(), None if repeated is None else repeated.value, Counter(), Counter(), [], None

            def sent(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
                types = (pa.string(), of_key, pa.int64(), pa.int64())
                for k in range(0, len(rows), ROWS):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + ROWS], strict=True), types, strict=True)], [column, key, "docs", "hits"])

            for batch in batches:
                of_key = batch.schema.field(0).type
                for k, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    found = find(t) if (t := t.as_py()) else []
                    if k is not None and (own is None or k in own):
                        out += [(name, k, 1, n) for name, n in Counter(found).items()]
                    else:
                        n_hits.update(found)
                        n_docs.update(set(found) if k is not None else ())
                    if len(n_hits) >= COUNTED or len(out) >= COUNTED:
                        yield from sent(out + [(name, None, n_docs[name], n) for name, n in n_hits.items()])
                        n_docs, n_hits, out = Counter(), Counter(), []
            yield from sent(out + [(name, None, n_docs[name], n) for name, n in n_hits.items()])

        return docs.select(key, text).mapInArrow(run, f"{column} string, `{key}` {kind}, docs long, hits long")

    @F.pandas_udf("string")
    def word(patterns: pd.Series, any_case: pd.Series) -> pd.Series:
        return pd.Series([None if i else whole_word(p) for p, i in zip(patterns, any_case, strict=True)], dtype=object)

    some = rules.where("pattern <> '' and rule is not null").select(F.col("rule").cast("string").alias("rule"), "pattern", F.coalesce("ignore_case", F.lit(False)).alias("ignore_case"))
    # few bytes are much work, so they get a number of partitions of their own
    known = cut(some.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).withColumn("_word", word("pattern", "ignore_case")), "rules")
    found = tallied(lambda: _WORDS.findall, "_word").join(known.where("_word is not null").select("rule", "_word"), "_word").drop("_word")
    others = known.where("_word is null").drop("_word")
    for name, shared in [] if others.isEmpty() else _tables(others):
        spans = lambda name=name, shared=shared: lambda t, a=_automaton(name, shared.value): [s[0] for s in a.spans(t)]
        found = found.unionByName(tallied(spans, "rule"))
    each = found.groupBy("rule", key).agg(F.sum("docs").alias("docs"), F.sum("hits").alias("hits"))
    return each.groupBy("rule").agg(F.sum(F.when(F.col(key).isNull(), F.col("docs")).otherwise(1)).alias("docs"), F.sum("hits").alias("hits"))
