"""Fuzzy matching: candidates by blocking, string ratios in vectorised functions, one-to-one assignment.

Ratios are those of ``difflib.SequenceMatcher`` with its argument order (a, b); greedy choices
take the highest ratio first and, of equals, the earliest pair; optimal choices maximise the sum.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Callable, Iterable, Iterator, Sequence
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import text as X
from lexmill.operators.counting import Members
from lexmill.operators.graph import components
from lexmill.operators.spread import cut, join_spread, once


def ratio(a: Column | str, b: Column | str) -> Column:
    """Ratcliff-Obershelp similarity of two texts; null counts as empty."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(_ratios(x.fillna("").tolist(), y.fillna("").tolist()), dtype="float64")

    return run(a, b)


def _ratios(x: list[str], y: list[str]) -> list[float]:
    """Ratio of each pair; the pairs of one second text come one after the other, as it is indexed once."""
    out, m = [0.0] * len(x), SequenceMatcher(None)
    for k in sorted(range(len(y)), key=y.__getitem__):
        if m.b != y[k]:
            m.set_seq2(y[k])
        m.set_seq1(x[k])
        out[k] = _ratio(m, 0.0)
    return out


def lcs_ratio(a: Column | str, b: Column | str) -> Column:
    """Longest common subsequence over the longer length."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([_lcs(p or "", q or "") for p, q in zip(x, y, strict=True)])

    return run(a, b)


def _lcs(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    short, long = sorted((a, b), key=len)
    return float(_long(short, long)) / len(long)


def word_diff(a: Column | str, b: Column | str) -> Column:
    """Edit steps between two texts, word by word."""

    @F.pandas_udf("array<struct<tag:string,a:string,b:string>>")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(x, y, strict=True):
            p, q = (p or "").split(), (q or "").split()
            steps = SequenceMatcher(None, p, q, autojunk=False).get_opcodes()
            out.append([{"tag": t, "a": " ".join(p[i:j]), "b": " ".join(q[k:m])} for t, i, j, k, m in steps])
        return pd.Series(out)

    return run(a, b)


def edit_script(a: str, b: str) -> list[tuple[str, str]]:
    """Runs of (equal, delete or insert, text) that turn a into b, with the fewest characters deleted and inserted.

    Halves of a meet the place of b where their longest common subsequences add up to most; the
    lengths for all places at once are the bits of one number, so memory is linear.
    """
    out: list[tuple[str, str]] = []

    def put(tag: str, text: str) -> None:
        if text:
            if out and out[-1][0] == tag:
                out[-1] = (tag, out[-1][1] + text)
            else:
                out.append((tag, text))

    work = [(a, b)]
    while work:
        a, b = work.pop()
        if a == b:
            put("equal", a)
        elif not a or not b:
            put("delete", a)
            put("insert", b)
        elif len(a) == 1:
            k = b.find(a)
            if k < 0:
                put("delete", a)
            else:
                put("insert", b[:k])
                put("equal", a)
            put("insert", b[k + 1 :])
        else:
            same = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            if same:
                put("equal", a[:same])
                work.append((a[same:], b[same:]))
                continue
            half = len(a) // 2
            ahead, behind = _common_with_starts(a[:half], b), _common_with_starts(a[half:][::-1], b[::-1])[::-1]
            k = int(np.argmax(ahead + behind))
            work += [(a[half:], b[k:]), (a[:half], b[:k])]
    # a deletion goes before the insertion beside it
    tidy: list[tuple[str, str]] = []
    for equal, runs in itertools.groupby(out, key=lambda r: r[0] == "equal"):
        if equal:
            tidy += runs
        else:
            texts = {"delete": "", "insert": ""}
            for tag, text in runs:
                texts[tag] += text
            tidy += [(tag, text) for tag, text in texts.items() if text]
    return tidy


def _common_with_starts(a: str, b: str) -> np.ndarray:
    """Length of the longest common subsequence of a and the first k characters of b, for k from 0."""
    masks: dict[str, int] = {}
    for k, c in enumerate(b):
        masks[c] = masks.get(c, 0) | 1 << k
    full = (1 << len(b)) - 1
    v = full
    for c in a:
        u = v & masks.get(c, 0)
        v = ((v + u) | (v - u)) & full
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


#: Rows whose diffs are Python objects at the same time.
DIFFS = 64


def char_diff(a: Column | str, b: Column | str) -> Column:
    """Runs of characters that are equal, deleted and inserted between two texts (tag, text); null counts as empty."""
    @F.arrow_udf("array<struct<tag:string,text:string>>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        yield from _diff_batches(batches)

    return run(a, b)


def _diff_batches(batches: Iterable[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for x, y in batches:
        yield pa.concat_arrays([_diffs(x.slice(k, DIFFS).to_pylist(), y.slice(k, DIFFS).to_pylist()) for k in range(0, max(len(x), 1), DIFFS)])


def _diffs(a: list[str | None], b: list[str | None]) -> pa.ListArray:
    scripts = [edit_script(p or "", q or "") for p, q in zip(a, b, strict=True)]
    ends = np.cumsum([0, *map(len, scripts)])
    runs = pa.StructArray.from_arrays([pa.array([r[k] for s in scripts for r in s], pa.string()) for k in (0, 1)], ["tag", "text"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), runs)


def marked(diff: Column, delete: tuple[str, str] = ("[-", "-]"), insert: tuple[str, str] = ("{+", "+}")) -> Column:
    """A diff as one text, what is deleted and inserted between marks."""
    around = lambda d, m: F.concat(F.lit(m[0]), d["text"], F.lit(m[1]))
    return F.array_join(F.transform(diff, lambda d: F.when(d["tag"] == "delete", around(d, delete)).when(d["tag"] == "insert", around(d, insert)).otherwise(d["text"])), "")


def side_of(diff: Column, other: str) -> Column:
    """One of the two texts of a diff: all of it but the runs tagged ``other``."""
    return F.array_join(F.transform(F.filter(diff, lambda d: d["tag"] != other), lambda d: d["text"]), "")


def candidates(a: DataFrame, b: DataFrame, block: str, text: str = "text", least_length: float = 0.4, n: int = 3, least_jaccard: float = 0.3) -> DataFrame:
    """Pairs of one block of like length whose n-gram sets have a Jaccard of ``least_jaccard`` or more.

    (block, a_idx, b_idx, a_text, b_text). This is a condition of its own, which a memory's fuzzy
    search states; it is not implied by a ratio, for which see ``alike``. Sets that are so alike share one of their rarest
    n-grams, so only those meet: of m n-grams all but the commonest ``least_jaccard`` m - 1.
    In prose most n-grams are in a large part of all texts, so sides of which one has at most
    ``MEMBERS`` rows a pass, in at most ``PASSES``, meet in the tasks of the other, counted at once.
    """
    if n <= 3:
        sizes = [rows.agg(F.count("*"), F.coalesce(F.sum(F.length(text)), F.lit(0))).first() for rows in (a, b)]
        passes = [max(-(-rows // MEMBERS), -(-letters // LETTERS), 1) for rows, letters in sizes]
        if min(passes) <= PASSES:
            return _candidates_of_few(a, b, block, text, least_length, n, least_jaccard, passes[0] < passes[1], min(passes))
    grams = X.char_ngrams(X.compact(F.col(text)), n)
    whole = lambda rows, s: rows.select(block, F.lit(s).alias("side"), F.col("idx").cast("long").alias("idx"), F.col(text).alias("text"), grams.alias("grams"))
    left, right = whole(a, "a"), whole(b, "b")
    slim = [block, "side", "idx", F.length("text").alias("len"), F.size("grams").alias("m"), F.explode("grams").alias("gram")]
    dealt = left.select(*slim).unionByName(right.select(*slim))
    df = cut(dealt.groupBy(block, "gram").agg(F.count("*").alias("df")), "gram-counts")
    total = df.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    rare = join_spread(dealt, df, [block, "gram"], "df", total)
    rank = F.row_number().over(Window.partitionBy(block, "side", "idx").orderBy("df", "gram"))
    rare = rare.withColumn("_r", rank).where(F.col("_r") <= F.col("m") - F.ceil(F.col("m") * least_jaccard) + 1)
    side = lambda s: rare.where(F.col("side") == s).select(block, "gram", F.col("idx").alias(f"{s}_idx"), F.col("len").alias(f"{s}_len"), F.col("m").alias(f"{s}_m"))
    like = (F.least("a_len", "b_len") >= least_length * F.greatest("a_len", "b_len")) & (F.least("a_m", "b_m") >= least_jaccard * F.greatest("a_m", "b_m"))
    met = side("a").join(side("b"), [block, "gram"]).where(like).select(block, "a_idx", "b_idx").distinct()
    texts = lambda rows, s: rows.select(block, F.col("idx").alias(f"{s}_idx"), F.col("text").alias(f"{s}_text"), F.col("grams").alias(f"{s}_grams"))
    pairs = met.join(texts(left, "a"), [block, "a_idx"]).join(texts(right, "b"), [block, "b_idx"])
    common = F.size(F.array_intersect("a_grams", "b_grams"))
    alike = common >= least_jaccard * (F.size("a_grams") + F.size("b_grams") - common)
    return pairs.where(alike).drop("a_grams", "b_grams")


#: Rows, and characters of their texts, that one pass of ``candidates`` compares with all of the other side; and passes at most.
MEMBERS, LETTERS, PASSES = 1 << 12, 1 << 19, 16
#: Pairs that are counted together.
CELLS = 1 << 20


def _candidates_of_few(a: DataFrame, b: DataFrame, block: str, text: str, least_length: float, n: int, least_jaccard: float, few_a: bool, passes: int) -> DataFrame:
    few, many, f, m = (a, b, "a", "b") if few_a else (b, a, "b", "a")
    some = F.col(block).isNotNull() & F.col("idx").isNotNull() & F.col(text).isNotNull()
    side = lambda rows: rows.where(some).select(block, F.col("idx").cast("long").alias("idx"), F.col(text).alias("text"), X.compact(F.col(text)).alias("compact"))
    members = side(few).withColumn("part", F.pmod(F.xxhash64("idx"), F.lit(passes)))
    kind = a.schema[block].dataType.simpleString()
    schema = f"`{block}` {kind}, {m}_idx long, {f}_idx long, {m}_text string, {f}_text string"
    # few bytes are much work, so they get a number of partitions of their own
    wide = side(many.repartition(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    out = None
    for part in range(passes):
        met = _MeetFew(members.where(F.col("part") == part).toArrow(), [block, f"{m}_idx", f"{f}_idx", f"{m}_text", f"{f}_text"], least_length, n, least_jaccard)
        found = wide.mapInArrow(met, schema)
        out = found if out is None else out.unionByName(found)
    return out.select(block, "a_idx", "b_idx", "a_text", "b_text")


def _ngram_codes(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The text and the code of each n-gram of at most 3 characters, repeats included; a shorter text is one n-gram."""
    codes, at = _codes(texts)
    size = np.diff(at)
    grams = np.where(size == 0, 0, np.maximum(size - (n - 1), 1))
    row = np.repeat(np.arange(len(texts)), grams)
    start = at[:-1][row] + np.arange(len(row)) - np.repeat(np.cumsum(grams) - grams, grams)
    padded, code = np.concatenate([codes.astype(np.int64) + 1, np.zeros(n, np.int64)]), np.zeros(len(row), np.int64)
    for k in range(n):
        code = code << 21 | np.where(start + k < at[1:][row], padded[start + k], 0)
    return row, code


class _MeetFew:
    """Pairs of the rows of a task with some members (block, idx, text, compact) whose n-grams are alike."""

    def __init__(self, members: pa.Table, names: list[str], least_length: float, n: int, least_jaccard: float):
        block = names[0]
        self.names, self.block, self.least_length, self.gram, self.least = names, block, least_length, n, least_jaccard
        self.rows = members.select([block, "idx", "text"]).combine_chunks()
        self.blocks = pc.unique(self.rows[block])
        self.block_of = pc.index_in(self.rows[block], value_set=self.blocks).to_numpy()
        self.length = pc.utf8_length(self.rows["text"]).to_numpy()
        row, code = _ngram_codes(members["compact"].to_pylist(), n)
        pairs = sorted(set(zip(code.tolist(), row.tolist(), strict=True)))
        of = {c: [r for _, r in g] for c, g in itertools.groupby(pairs, key=lambda p: p[0])}
        order = sorted(of, key=lambda c: (-len(of[c]), c))
        self.members = Members([of[c] for c in order], len(self.rows))
        self.count = np.bincount([r for _, r in pairs], minlength=len(self.rows))
        place = np.argsort(np.array(order, np.int64), kind="stable")
        self.codes, self.feature = np.array(order, np.int64)[place], place

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not len(self.codes):
            return
        step = max(CELLS // len(self.rows), 16)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                yield from self._met(batch.slice(at, step)).to_batches()

    def _met(self, batch: pa.RecordBatch) -> pa.Table:
        n = batch.num_rows
        row, code = _ngram_codes(batch["compact"].to_pylist(), self.gram)
        code, number = np.unique(code, return_inverse=True)
        pair = np.unique(row * max(len(code), 1) + number)
        row, code = pair // max(len(code), 1), code[pair % max(len(code), 1)]
        count = np.bincount(row, minlength=n)
        place = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        known = self.codes[place] == code
        row, feature = row[known], self.feature[place[known]]
        common = self.members.sums(n, row, feature, [np.ones(len(row))])[0]
        r, k = np.nonzero((common > 0) & (common >= self.least * (count[:, None] + self.count - common)))
        length = pc.utf8_length(batch["text"]).to_numpy()
        block = pc.fill_null(pc.index_in(batch[self.block], value_set=self.blocks), -1).to_numpy(zero_copy_only=False)
        x, y = length[r], self.length[k]
        alike = (np.minimum(x, y) >= self.least_length * np.maximum(x, y)) & (block[r] == self.block_of[k])
        own, other = batch.take(pa.array(r[alike])), self.rows.take(pa.array(k[alike]))
        return pa.table([own[self.block], own["idx"], other["idx"], own["text"], other["text"]], self.names)


def scored(pairs: DataFrame, least: float, score: Column | None = None) -> DataFrame:
    return pairs.withColumn("score", score if score is not None else ratio("a_text", "b_text")).where(F.col("score") >= least)


#: Rows of a side that a piece of work compares with as many of the other.
CHUNK = 512
#: Longest text (the shorter of two) that is compared with many others at once.
LANES = 256
#: Pairs that one sweep compares, all of like length.
TOGETHER = 1 << 13
#: Pairs whose letters allow a ratio, of several pieces of work, that are compared together.
WAITING = 1 << 16


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts end to end, and where each begins."""
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), np.concatenate([[0], ends])


#: Numbered characters that one product of matrices takes.
COLUMNS = 2048


def _numbered(codes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text of each character, and the character with its number in the text: the first e, the second e, ..."""
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    key = row.astype(np.int64) << 21 | codes
    order = np.argsort(key, kind="stable")
    key = key[order]
    fresh = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    number = np.arange(len(key)) - np.repeat(fresh, np.diff(np.concatenate([fresh, [len(key)]])))
    return row[order], (key & ((1 << 21) - 1)) << 32 | number


def common_letters(a: list[str], b: list[str]) -> np.ndarray:
    """For each text of a and of b how many characters they have in common, in any order.

    That is how many numbered characters both have: a product of matrices of zeros and ones.
    """
    (x_row, x), (y_row, y) = (_numbered(*_codes(t)) for t in (a, b))
    both = np.intersect1d(x, y)
    common = np.zeros((len(a), len(b)), np.float32)

    def held(row: np.ndarray, keys: np.ndarray, some: np.ndarray, n: int) -> np.ndarray:
        place = np.minimum(np.searchsorted(some, keys), len(some) - 1)
        here = some[place] == keys
        m = np.zeros((n, len(some)), np.float32)
        m[row[here], place[here]] = 1
        return m

    for k in range(0, len(both), COLUMNS):
        some = both[k : k + COLUMNS]
        common += held(x_row, x, some, len(a)) @ held(y_row, y, some, len(b)).T
    return common.astype(np.int32)


def common_in_order(a: list[str], b: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of a[i] and b[j] for each of the pairs.

    Bit-parallel: a bit for each character of the shorter text, a step for each of the longer
    one, all pairs at once; of two texts over ``LANES`` one pair at a time.
    """
    la, lb = np.fromiter(map(len, a), np.int64, len(a)), np.fromiter(map(len, b), np.int64, len(b))
    out = np.zeros(len(i), np.int64)
    left = la[i] <= lb[j]
    for flag, (short, long, p, q) in ((True, (a, b, i, j)), (False, (b, a, j, i))):
        chosen = np.flatnonzero(left == flag)
        size = (la if flag else lb)[p[chosen]]
        few = chosen[size <= LANES]
        few = few[np.argsort((lb if flag else la)[q[few]], kind="stable")]
        for k in range(0, len(few), TOGETHER):
            at = few[k : k + TOGETHER]
            out[at] = _lanes(short, long, p[at], q[at])
        for k in chosen[size > LANES]:
            out[k] = _long(short[p[k]], long[q[k]])
    return out


def _long(a: str, b: str) -> int:
    masks: dict[str, int] = {}
    for k, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & masks.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _lanes(a: list[str], b: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    rows, i = np.unique(i, return_inverse=True)
    cols, j = np.unique(j, return_inverse=True)
    a, b = [a[k] for k in rows], [b[k] for k in cols]
    x, x_at = _codes(a)
    y, y_at = _codes(b)
    la, lb = np.diff(x_at), np.diff(y_at)
    words = max(1, -(-int(la.max()) // 64))
    letters = np.unique(x)
    mask = np.zeros((len(letters) + 1, len(a), words), np.uint64)  # the last letter is any that a has not
    place = np.arange(len(x)) - np.repeat(x_at[:-1], la)
    np.bitwise_or.at(mask, (np.searchsorted(letters, x), np.repeat(np.arange(len(a)), la), place // 64), np.uint64(1) << (place % 64).astype(np.uint64))
    where = np.minimum(np.searchsorted(letters, y), len(letters) - 1) if len(letters) else np.zeros(len(y), np.int64)
    where = np.where(letters[where] == y, where, len(letters)) if len(letters) else where
    padded = np.full((int(lb.max()) if len(lb) else 0, len(b)), len(letters))
    padded[np.arange(len(y)) - np.repeat(y_at[:-1], lb), np.repeat(np.arange(len(b)), lb)] = where
    order = np.argsort(-lb[j], kind="stable")
    i, j = i[order], j[order]
    n_at = np.searchsorted(-lb[j], -np.arange(len(padded)), side="left")  # pairs whose longer text has a step's character
    v = np.full((words, len(i)), np.iinfo(np.uint64).max, np.uint64)
    for step in range(len(padded)):
        n = int(n_at[step])
        m = mask[padded[step, j[:n]], i[:n]]
        carry = np.zeros(n, np.uint64)
        for w in range(words):
            old = v[w, :n]
            u = old & m[:, w]
            total = old + u
            over = total < old
            total += carry
            over |= total < carry
            v[w, :n] = total | (old - u)
            carry = over.astype(np.uint64)
    found = np.zeros(len(i), np.int64)
    for w in range(words):
        bits = np.clip(la[i] - 64 * w, 0, 64)
        live = np.where(bits == 64, np.iinfo(np.uint64).max, (np.uint64(1) << np.minimum(bits, 63).astype(np.uint64)) - np.uint64(1))
        found += np.bitwise_count(~v[w] & live)
    out = np.empty(len(i), np.int64)
    out[order] = found
    return out


Score = Callable[[str, str], float]
#: Which pairs of two lists of texts a score can bring to a least value: rows by columns.
May = Callable[[list[str], list[str], float], np.ndarray]


Work = tuple[list[str], list[str]]


def near(a: list[str], b: list[str], least: float, score: Score | None = None, may: May | None = None) -> list[tuple[int, int, float]]:
    """All pairs of texts whose ratio is ``least`` or more.

    A ratio is at most twice the characters in common, in any order, over both lengths, and at
    most twice the longest common subsequence; both rule pairs out before a ratio is computed,
    and equal texts are compared once. ``score`` may raise a ratio; it is tried where ``may``
    says that it can, else on all pairs.
    """
    return next(near_each([(a, b)], least, score, may))


def near_each(work: Iterable[Work], least: float, score: Score | None = None, may: May | None = None) -> Iterator[list[tuple[int, int, float]]]:
    """``near`` of each piece of work; the pairs of several are compared together."""
    waiting, size, texts = [], 0, 0
    for a, b in work:
        waiting.append(_able(a, b, least, len(a) * len(b) >= WIDE))
        size += len(waiting[-1][-1])
        texts += len(waiting[-1][0]) + len(waiting[-1][1])
        if size >= WAITING or texts >= WAITING:
            yield from _finish(waiting, least, score, may)
            waiting, size, texts = [], 0, 0
    yield from _finish(waiting, least, score, may)


def _able(a: list[str], b: list[str], least: float, wide: bool = True):
    """Distinct texts of both sides, which each row has, and the pairs whose lengths and letters allow the ratio."""
    if not a or not b:
        return [], [], None, None, np.empty(0, np.int64), np.empty(0, np.int64)
    (xs, x_of), (ys, y_of) = (np.unique(np.array([*t, None], object)[:-1], return_inverse=True) for t in (a, b))
    xs, ys = xs.tolist(), ys.tolist()
    lx, ly = (np.fromiter(map(len, t), np.int64, len(t)) for t in (xs, ys))
    if wide and least < LETTERS_TELL:
        i, j = _all_in_order(xs, ys, lx, ly, least)
    else:
        i, j = np.nonzero(2.0 * common_letters(xs, ys) >= least * (lx[:, None] + ly) - 1e-9)
    return xs, ys, x_of, y_of, i, j


#: Below this ratio characters in any order rule out so few pairs of prose that all are compared in order at once,
#: if they are so many that whole rows of bits are long; those of several small pieces wait for each other instead.
LETTERS_TELL, WIDE = 0.7, 1 << 18
#: Words of 64 bits that one step of ``_all_in_order`` takes.
BITS = 1 << 16


def _all_in_order(a: list[str], b: list[str], la: np.ndarray, lb: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs whose lengths and longest common subsequence allow the ratio.

    Bit-parallel like ``common_in_order``, but texts of a with one number of words meet texts of b of like
    length all with all, so a step reads whole rows of masks.
    """
    found_i, found_j = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    x, x_at = _codes(a)
    y, y_at = _codes(b)
    letters = np.unique(x)
    spot = np.searchsorted(letters, y)
    spot = np.where((spot < len(letters)) & (letters[np.minimum(spot, len(letters) - 1)] == y), spot, len(letters)) if len(letters) else np.zeros(len(y), np.int64)
    own = np.searchsorted(letters, x)
    falling = np.argsort(-lb, kind="stable")
    need = max(least - 1e-9, 0.0) / 2
    for words in np.unique(np.maximum(-(-la // 64), 1)):
        group = np.flatnonzero(np.maximum(-(-la // 64), 1) == words)
        group = group[np.argsort(la[group], kind="stable")]
        size = la[group]
        mask = np.zeros((len(letters) + 1, words, len(group)), np.uint64)
        col, place = np.repeat(np.arange(len(group)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        np.bitwise_or.at(mask, (own[np.repeat(x_at[group], size) + place], place // 64, col), np.uint64(1) << (place % 64).astype(np.uint64))
        live = np.clip(size - 64 * np.arange(words)[:, None], 0, 64)
        live = np.where(live == 64, np.iinfo(np.uint64).max, (np.uint64(1) << np.minimum(live, 63).astype(np.uint64)) - np.uint64(1))
        fits = -lb[falling]
        at = int(np.searchsorted(fits, -np.ceil(size[-1] * (1 - need) / need), side="left")) if need > 0 else 0
        step = max(BITS // (words * len(group)), 1)
        while at < len(falling):
            # rows of like length, so that no long one makes steps for all
            rows = falling[at : min(at + step, int(np.searchsorted(fits, fits[at] * 0.8 + 4, side="right")))]
            at += max(len(rows), 1)
            if not len(rows):
                rows = falling[at - 1 : at]
            high, low = lb[rows[0]], lb[rows[-1]]
            first = int(np.searchsorted(size, np.floor(low * need / (1 - need)), side="left"))
            last = int(np.searchsorted(size, np.ceil(high * (1 - need) / need), side="right")) if need > 0 else len(size)
            if first >= last:
                continue
            common = _rows_in_order(mask[:, :, first:last], live[:, first:last], size[first:last], [spot[y_at[k] : y_at[k + 1]] for k in rows], len(letters))
            r, k = np.nonzero(common >= need * (size[first:last] + lb[rows][:, None]))
            found_i.append(group[first + k])
            found_j.append(rows[r])
    return np.concatenate(found_i), np.concatenate(found_j)


def _rows_in_order(mask: np.ndarray, live: np.ndarray, size: np.ndarray, texts: list[np.ndarray], none: int) -> np.ndarray:
    """Length of the longest common subsequence of each of some texts, of falling length, with each text of the masks."""
    lengths = np.array([len(t) for t in texts])
    spots = np.full((int(lengths[0]), len(texts)), none)
    for k, t in enumerate(texts):
        spots[: len(t), k] = t
    words, mask = mask.shape[1], np.ascontiguousarray(mask)
    v = np.full((words, len(texts), len(size)), np.iinfo(np.uint64).max, np.uint64)
    n_at = np.searchsorted(-lengths, -np.arange(len(spots)), side="left")
    per_word = [np.ascontiguousarray(mask[:, w]) for w in range(words)]
    buffer = np.empty((len(texts), len(size)), np.uint64)
    for step, n in enumerate(n_at.tolist()):
        carry = None
        for w in range(words):
            old, m = v[w, :n], buffer[:n]
            np.take(per_word[w], spots[step, :n], axis=0, out=m, mode="clip")
            np.bitwise_and(m, old, out=m)
            total = old + m
            if words > 1:
                over = total < old
                if carry is not None:
                    total += carry
                    over |= total < carry
                carry = over.astype(np.uint64)
            old -= m
            old |= total
    return size - np.bitwise_count(v & live[:, None, :]).sum(axis=0, dtype=np.int64)


def _finish(waiting: list, least: float, score: Score | None, may: May | None) -> Iterator[list[tuple[int, int, float]]]:
    if not waiting:
        return
    left, right = (list(itertools.chain.from_iterable(w[k] for w in waiting)) for k in (0, 1))
    at = [np.cumsum([0, *(len(w[k]) for w in waiting)]) for k in (0, 1)]
    i, j = (np.concatenate([w[4 + k] + at[k][n] for n, w in enumerate(waiting)]) for k in (0, 1))
    la, lb = (np.fromiter(map(len, t), np.int64, len(t)) for t in (left, right))
    kept = 2.0 * common_in_order(left, right, i, j) >= least * (la[i] + lb[j]) - 1e-9
    begin = 0
    for xs, ys, x_of, y_of, i, j in waiting:
        able = np.zeros((len(xs), len(ys)), bool)
        own = kept[begin : begin + len(i)]
        able[i[own], j[own]] = True
        begin += len(i)
        tried = able if score is None or not xs else able | (may(xs, ys, least) if may else np.True_)
        found: dict[tuple[int, int], float] = {}
        for k in np.flatnonzero(tried.any(0)):
            m = SequenceMatcher(None, "", ys[k])
            for r in np.flatnonzero(tried[:, k]):
                best = score(xs[r], ys[k]) if score else 0.0
                if able[r, k] and best < 1.0:
                    m.set_seq1(xs[r])
                    best = max(best, _ratio(m, least))
                if best >= least:
                    found[int(r), int(k)] = best
        at_x, at_y = (_places(x_of), _places(y_of)) if found else ([], [])
        yield [(p, q, s) for (r, k), s in found.items() for p in at_x[r] for q in at_y[k]]


def _longest(a: str, b: str, alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
    """The longest text that both parts hold, earliest in a, then in b: ``find_longest_match`` where no character is popular."""
    x, y, at, size = a[alo:ahi], b[blo:bhi], 0, 0
    for i in range(len(x)):
        if len(x) - i <= size:
            break
        while i + size < len(x) and x[i : i + size + 1] in y:
            at, size = i, size + 1
    return alo + at, blo + y.find(x[at : at + size]), size


#: Parts up to this length are compared without counting their characters first.
SHORT = 12


def _ratio(m: SequenceMatcher, least: float) -> float:
    """``m.ratio()``, or 0 as soon as the characters that the parts beside the matches share are too few for ``least``."""
    a, b = m.a, m.b
    if not a and not b:
        return 1.0
    wanted = (least - 1e-9) * (len(a) + len(b)) / 2
    matches, waiting, hope = 0, [(0, len(a), 0, len(b), 0)], 0
    while waiting:
        alo, ahi, blo, bhi, most = waiting.pop()
        hope -= most
        i, j, size = m.find_longest_match(alo, ahi, blo, bhi) if m.bpopular else _longest(a, b, alo, ahi, blo, bhi)
        if not size:
            continue
        matches += size
        for part in ((alo, i, blo, j), (i + size, ahi, j + size, bhi)):
            x, y = a[part[0] : part[1]], b[part[2] : part[3]]
            most = min(len(x), len(y))
            if most > SHORT:
                most = sum(min(x.count(c), y.count(c)) for c in set(x))
            if most:
                waiting.append((*part, most))
                hope += most
        if matches + hope < wanted:
            return 0.0
    return 2.0 * matches / (len(a) + len(b))


def _places(of: np.ndarray) -> list[list[int]]:
    order = np.argsort(of, kind="stable")
    return [x.tolist() for x in np.split(order, np.cumsum(np.bincount(of))[:-1])]


def alike(a: DataFrame, b: DataFrame, block: str, least: float, text: str = "text", score: Score | None = None, may: May | None = None, factor: float | None = None, few: str | None = None) -> DataFrame:
    """(block, a_idx, b_idx, score): every pair of one block with a ratio of ``least`` or more.

    If the side that ``few`` names, a or b, is small enough (``PASSES``), it meets the other in that one's tasks.

    The rows are written once. Blocks of at most ``CHUNK`` rows on each side meet whole, after one
    shuffle. A ratio of r means that neither text is over (2 - r) / r times as long as the other, so
    the rows of other blocks are dealt to bands of length that grow by that factor (or by ``factor``,
    where a ``score`` allows more), and only equal and neighbouring bands meet, as a join. They meet
    in pieces of at most about ``CHUNK`` rows of each side, so that a large band is spread over the
    tasks; ``near`` compares a piece.
    """
    if few and (passes := _passes(a if few == "a" else b, text)) <= PASSES:
        return _alike_of_few(a, b, block, least, text, score, may, few == "a", passes)
    grows = factor if score else (2 - least) / least if least > 0.05 else None
    length = F.length("text")
    band = F.lit(0) if grows is None else F.when(length == 0, -9).otherwise(F.floor(F.log(length.cast("double")) / float(np.log(max(1.001 * grows, 1.05))))).cast("int")
    side = lambda rows, n: rows.where(F.col(block).isNotNull()).select(block, F.col("idx").cast("long").alias("idx"), X.text_of(F.col(text)).alias("text"), F.lit(n).alias("_side"))
    rows = cut(side(a, 0).unionByName(side(b, 1)), "sides")
    sizes = rows.groupBy(block).agg(F.count_if(F.col("_side") == 0).alias("_a"), F.count_if(F.col("_side") == 1).alias("_b"))
    large = cut(sizes.where((F.col("_a") > 0) & (F.col("_b") > 0) & (F.greatest("_a", "_b") > CHUNK)).select(block), "large-blocks")
    banded = rows.join(large, block, "left_semi").withColumn("_band", band)
    left, right = banded.where("_side = 0").drop("_side"), banded.where("_side = 1").drop("_side")
    parts = lambda rows, s: rows.groupBy(block, "_band").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias(f"_n{s}")).withColumnRenamed("_band", f"_band{s}")
    met = parts(left, "a").join(parts(right, "b"), block).where(F.abs(F.col("_banda") - F.col("_bandb")) <= 1)

    def dealt(rows: DataFrame, mine: str, other: str, i: str, j: str) -> DataFrame:
        rows = rows.withColumnRenamed("_band", f"_band{mine}").join(met, [block, f"_band{mine}"])
        own = F.pmod(F.xxhash64("idx"), F.col(f"_n{mine}")).cast("int")
        return rows.select(block, "idx", "text", "_banda", "_bandb", own.alias(i), F.explode(F.sequence(F.lit(0), F.col(f"_n{other}") - 1)).alias(j))

    def pieces(frames: Iterator[pd.DataFrame], group: list[str]) -> Iterator[pd.DataFrame]:
        """The rows of each group, which lie together but may be cut between two frames."""
        rest = None
        for f in frames:
            f = f if rest is None else pd.concat([rest, f], ignore_index=True)
            keys = f[group]
            starts = np.flatnonzero((keys != keys.shift()).any(axis=1).to_numpy())
            for k, n in zip(starts[:-1], starts[1:], strict=True):
                yield f.iloc[k:n]
            rest = f.iloc[starts[-1] :] if len(starts) else f
        if rest is not None and len(rest):
            yield rest

    def meet(frames: Iterator[pd.DataFrame], group: list[str]) -> Iterator[pd.DataFrame]:
        names: list[tuple] = []

        def work() -> Iterator[Work]:
            for rows in pieces(frames, group):
                side = rows["_side"].to_numpy()
                left, right = rows[side == 0], rows[side == 1]
                names.append((rows[block].iloc[0], left["idx"].to_numpy(), right["idx"].to_numpy()))
                yield left["text"].tolist(), right["text"].tolist()

        for found in near_each(work(), least, score, may):
            key, x, y = names.pop(0)
            if found:
                yield pd.DataFrame({block: [key] * len(found), "a_idx": [x[i] for i, _, _ in found], "b_idx": [y[j] for _, j, _ in found], "score": [s for _, _, s in found]})

    both = dealt(left, "a", "b", "_i", "_j").withColumn("_side", F.lit(0)).unionByName(dealt(right, "b", "a", "_j", "_i").withColumn("_side", F.lit(1)))
    schema = f"`{block}` {a.schema[block].dataType.simpleString()}, a_idx long, b_idx long, score double"
    # a number of partitions of its own: by their bytes alone the pieces would be put into few tasks
    tasks = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    together = lambda rows, group: rows.repartition(tasks, *group).sortWithinPartitions(*group).mapInPandas(lambda frames: meet(frames, group), schema)
    out = together(rows.join(large, block, "left_anti"), [block])
    return out if large.isEmpty() else out.unionByName(together(both, [block, "_banda", "_bandb", "_i", "_j"]))


#: Rows of the larger side that meet the smaller one at once.
SLICE = 1 << 13


def _passes(rows: DataFrame, text: str) -> int:
    n, letters = rows.agg(F.count("*"), F.coalesce(F.sum(F.length(text)), F.lit(0))).first()
    return max(-(-n // MEMBERS), -(-letters // LETTERS), 1)


def _alike_of_few(a: DataFrame, b: DataFrame, block: str, least: float, text: str, score: Score | None, may: May | None, few_a: bool, passes: int) -> DataFrame:
    few, many = (a, b) if few_a else (b, a)
    side = lambda rows: rows.where(F.col(block).isNotNull()).select(block, F.col("idx").cast("long").alias("idx"), X.text_of(F.col(text)).alias("text"))
    members = side(few).withColumn("_part", F.pmod(F.xxhash64("idx"), F.lit(passes)))
    # few bytes are much work, so they get a number of partitions of their own
    wide = side(many).repartition(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), "idx")
    schema = f"`{block}` {a.schema[block].dataType.simpleString()}, a_idx long, b_idx long, score double"

    def meeting(held: dict) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        most = max((len(idx) for idx, _ in held.values()), default=1)
        step = SLICE if least < LETTERS_TELL else max(min(CELLS // most, SLICE // 4), 16)

        def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names: list[tuple] = []

            def work() -> Iterator[Work]:
                for f in frames:
                    for key, rows in f.groupby(block, sort=False):
                        if key in held:
                            idx, texts = held[key]
                            for k in range(0, len(rows), step):
                                own, own_texts = rows["idx"].to_numpy()[k : k + step], rows["text"].tolist()[k : k + step]
                                names.append((key, idx, own) if few_a else (key, own, idx))
                                yield (texts, own_texts) if few_a else (own_texts, texts)

            for found in near_each(work(), least, score, may):
                key, x, y = names.pop(0)
                if found:
                    yield pd.DataFrame({block: [key] * len(found), "a_idx": [x[i] for i, _, _ in found], "b_idx": [y[j] for _, j, _ in found], "score": [s for _, _, s in found]})

        return meet

    out = None
    for part in range(passes):
        rows = members.where(F.col("_part") == part).select(block, "idx", "text").toPandas()
        found = wide.mapInPandas(meeting({key: (g["idx"].to_numpy(), g["text"].tolist()) for key, g in rows.groupby(block)}), schema)
        out = found if out is None else out.unionByName(found)
    return out


#: Pairs of a block that one task chooses among; blocks of more are chosen in rounds.
GROUP = 1 << 14


def _grouped(rows: DataFrame, by: list[str], block: str, choose: Callable[[list[int], list[int], list[float]], list[int]]) -> DataFrame:
    """The pairs of each group that ``choose`` takes; groups are read in a row instead of being sent as frames of their own."""
    kinds = [rows.schema[c].dataType.simpleString() for c in by]
    plain = all(k not in ("float", "double") for k in kinds)
    schema = f"`{block}` {rows.schema[block].dataType.simpleString()}, a_idx long, b_idx long, score double"
    at, n = by.index(block), len(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, out = None, []

        def flat() -> Iterator[tuple]:
            nonlocal key
            for batch in batches:
                key = batch.schema.field(at).type
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        def made() -> pa.RecordBatch:
            types = (key, pa.int64(), pa.int64(), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], [block, "a_idx", "b_idx", "score"])

        for _, group in itertools.groupby(flat(), key=lambda r: r[:n] if plain else repr(r[:n])):
            pairs = [(r[at], *r[n:]) for r in group]
            out += [pairs[k] for k in choose(*(list(c) for c in list(zip(*pairs, strict=True))[1:]))]
            if len(out) >= TOGETHER:
                yield made()
                out = []
        if out:
            yield made()

    # few bytes are much work, so they get a number of partitions of their own
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slim = rows.select(*by, F.col("a_idx").cast("long").alias("a_idx"), F.col("b_idx").cast("long").alias("b_idx"), F.col("score").cast("double").alias("score"))
    return slim.repartition(tasks, *by).sortWithinPartitions(*by, "a_idx", "b_idx").mapInArrow(run, schema)


def _first_free(a: list[int], b: list[int], score: list[float]) -> list[int]:
    """Pairs of one block taken in order of score, then indexes, where both rows are free."""
    used_a, used_b, keep = set(), set(), []
    for k in sorted(range(len(a)), key=lambda k: (-score[k], a[k], b[k])):
        if a[k] not in used_a and b[k] not in used_b:
            used_a.add(a[k])
            used_b.add(b[k])
            keep.append(k)
    return keep


def _split(rows: DataFrame, block: str) -> tuple[DataFrame, DataFrame, bool]:
    """Rows of blocks of at most ``GROUP`` pairs, the others, and whether there are others."""
    sizes = cut(rows.groupBy(block).agg(F.count("*").alias("_n")).where(F.col("_n") > GROUP).select(block), "large-blocks")
    if sizes.isEmpty():
        return rows, rows.limit(0), False
    return rows.join(sizes, block, "left_anti"), rows.join(sizes, block, "left_semi"), True


def greedy(pairs: DataFrame, block: str) -> DataFrame:
    """One-to-one pairs of each block, best score first, then the earliest indexes.

    Blocks of at most ``GROUP`` pairs are chosen in a task each. In the others each round takes
    every pair that comes first for both of its rows, and besides what the block's first
    ``GROUP`` pairs give in order; both are pairs that the order would take. Then the pairs of
    rows that are taken go, until none is left.
    """
    rows = cut(pairs.where("a_idx is not null and b_idx is not null").select(block, "a_idx", "b_idx", "score"), "pairs")
    few, many, more = _split(rows, block)
    out = _grouped(few, [block], block, _first_free)
    order = [F.desc("score"), F.asc("a_idx"), F.asc("b_idx")]
    key = F.struct((-F.col("score")).alias("s"), "a_idx", "b_idx")
    while more:
        first = lambda side: many.groupBy(block, f"{side}_idx").agg(F.min(key).alias("k")).select(block, "k.a_idx", "k.b_idx", (-F.col("k.s")).alias("score"))  # noqa: B023, E731
        best = first("a").join(first("b").drop("score"), [block, "a_idx", "b_idx"])
        head = many.withColumn("_r", F.row_number().over(Window.partitionBy(block).orderBy(*order))).where(F.col("_r") <= GROUP)
        taken = cut(best.select(block, "a_idx", "b_idx", "score").unionByName(_grouped(head, [block], block, _first_free)).dropDuplicates([block, "a_idx", "b_idx"]), "taken")
        out = out.unionByName(taken)
        old, many = many, cut(many.join(taken.select(block, "a_idx"), [block, "a_idx"], "left_anti").join(taken.select(block, "b_idx"), [block, "b_idx"], "left_anti"), "pairs-left")
        few, many, more = _split(many, block)
        out = out.unionByName(_grouped(few, [block], block, _first_free))
    return out


def optimal(pairs: DataFrame, block: str) -> DataFrame:
    """One-to-one pairs of each block with the greatest sum of scores; unpaired rows score nothing.

    Where the smaller side of a block has m rows, some best choice uses only the m best pairs of
    each row of either side, so the others go: what meets is bounded by the square of the smaller
    side, however large the other. Blocks of over ``GROUP`` pairs that are left fall apart into
    connected components first; each component is chosen by augmenting paths over its pairs.
    """
    rows = cut(pairs.where("score > 0 and a_idx is not null and b_idx is not null").groupBy(block, "a_idx", "b_idx").agg(F.max("score").alias("score")), "pairs")
    few, many, more = _split(rows, block)
    if not more:
        return _grouped(few, [block], block, _best_sum)
    side = many.groupBy(block).agg(F.least(F.count_distinct("a_idx"), F.count_distinct("b_idx")).alias("_m"))
    for one, other in (("a_idx", "b_idx"), ("b_idx", "a_idx")):
        rank = F.row_number().over(Window.partitionBy(block, one).orderBy(F.desc("score"), other))
        many = many.withColumn("_r", rank).join(side, block).where(F.col("_r") <= F.col("_m")).drop("_r", "_m")
    many = cut(many, "best-pairs")
    node = lambda s: F.xxhash64(F.col(block), F.lit(s), F.col(f"{s}_idx"))
    roots = components(many.select(node("a").alias("a"), node("b").alias("b")))
    named = many.withColumn("_node", node("a")).join(roots.select(F.col("node").alias("_node"), F.col("root").alias("_root")), "_node")
    return _grouped(few, [block], block, _best_sum).unionByName(_grouped(named, ["_root", block], block, _best_sum))


def _best_sum(a: list[int], b: list[int], score: list[float]) -> list[int]:
    (x, at_a), (_, at_b) = (np.unique(np.array(i, np.int64), return_inverse=True) for i in (a, b))
    return sorted(assignment(len(x), at_a, at_b, np.array(score)))


def assignment(n: int, a: np.ndarray, b: np.ndarray, gain: np.ndarray) -> list[int]:
    """Of pairs (a, b) with a positive gain those, one to one, with the greatest sum.

    Rows 0 to n - 1 of a enter one by one, each by the shortest augmenting path (reduced costs,
    potentials, a heap) over the pairs alone; a row may also stay without a partner for nothing.
    Memory is that of the pairs, and a step looks only at what its path reaches.
    """
    of: list[list[tuple[int, float, int]]] = [[] for _ in range(n)]
    for k, (i, j, g) in enumerate(zip(a.tolist(), b.tolist(), gain.tolist(), strict=True)):
        of[i].append((j, g, k))
    u = [-max((g for _, g, _ in e), default=0.0) for e in of]
    v: dict[int, float] = {}
    owner: dict[int, int] = {}
    pair: list[int | None] = [None] * n  # the pair that a row has, None for none
    for start in range(n):
        # distances of rows; a column is reached over the pair that names it
        at_row, at_col, over = {start: 0.0}, {}, {}
        u[start] = min([0.0, *(-g - v.get(j, 0.0) for j, g, _ in of[start])])
        heap, end, length = [(0.0, 0, start)], None, 0.0
        done: list[int] = []
        while heap:
            d, what, x = heapq.heappop(heap)
            if what:
                end, length = (what, x), d
                break
            if d > at_row[x]:
                continue
            done.append(x)
            heapq.heappush(heap, (d - u[x], 1, x))  # x stays alone
            for j, g, k in of[x]:
                far = d - g - u[x] - v.get(j, 0.0)
                if k != pair[x] and far < at_col.get(j, np.inf) - 1e-15:
                    at_col[j], over[j] = far, (x, k)
                    if j not in owner:
                        heapq.heappush(heap, (far, 2, j))
                    elif far < at_row.get(owner[j], np.inf):
                        at_row[owner[j]] = far
                        heapq.heappush(heap, (far, 0, owner[j]))
        for x in done:
            u[x] += length - at_row[x]
        for j, d in at_col.items():
            if d < length and j in owner:
                v[j] = v.get(j, 0.0) - (length - d)
        what, x = end
        if what == 1:  # x gives its column to the one before it on the path
            j = None if x == start else next(c for c, _, k in of[x] if k == pair[x])
            pair[x] = None
        else:
            j = x
        while j is not None:
            x, k = over[j]
            left = None if x == start else next(c for c, _, q in of[x] if q == pair[x])
            owner[j], pair[x] = x, k
            j = left
    return [k for k in pair if k is not None]


def exact_pairs(a: DataFrame, b: DataFrame, block: str, text: str = "text") -> DataFrame:
    """Rows with equal texts, the k-th of a text with the k-th."""
    nth = lambda rows: rows.withColumn("_nth", F.row_number().over(Window.partitionBy(block, text).orderBy("idx")))
    side = lambda rows, name: nth(rows).select(block, text, "_nth", F.col("idx").cast("long").alias(name))
    return side(a, "a_idx").join(side(b, "b_idx"), [block, text, "_nth"]).select(block, "a_idx", "b_idx", F.lit(1.0).alias("score"))


def with_exact(a: DataFrame, b: DataFrame, block: str, least: float, text: str = "text") -> DataFrame:
    """Exact pairs first, then greedy fuzzy ones of what is left; both sides and the exact pairs are written once."""
    a, b = once(a, "left"), once(b, "right")
    exact = cut(exact_pairs(a, b, block, text), "exact-pairs")
    rest_a = a.join(exact.select(block, F.col("a_idx").alias("idx")), [block, "idx"], "left_anti")
    rest_b = b.join(exact.select(block, F.col("b_idx").alias("idx")), [block, "idx"], "left_anti")
    return exact.unionByName(greedy(alike(rest_a, rest_b, block, least, text), block))


def by_chapter(a: DataFrame, b: DataFrame, block: str, chapter: str, least: float = 0.80, text: str = "text") -> DataFrame:
    """Exact pairs first, then greedy ones within equal chapters, then of what is left anywhere in the block.

    a and b have a chapter column besides idx and text; null chapters are one.
    """
    within = F.to_json(F.struct(F.col(block).alias("block"), F.coalesce(chapter, F.lit("")).alias("chapter")))
    a, b = once(a, "left"), once(b, "right")
    first = cut(exact_pairs(a, b, block, text), "exact-pairs")
    rest = lambda rows, side, done: rows.join(done.select(block, F.col(f"{side}_idx").alias("idx")), [block, "idx"], "left_anti")
    a1, b1 = rest(a, "a", first), rest(b, "b", first)
    keyed = lambda rows: rows.withColumn("_within", within)
    same = greedy(alike(keyed(a1), keyed(b1), "_within", least, text), "_within")
    names = keyed(a1).select("_within", F.col(block)).distinct()
    same = cut(same.join(names, "_within").select(block, "a_idx", "b_idx", "score"), "chapter-pairs")
    last = greedy(alike(rest(a1, "a", same), rest(b1, "b", same), block, least, text), block)
    return first.unionByName(same).unionByName(last)


def fuzzy_jaccard(pairs: DataFrame, a: DataFrame, b: DataFrame, block: str) -> DataFrame:
    """Similarity of two sides from their pairs, by block: several weightings and the verdict.

    fuzzy = sum of scores / (rows of a + rows of b - pairs); plain counts pairs instead; coverage
    is pairs over the larger side; weighted gives 1 from .99, a half from .70.
    """
    sizes = a.groupBy(block).agg(F.count("*").alias("n_a")).join(b.groupBy(block).agg(F.count("*").alias("n_b")), block, "full").fillna(0, ["n_a", "n_b"])
    points = F.when(F.col("score") >= 0.99, 1.0).when(F.col("score") >= 0.70, 0.5).otherwise(0.0)
    sums = pairs.groupBy(block).agg(F.count("*").alias("pairs"), F.sum("score").alias("total"), F.avg("score").alias("mean"), F.avg(points).alias("weighted"))
    out = sizes.join(sums, block, "left").fillna(0)
    union = F.col("n_a") + F.col("n_b") - F.col("pairs")
    out = out.withColumns(
        {
            "fuzzy": F.round(F.when(union > 0, F.col("total") / union).otherwise(0.0), 4),
            "plain": F.round(F.when(union > 0, F.col("pairs") / union).otherwise(0.0), 4),
            "coverage": F.round(F.col("pairs") / F.greatest("n_a", "n_b"), 4),
            "mean": F.round("mean", 4),
            "weighted": F.round("weighted", 4),
        }
    )
    return out.drop("total").withColumn("verdict", verdict(F.col("fuzzy")))


def verdict(similarity: Column, same: float = 0.80, like: float = 0.60) -> Column:
    return F.when(similarity >= same, "same").when(similarity >= like, "similar").otherwise("different")


BUCKETS = ((1.0, 1.0, "100"), (0.99, 1.0, "99-100"), (0.80, 0.99, "80-99"), (0.70, 0.80, "70-80"), (0.50, 0.70, "50-70"), (0.0, 0.50, "0-50"))


def bucket(similarity: Column) -> Column:
    """The first closed range that holds a similarity."""
    out = None
    for low, high, name in BUCKETS:
        inside = (similarity >= low) & (similarity <= high)
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return out


def aligned_in_order(a: DataFrame, b: DataFrame, block: str, text: str = "text", least: float = 0.5, exact: float = 0.9) -> DataFrame:
    """Each row of a in turn takes the unused row of b most like it, if above ``least``.

    A block is one pair of documents; its rows meet in one task, its size is that of two documents.
    """
    kind, kind_b = dict(a.dtypes), dict(b.dtypes)
    side = lambda rows, n: rows.select(block, F.lit(n).alias("_side"), F.col("idx").cast("long").alias("idx"), X.text_of(F.col(text)).alias("text"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, out = None, []

        def flat() -> Iterator[tuple]:
            nonlocal key
            for batch in batches:
                key = batch.schema.field(block).type
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        def made() -> pa.RecordBatch:
            kinds = (key, pa.int64(), pa.int64(), pa.float64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], [block, "a_idx", "b_idx", "score", "label"])

        for name, rows in itertools.groupby(flat(), key=lambda r: r[0]):
            left, right = [], []
            for _, n, idx, t in rows:
                (right if n else left).append((idx, t))
            out += [(name, i, j, best, "exact" if best > exact else "fuzzy") for i, j, best in _in_turn(left, right, least)]
            if len(out) >= TOGETHER:
                yield made()
                out = []
        if out:
            yield made()

    # few bytes are much work, so they get a number of partitions of their own
    tasks = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = side(a, 0).unionByName(side(b, 1)).repartition(tasks, block).sortWithinPartitions(block, "_side", F.asc_nulls_last("idx"))
    found = rows.mapInArrow(choose, f"`{block}` {kind[block]}, a_idx long, b_idx long, score double, label string")
    return found.select(block, F.col("a_idx").cast(kind["idx"]).alias("a_idx"), F.col("b_idx").cast(kind_b["idx"]).alias("b_idx"), "score", "label")


def _in_turn(left: list[tuple[int, str]], right: list[tuple[int, str]], least: float) -> Iterator[tuple[int, int, float]]:
    """Each of left in turn with the unused one of right most like it; a text of right is indexed once."""
    known: dict[str, SequenceMatcher] = {}
    used = set()
    for i, x in left:
        best, at = least, None
        for j, y in right:
            if j not in used:
                m = known.get(y) or known.setdefault(y, SequenceMatcher(None, "", y))
                m.set_seq1(x)
                if m.real_quick_ratio() > best and m.quick_ratio() > best and (r := _ratio(m, best)) > best:
                    best, at = r, j
        if at is not None:
            used.add(at)
            yield i, at, best


def combined_similarity(edit: Column, bigrams: Column, words: Column) -> Column:
    """.3 edit + .3 word bigrams + .4 word overlap, rounded to 4 digits."""
    return F.round(0.3 * edit + 0.3 * bigrams + 0.4 * words, 4)


def indel_ratio(a: Column | str, b: Column | str) -> Column:
    """Twice the longest common subsequence over both lengths; 1 for two empty texts."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([1.0 if not p and not q else 2 * _lcs(p or "", q or "") * max(len(p or ""), len(q or "")) / (len(p or "") + len(q or "")) for p, q in zip(x, y, strict=True)])

    return run(a, b)


def longest_common(a: Column | str, b: Column | str) -> Column:
    """Length of the longest common substring."""

    @F.pandas_udf("int")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([_common_part(p or "", q or "") for p, q in zip(x, y, strict=True)], dtype="int32")

    return run(a, b)


def _common_part(a: str, b: str) -> int:
    """Runs of a length have numbers, which a run of at most twice the length needs two of: those at its begin and end."""
    numbers, at = _codes([a, b])
    size, cut_at = 1, int(at[1])
    sides = lambda n, k: (n[: max(cut_at - k + 1, 0)], n[cut_at : max(len(n) - k + 1, cut_at)])
    if not len(np.intersect1d(*sides(numbers, 1))):
        return 0
    numbers = np.unique(numbers, return_inverse=True)[1]

    def numbered(k: int) -> np.ndarray:
        out = numbers.copy()  # the last runs are too short and never looked at
        out[: len(out) - (k - size)] = numbers[: len(out) - (k - size)] * len(out) + numbers[k - size :]
        return out

    while 2 * size <= min(cut_at, len(numbers) - cut_at) and len(np.intersect1d(*sides(longer := numbered(2 * size), 2 * size))):
        numbers, size = np.unique(longer, return_inverse=True)[1], 2 * size
    low, high = size, min(2 * size - 1, cut_at, len(numbers) - cut_at)
    while low < high:
        k = (low + high + 1) // 2
        low, high = (k, high) if len(np.intersect1d(*sides(numbered(k), k))) else (low, k - 1)
    return low


def _grams(text: str, n: int) -> set[str]:
    return {text[k : k + n] for k in range(max(len(text) - n + 1, 1))} if text else set()


def _share(a: set[str], b: set[str]) -> float:
    common = len(a & b)
    return common / (len(a) + len(b) - common) if a or b else 0.0


def bigram_jaccard(x: Column, y: Column) -> Column:
    """Jaccard of the sets of two characters in a row; a shorter text is one member, null counts as empty."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_share(_grams(p or "", 2), _grams(q or "", 2)) for p, q in zip(a, b, strict=True)], dtype="float64")

    return run(x, y)


def ngram_likeness(x: Column, y: Column) -> Column:
    """(jaccard, covered): of the sets of two characters in a row, and the share of x's 2, 3 and 4 in a row that y holds."""

    @F.pandas_udf("jaccard double, covered double")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_ngram_likeness(p, q) for p, q in zip(a, b, strict=True)], columns=["jaccard", "covered"])

    return run(x, y)


def _ngram_likeness(a: str, b: str) -> tuple[float, float]:
    every, held = set(), set()
    for n in (2, 3, 4):
        grams = _grams(a, n)
        every |= grams
        held |= grams & _grams(b, n) if len(a) >= n else {g for g in grams if g in b}
    return _share(_grams(a, 2), _grams(b, 2)), len(held) / max(len(every), 1)


def best_of_each(a: Column, b: Column) -> Column:
    """Mean over the texts of an array of the best bigram Jaccard with one of another: 1 where equal, .95 where one holds the other."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([_best_of_each(list(p), list(q)) for p, q in zip(x, y, strict=True)], dtype="float64")

    return run(a, b)


def _best_of_each(a: list[str], b: list[str]) -> float:
    y = [(q, _grams(q, 2)) for q in b]
    total = 0.0
    for p in a:
        grams = _grams(p, 2)
        total += max((1.0 if p == q else 0.95 if p in q or q in p else _share(grams, g) for q, g in y), default=0.0)
    return total / len(a) if a else 0.0


def clause_similarity(a: Column, b: Column, lcs: Column, verbs: Sequence[str] = ()) -> Column:
    """.45 character bigrams + .55 longest common subsequence, or the share of a's n-grams that b holds, if more.

    .95 at least where one holds the other; .05 more for a verb in common; 1 at most, and for equal texts.
    """
    x, y = X.compact(a), X.compact(b)
    like = ngram_likeness(x, y)
    score, covered = 0.45 * like["jaccard"] + 0.55 * lcs, like["covered"]
    some = (F.length(x) > 0) & (F.length(y) > 0)
    score = F.when(F.contains(x, y) | F.contains(y, x), F.greatest(F.lit(0.95), lcs)).otherwise(F.greatest(score, covered))
    shared = F.lit(False)
    for v in verbs:
        shared = shared | (F.contains(x, F.lit(v)) & F.contains(y, F.lit(v)))
    return F.round(F.when(~some, 0.0).when(x == y, 1.0).otherwise(F.least(F.lit(1.0), score + F.when(shared, 0.05).otherwise(0.0))), 4)


def topic_match(a: DataFrame, b: DataFrame, block: str, text: str = "text") -> DataFrame:
    """Titles paired one to one: equal ones first, then those with a ratio of .85 or more."""
    return with_exact(a, b, block, 0.85, text)
