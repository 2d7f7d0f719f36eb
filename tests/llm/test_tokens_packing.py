import pickle
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexmill.llm.packing import cuts, pack, solve
from lexmill.llm import tokens
from lexmill.llm.tokens import Cache, Lengths, encoder, frequent_lengths, length_of, token_counts
from tests.llm.helpers import empty_docs, odd_docs, odd_rows, with_clashes

JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOK = Tokenizer.from_file(JSON)


def exact(text):
    return TOK.encode(text or "", add_special_tokens=False).ids


def strange(n, seed=3):
    r = random.Random(seed)
    parts = [*"ab Zé'’ \n\t  .,!?0١²Ⅷ中文字 　😀éñß-_<|>\x00\x7f", "<|endoftext|>", "'s", "'ll ", " <|endoftext|> ", "the", "ing"]
    return ["".join(r.choice(parts) for _ in range(r.randint(1, 30))) for _ in range(n)]


def test_counts_equal_the_library(spark):
    got = token_counts(odd_docs(spark), JSON).collect()
    want = sorted((i if i is not None else -1, len((t or "").encode()), len(exact(t)), len(exact(t)) > 512) for i, t, *_ in odd_rows())
    assert sorted((r[0] if r[0] is not None else -1, r[1], r[2], r[3]) for r in got) == want


def test_counts_of_strange_texts():
    cache = Cache(encoder(JSON), len)
    for t in strange(3000):
        assert length_of(t, cache) == len(exact(t)), repr(t)


def test_table_of_lengths_equals_a_dictionary(monkeypatch):
    words = {w: 1 + k % 300 for k, w in enumerate({w for t in strange(4000, seed=5) for w in t.split(" ")})}
    known = dict(list(words.items())[::2])
    table = Lengths(known)
    assert len(table) == len(known) and len(pickle.dumps(table)) < sum(len(w.encode()) for w in known) + 30 * len(known) + 1000
    assert all(table.get(w) == known.get(w) for w in words)
    assert Lengths({}).get("a") is None
    # all keys in one chain of slots
    monkeypatch.setattr(tokens.zlib, "crc32", lambda key: 7)
    few = dict(list(words.items())[:60])
    table = Lengths(few)
    assert all(table.get(w) == few.get(w) for w in words)


def test_frequent_words_of_a_bounded_sample(spark, monkeypatch):
    docs = spark.range(4000, numPartitions=40).selectExpr("id AS doc_id", "concat('x ', 'often ', 'word', id % 7, ' once', id) AS text")
    table = frequent_lengths(docs, JSON)
    assert table.get("often") == len(exact(" often")) and table.get("word3") == len(exact(" word3"))
    assert table.get("once5") is None and len(table) == 8
    assert len(frequent_lengths(docs, RANKS)) == 0
    # a part of too many characters is left off early, and counts stay the same
    monkeypatch.setattr(tokens, "PART_CHARS", 10)
    assert len(frequent_lengths(docs, JSON)) <= 8
    assert token_counts(docs, JSON).where("doc_id = 3").first()["n_tokens"] == len(exact("x often word3 once3"))


def test_both_vocabulary_files_give_the_same_ids():
    for t in strange(3000, seed=9):
        assert encoder(RANKS).array(t).tolist() == exact(t), repr(t)


def test_other_vocabularies(spark):
    for name in ("word_bpe_49k.json", "piece_bpe_32k.model"):
        enc = encoder(public_tokenizers.path(name))
        got = token_counts(odd_docs(spark).where("doc_id = 4"), public_tokenizers.path(name)).first()
        assert got["n_tokens"] == len(enc.ids(odd_rows()[3][1]))
    with pytest.raises(ValueError):
        encoder("vocabulary.unknown")


def test_counts_of_empty_table_and_clashing_columns(spark):
    assert token_counts(empty_docs(spark), JSON).count() == 0
    out = token_counts(with_clashes(odd_docs(spark), "n_tokens", "n_bytes", "over_limit"), JSON)
    assert out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and out.count() == len(odd_rows())


@pytest.mark.parametrize("path", [JSON, RANKS])
def test_pieces_round_trip(spark, path):
    docs = odd_docs(spark).where("doc_id is not null").dropDuplicates(["doc_id"]).coalesce(1)
    pieces = defaultdict(list)
    windows = defaultdict(list)
    for r in with_clashes(docs, "ids", "start").select(*docs.columns).transform(lambda d: pack(d, path, window=256)).collect():
        ids = np.frombuffer(bytes(r["ids"]), "<u4")
        assert len(ids) == r["length"] > 0
        pieces[r["doc_id"]].append((r["start"], ids, r["doc_tokens"]))
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t, *_ in odd_rows():
        if i is not None:
            got = sorted(pieces[i], key=lambda p: p[0])
            assert np.concatenate([p[1] for p in got]).tolist() == [*exact(t), 1]
            assert all(p[2] == len(exact(t)) + 1 for p in got)
    for w in windows.values():
        at = 0
        for offset, n in sorted(w):
            assert offset == at
            at += n
        assert at <= 256


def test_packing_of_empty_tables_and_no_end(spark):
    assert pack(empty_docs(spark), RANKS).count() == 0
    assert pack(odd_docs(spark).where("doc_id in (1, 2)"), RANKS, end_id=None).count() == 0


def brute(pos, pen, window):
    pos, pen = [0, *pos], [0, *pen]
    best = [0.0] + [float("inf")] * (len(pos) - 1)
    for j in range(1, len(pos)):
        for i in range(j):
            n = pos[j] - pos[i]
            if n <= window:
                free = n & (n - 1) == 0 and n >= 256
                best[j] = min(best[j], best[i] + (0 if free else window - n) + pen[j])
    return best[-1]


def cost(cuts, pos, pen, window):
    penalty, total, start = dict(zip(pos, pen, strict=True)), 0.0, 0
    for c in cuts:
        n = c - start
        assert 0 < n <= window
        total += penalty[c] + (0 if n & (n - 1) == 0 and n >= 256 else window - n)
        start = c
    return total


def test_program_finds_the_least_cost():
    r = random.Random(4)
    for _ in range(150):
        pos, at = [], 0
        for _ in range(r.randint(1, 60)):
            at += r.randint(1, 200)
            pos.append(at)
        pen = [r.choice([0.0, 4.0, 32.0]) for _ in pos]
        cuts = solve(pos, pen, 512)
        assert cuts[-1] == pos[-1]
        assert cost(cuts, pos, pen, 512) == pytest.approx(brute(pos, pen, 512))


def test_sentences_are_broken_only_in_long_stretches():
    ends, opens = np.zeros(10, bool), np.zeros(10, bool)
    ends[3], opens[4] = True, True
    ids = np.array([1, 3, 4, *[2] * 20, 3, 4, *[2] * 8, 1], "<u4")
    pos, pen = cuts(ids, ends, opens, stretch=12, stride=5, sentence=1.0, hard=9.0)
    assert pos.tolist() == [2, 7, 12, 17, 22, 24, len(ids)] and pen.tolist() == [1, 9, 9, 9, 9, 1, 0]


def test_windows_end_with_sentences(spark):
    text = " ".join("The boats came in early and had fish." if k % 3 else "All of them, and the market opened at noon!" for k in range(900))
    rows = pack(spark.createDataFrame([(1, text)], "doc_id long, text string"), RANKS).collect()
    last = [TOK.decode(np.frombuffer(bytes(r["ids"]), "<u4").tolist(), skip_special_tokens=False) for r in rows]
    assert len(last) > 3 and all(t.rstrip()[-1] in ".!" for t in last[:-1])


def test_frequent_pre_tokens_change_no_count(spark):
    from lexmill.llm import tokens

    docs = odd_docs(spark).unionByName(odd_docs(spark))
    table = tokens.frequent_lengths(docs, JSON)
    assert table and all(n == len(exact(" " + w)) for w, n in table.items()) and len(set(table.values())) > 3
    count = lambda first: sorted(map(str, docs.select(tokens.token_lengths(spark, JSON, first)("text")).collect()))
    assert count(table) == count(None)
    assert tokens.frequent_lengths(empty_docs(spark), JSON) == {} == tokens.frequent_lengths(docs, public_tokenizers.path("piece_bpe_32k.model"))


def test_little_padding_and_checksums(spark):
    from lexmill.llm.queries import op2_packing

    sf = "/root/testdata/sf0.001"
    rows = op2_packing(spark, sf).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    sizes = [r["n"] for r in rows]
    padding = sum(2048 - n for n in sizes if n & (n - 1))
    assert padding / (sum(sizes) + padding) < 0.02
    first = op2_packing(spark, sf).where("start = 0 and length = doc_tokens").limit(20).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in first:
        ids = np.array([*exact(texts[r["doc_id"]]), 1], "<u4")
        assert zlib.crc32(ids.tobytes()) == r["ids_crc32"]


def test_long_runs_of_white_space(spark):
    """Texts that the faster library refuses are packed with the ids of the other, and do not lose their neighbours."""
    import public_tokenizers

    from lexmill.llm import packing, tokens

    texts = ["x" + " " * 2_000_000 + "y", "\n" * 1_000_000, "plain text", " \n\t" * 50_000, "a" + " " * 99_999 + "b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    exact = tokens.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")).collect()
    for k, t in enumerate(texts):
        own = sorted((p for p in pieces if p["doc_id"] == k), key=lambda p: p["start"])
        assert np.frombuffer(b"".join(p["ids"] for p in own), "<u4").tolist() == [*exact.ids(t), 1]
    counts = {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()}
    assert counts == {k: len(exact.ids(t)) for k, t in enumerate(texts)}
