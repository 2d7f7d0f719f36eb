import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lexmill.llm import _common, exact, importance, trie
from lexmill.llm._common import drop_table, positions, running
from tests.llm.helpers import empty_docs, odd_docs, odd_rows, with_clashes, words


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


def plain_exact(rows):
    """Rows of (doc_id, text): what stays is the largest id of a text, of rows that share it one."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[sha(t)].append(i)
    keep = {d: max((i for i in ids if i is not None), default=None) for d, ids in groups.items()}
    out = Counter((i, keep[sha(t)], len(groups[sha(t)]), sha(t)) for i, t in rows)
    return keep, out


def checked_exact(rows, got):
    keep, want = plain_exact(rows)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len(keep) and all(r["doc_id"] == r["keep_id"] for r in kept)


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_exact_duplicates_of_odd_rows(spark, batches):
    rows = [(r[0], r[1]) for r in odd_rows()] + [(100 + k, words(k % 4, 5)) for k in range(40)] + [(-5, words(1, 5)), (None, words(2, 5)), (None, None)]
    docs = with_clashes(spark.createDataFrame(rows, "doc_id long, text string"), "digest", "row", "keep_id", "n")
    name = f"exact_{batches}_{random.randrange(1 << 40)}"
    index = exact.DigestIndex(spark, name, 4, f"{_common.shared_dir(spark)}/{name}")
    checked_exact(rows, exact.exact_classes(docs, index, batches=batches).collect())
    drop_table(spark, name)
    checked_exact(rows, exact.exact_duplicates(docs).collect())
    assert exact.exact_duplicates(empty_docs(spark)).count() == 0
    assert exact.exact_duplicates(odd_docs(spark)).count() == len(odd_rows())


def test_index_outlives_batches(spark):
    name = f"exact_index_{random.randrange(1 << 40)}"
    path = f"{_common.shared_dir(spark)}/{name}"
    table = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    first = exact.exact_classes(table([(1, "a"), (2, "a"), (3, "b")]), exact.DigestIndex(spark, name, 4, path)).collect()
    assert sorted((r["doc_id"], r["keep_id"], r["kept"]) for r in first) == [(1, 2, False), (2, 2, True), (3, 3, True)]
    again = exact.exact_classes(table([(9, "a"), (8, "c"), (7, "c")]), exact.DigestIndex(spark, name, 4, path)).collect()
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in again) == [(7, 8, 2, False), (8, 8, 2, True), (9, 2, 1, False)]
    stored = exact.DigestIndex(spark, name).table
    assert sorted(r["keep_id"] for r in stored.collect()) == [2, 3, 8]
    spec = {r["col_name"].strip(): r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {name}").collect()}
    assert spec["Num Buckets"] == "4" and "digest" in spec["Bucket Columns"] and "digest" in spec["Sort Columns"]
    drop_table(spark, name)


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_positions(spark, keys):
    r = random.Random(2)
    rows = [(0 if r.random() < 0.6 else r.randrange(30), r.choice([None, *range(9)]), n) for n in range(700)]
    got = positions(spark.createDataFrame(rows, "k int, a int, n int"), [F.col("a").asc_nulls_first(), F.col("n")], keys).collect()
    order = lambda x: (x[0] if keys else 0, x[1] is not None, x[1] or 0, x[2])
    count, want = Counter(), {}
    for x in sorted(rows, key=order):
        count[x[0] if keys else 0] += 1
        want[x] = count[x[0] if keys else 0]
    assert {(x["k"], x["a"], x["n"]): x["pos"] for x in got} == want


@pytest.mark.parametrize("backwards", [False, True])
def test_running_sums_in_chunks(spark, monkeypatch, backwards):
    monkeypatch.setattr(_common, "CHUNK", 7)
    r = random.Random(3)
    rows = [(k, p, r.randrange(100), r.randrange(100)) for k, n in ((1, 60), (2, 3), (3, 15)) for p in range(1, n)]
    got = running(spark.createDataFrame(rows, "k long, p long, x long, y long"), "k", "p", ["x", "y"], backwards).collect()
    ahead = lambda a, b: a[0] == b[0] and (a[1] >= b[1] if backwards else a[1] <= b[1])
    assert sorted(map(tuple, got)) == sorted((b[0], b[1], sum(a[2] for a in rows if ahead(a, b)), sum(a[3] for a in rows if ahead(a, b))) for b in rows)


def plain_trie(rows, every=100, at_most=6):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            digest = hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest()
            turns[c].append((turn is not None, turn or 0, role or "", digest, text or ""))
    turns = {c: [(t[2], t[4]) for t in sorted(v)] for c, v in turns.items()}
    built = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % at_most
        base = turns.get(c - int(math.fmod(c, every)), [])
        built[c] = base[:h] + turns[c][h:]
    nodes = defaultdict(set)
    for c, t in built.items():
        for d in range(len(t) + 1):
            nodes[tuple(t[:d])].add(c)
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        children = [p for p in below if len(p) == len(path) + 1]
        leaves = sum(not any(q[: len(p)] == p and len(q) == len(p) + 1 for q in nodes) for p in below)
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1]) for p in below if p)
        ends = ",".join(str(c) for c in sorted(members) if len(built[c]) == len(path))
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), len(children), leaves, saved, sha(ends)))
    return sorted(out, key=str)


TURNS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("seed", range(3))
def test_trie_of_odd_conversations(spark, seed, monkeypatch):
    monkeypatch.setattr(trie, "IDS", 3)
    monkeypatch.setattr(_common, "CHUNK", 4)
    r = random.Random(seed)
    said = ["a", "b", "", None, "ü😀", "long " * 20]
    rows = []
    for c in [*range(0, 40), *range(100, 130), 205, 206, 310, -3, -105, 1000]:
        for k in range(r.choice([1, 2, 3, 7, 14])):
            rows.append((c, None if r.random() < 0.05 else k, r.choice(["user", "assistant", None, ""]) if r.random() < 0.3 else "user", r.choice(said) if r.random() < 0.6 else "a"))
    rows += rows[5:9] + [(None, 0, "user", "lost")]
    table = with_clashes(spark.createDataFrame(rows, TURNS), "pos", "digest", "n", "owner")
    turns, members = trie.with_shared_heads(trie.numbered_turns(table), 100, 6)
    got = [tuple(x) for x in trie.prefix_trie(turns, members).collect()]
    assert sorted(got, key=str) == plain_trie(rows)


def test_trie_edge_cases(spark):
    for rows in ([], [(7, 1, "user", "alone")], [(c, 0, "user", "same") for c in range(50)], [(c, k, "user", str(c >> k)) for c in range(64) for k in range(7)]):
        turns, members = trie.with_shared_heads(trie.numbered_turns(spark.createDataFrame(rows, TURNS)), 100, 6)
        assert sorted((tuple(x) for x in trie.prefix_trie(turns, members).collect()), key=str) == (plain_trie(rows) if rows else [])


def plain_importance(docs, target, buckets, percent, least, seed):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def features(t):
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(lower))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in (1, 2, 3) for i in range(len(w) - k + 1)]

    each = [features(t) for _, t in docs]
    s, t = Counter(b for _, f in each for b in f), Counter(b for x in target for b in features(x)[1])
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets)))) for b in range(buckets)]
    out = []
    for (i, _), (n, f) in zip(docs, each, strict=True):
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n >= least])
    may = sorted((x for x in out if x[5]), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    for k, x in enumerate(may[: len(may) * percent // 100]):
        x[4] = k + 1
    return sorted((tuple(x[:5]) for x in out), key=str)


@pytest.mark.parametrize("piece", [importance.PIECE, 40])
def test_importance_of_odd_rows(spark, monkeypatch, piece):
    monkeypatch.setattr(importance.bucket_counts, "__defaults__", (piece,))
    rows = [(r[0], r[1]) for r in odd_rows()] + [(20 + k, words(k, 30) + " ÄÖ x2y NUL\x00end don't") for k in range(60)]
    target = [None, "", words(3, 60), words(5, 25), "ÄÖ x2y"]
    docs = with_clashes(spark.createDataFrame(rows, "doc_id long, text string"), "score", "weight", "n", "sums", "bucket")
    bench = with_clashes(spark.createDataFrame([(t,) for t in target], "text string"), "nothing", "doc_id")
    got = importance.importance_sample(docs, bench, buckets=97, percent=30, least_words=20, seed=42).collect()
    assert sorted((tuple(x) for x in got), key=str) == plain_importance(rows, target, 97, 30, 20, 42)


def test_importance_of_empty_tables(spark):
    docs, none = spark.createDataFrame([(1, words(1, 30)), (2, words(2, 30))], "doc_id long, text string"), spark.createDataFrame([], "text string")
    got = importance.importance_sample(docs, none, buckets=50, percent=50, least_words=5, seed=1).collect()
    assert sorted((tuple(x) for x in got), key=str) == plain_importance([(1, words(1, 30)), (2, words(2, 30))], [], 50, 50, 5, 1)
    assert importance.importance_sample(empty_docs(spark), none, buckets=50, percent=50, least_words=5, seed=1).count() == 0


def test_pieces_make_up_texts():
    r = random.Random(1)
    for size in (1, 5, 40):
        text = "".join(r.choice("ab1ü .,\n") for _ in range(300))
        pieces = list(importance._pieces(text, size))
        assert "".join(h for h, _ in pieces) == text
        found = [re.findall("[ab1ü]+", h) for h, _ in pieces]
        assert [w for ws in found for w in ws] == re.findall("[ab1ü]+", text)
        for k, (_, tail) in enumerate(pieces):
            assert tail.split() == [w for ws in found[k + 1 :] for w in ws][:2] or k == len(pieces) - 1
