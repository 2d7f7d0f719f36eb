import random
import re

import numpy as np
import pytest
import xxhash

from lexmill.llm import embeddings, simhash
from lexmill.operators.graph import components
from tests.llm.helpers import empty_docs, odd_docs, odd_rows, with_clashes, words


def roots_of(nodes, links):
    parent = {n: n for n in nodes}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    r = random.Random(seed)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(140)] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, k) for k in range(2001, 2080)] + [(5, 5), (None, 7)]
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    linked = [(a, b) for a, b in links if a is not None and a != b]
    want = roots_of({n for e in linked for n in e}, linked)
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_fingerprint(text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    s = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_classes(rows):
    fp = [(i, plain_fingerprint(t)) for i, t in rows]
    links = [(a, b) for a in range(len(fp)) for b in range(a) if (fp[a][1] ^ fp[b][1]).bit_count() <= 2]
    root = roots_of(range(len(fp)), links)
    least = {}
    for k, (i, _) in enumerate(fp):
        if i is not None:
            least[root[k]] = min(i, least.get(root[k], i))
    return sorted((i if i is not None else -1, f"{f:016x}", least.get(root[k])) for k, (i, f) in enumerate(fp))


def test_simhash_on_odd_rows(spark):
    rows = [(i, t) for i, t, *_ in odd_rows()] + [(100 + k, words(50, 200) + " " + words(60 + k, 2)) for k in range(12)]
    docs = with_clashes(spark.createDataFrame(rows, "doc_id long, text string"), "fingerprint", "component_id", "fp")
    got = sorted((r[0] if r[0] is not None else -1, r[1], r[2]) for r in simhash.simhash_classes(docs).collect())
    assert got == plain_classes(rows)
    assert simhash.simhash_classes(empty_docs(spark)).count() == 0


def test_one_row_of_each_group_stays(spark):
    a, b = words(50, 200), words(51, 200)
    rows = [(5, a), (5, b), (7, a), (None, b), (None, words(52, 90)), (None, words(52, 90)), (8, "x" * 3), (8, "x" * 3), (9, b + " " + b)]
    docs = with_clashes(spark.createDataFrame(rows, "doc_id long, text string"), "row", "fp")
    out = simhash.simhash_representatives(docs)
    assert out.columns == docs.columns
    got = sorted((str(r["doc_id"]), r["text"]) for r in out.collect())
    assert got == sorted([("5", a), ("5", b), ("None", words(52, 90)), ("8", "xxx")] + ([("9", rows[8][1])] if (plain_fingerprint(rows[8][1]) ^ plain_fingerprint(b)).bit_count() > 2 else []))
    assert simhash.simhash_representatives(empty_docs(spark)).count() == 0


@pytest.mark.parametrize("paired", [64, 2])
def test_links_with_and_without_hot_keys(spark, monkeypatch, paired):
    monkeypatch.setattr(simhash, "PAIRED", paired)
    r = random.Random(8)
    values = set()
    for _ in range(12):
        base = r.getrandbits(64)
        values.add(base)
        for _ in range(12):
            v = base
            for b in r.sample(range(64), r.randint(1, 4)):
                v ^= 1 << b
            values.add(v)
    signed = [v - (v >> 63 << 64) for v in values]
    want = roots_of(signed, [(a, b) for k, a in enumerate(signed) for b in signed[:k] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2])
    links = simhash.close_links(spark.createDataFrame([(v,) for v in signed], "fp long"))
    found = [(x["a"], x["b"]) for x in links.collect()]
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 2 for a, b in found)
    got = roots_of(signed, found)
    assert got == want


def plain_embeddings(rows, least):
    fine = {}
    for k, (_, v, label) in enumerate(rows):
        if label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float64)
            fine[k] = x / np.linalg.norm(x)
    links = [(a, b) for a in fine for b in fine if b < a and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]) and fine[a] @ fine[b] >= least]
    root = roots_of(range(len(rows)), links)
    count = np.zeros(len(rows), int)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    least_id = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            least_id[root[k]] = min(r[0], least_id.get(root[k], r[0]))
    return [(r[0], int(count[k]), least_id.get(root[k]), r[0] is not None and r[0] == least_id[root[k]]) for k, r in enumerate(rows)]


def in_order(rows):
    return sorted(map(tuple, rows), key=str)


def vectors():
    rng = np.random.default_rng(2)
    rows, n = [], 0
    for _ in range(25):
        base = rng.standard_normal(32)
        for _ in range(rng.integers(1, 7)):
            v = base + rng.choice([0.0, 0.03, 0.25]) * rng.standard_normal(32)
            rows.append((n, [float(np.float32(x)) for x in v * rng.choice([1, 3])], int(rng.integers(0, 2))))
            n += 1
    one = [1.0, 2.0, 2.0] + [0.5] * 29
    rows += [(n, one, 1), (n + 1, one, 1), (n + 2, one, None), (n + 3, None, 1), (n + 4, [0.0] * 32, 1), (n + 5, [float("nan")] + one[1:], 1), (n + 6, [float("inf")] + one[1:], 1), (n + 7, one[:3], 1), (n + 8, one[:3], 1), (n + 9, [], 1), (n + 10, [None] + one[1:], 1)]
    return rows


@pytest.mark.parametrize("chunk", [512, 3])
def test_embeddings_against_all_pairs(spark, monkeypatch, chunk):
    monkeypatch.setattr(embeddings, "CHUNK", chunk)
    table = with_clashes(spark.createDataFrame(vectors(), "vec_id long, embedding array<float>, label int"), "n_links", "kept", "size", "codes")
    assert in_order(embeddings.embedding_classes(table).collect()) == in_order(plain_embeddings(vectors(), 0.93))
    assert embeddings.embedding_classes(table.limit(0)).count() == 0


def test_embeddings_with_repeated_and_null_ids(spark):
    rows = [(None if k % 7 == 0 else k // 3, v, label) for k, (_, v, label) in enumerate(vectors())]
    near = [3.0, 1.0, *[0.25] * 6]
    rows += [(1, near, 5), (1, [x + 0.01 for x in near], 5), (2, [x - 0.01 for x in near], 5), (None, near, 5), (None, [0.0, 1.0] * 4, 6), (None, [0.0, 1.0] * 4, 6)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert in_order(embeddings.embedding_classes(table).collect()) == in_order(plain_embeddings(rows, 0.93))


def test_labels_of_any_type(spark):
    rows = [(k, v, None if label is None else f"name {label}") for k, v, label in vectors()]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    assert in_order(embeddings.embedding_classes(table).collect()) == in_order(plain_embeddings(rows, 0.93))


def test_links_found_of_planted_pairs(spark):
    """End to end: of all pairs that a comparison of everything finds, some 98 in 100."""
    rng = np.random.default_rng(5)
    base = rng.standard_normal((250, 64))
    rows = []
    for b in base:
        for c in (1.0, rng.uniform(0.93, 0.97), rng.uniform(0.9, 0.95)):
            n = rng.standard_normal(64)
            n -= (n @ b) / (b @ b) * b
            n *= np.linalg.norm(b) / np.linalg.norm(n)
            rows.append((len(rows), [float(np.float32(x)) for x in c * b + np.sqrt(1 - c * c) * n], 1))
    want = {r[0]: r[1] for r in plain_embeddings(rows, 0.93)}
    got = {r["vec_id"]: r["n_links"] for r in embeddings.embedding_classes(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert all(got[k] <= n for k, n in want.items()) and sum(got.values()) >= 0.97 * sum(want.values()) > 0


def test_hot_keys_are_joined_without_their_shuffle(spark):
    from lexmill.llm._common import join_spread

    rows = spark.range(2000).selectExpr("if(id < 1500, 0, id) k", "id")
    table = rows.groupBy("k").count()
    got = join_spread(rows, table, ["k"], "count", 2000)
    assert sorted(map(tuple, got.collect())) == sorted((0 if i < 1500 else i, i, 1500 if i < 1500 else 1) for i in range(2000))


def test_recall_at_the_threshold():
    rng = np.random.default_rng(1)
    a = rng.standard_normal((3000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    n = rng.standard_normal((3000, 64))
    n -= (n * a).sum(axis=1, keepdims=True) * a
    n /= np.linalg.norm(n, axis=1, keepdims=True)
    x, y = (embeddings.buckets(v, 8, 3, 7) for v in (a, 0.93 * a + np.sqrt(1 - 0.93**2) * n))
    assert (x[:, :, :, None] == y[:, :, None, :]).any(axis=(1, 2, 3)).mean() > 0.98


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).standard_normal((5, 16))
    y = embeddings.hadamard(x)
    assert np.allclose(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)) and np.allclose(embeddings.hadamard(y), x)


@pytest.mark.parametrize("hot", [8, 40])
def test_hot_buckets_link_each_pair_once(spark, monkeypatch, hot):
    """Groups of close copies that share most of their buckets: all links of all pairs, each counted once."""
    monkeypatch.setattr(embeddings, "CHUNK", 10)
    monkeypatch.setattr(embeddings, "HOT_CHUNK", hot)
    r = np.random.default_rng(4)
    centres = r.normal(size=(3, 32))
    x = np.concatenate([centres[0] + r.normal(size=(150, 32)) * 0.1, centres[1] + r.normal(size=(90, 32)) * 0.25, (centres[0] + centres[2])[None] + r.normal(size=(40, 32)) * 0.3])
    rows = [(k, v.tolist(), 1) for k, v in enumerate(x)]
    got = {g["vec_id"]: g for g in embeddings.embedding_classes(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    true = (u @ u.T >= 0.93).sum(axis=1) - 1
    found = np.array([got[k]["n_links"] for k in range(len(x))])
    assert (found <= true).all() and found[:150].sum() == true[:150].sum() and found.sum() >= 0.97 * true.sum()


def test_pairs_met_before():
    r = np.random.default_rng(1)
    a, b = r.integers(0, 60, (30, 8)), r.integers(0, 60, (40, 8))
    want = [[bool({c for c in x if c < 35} & {c for c in y if c < 35}) for y in b.tolist()] for x in a.tolist()]
    assert embeddings._met_before(a, b, 35).tolist() == want
