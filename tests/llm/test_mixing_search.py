import hashlib
import math
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexmill.llm import mixing, search
from lexmill.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.helpers import empty_docs, odd_docs, odd_rows, with_clashes, words
from tests.test_oracles import rows as canonical_rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql_gives_the_same_rows(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "conversations"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cursor = duck.execute(ORACLE_SQL[name])
    df = QUERIES[name](spark, SF)
    assert canonical_rows(df.columns, df.collect()) == canonical_rows([d[0] for d in cursor.description], cursor.fetchall())


def targets_by_resharing(sizes, weights, share, cap):
    """Deal the shares by weight; what is above a cap is dealt again among the others."""
    want, capped = dict.fromkeys(sizes, 0.0), set()
    left = share * sum(sizes.values())
    while left > 1e-9 and len(capped) < len(sizes):
        open_ = [s for s in sizes if s not in capped]
        total = sum(weights[s] for s in open_)
        for s in open_:
            want[s] += left * weights[s] / total
        left = 0.0
        for s in open_:
            if want[s] >= cap * sizes[s]:
                left += want[s] - cap * sizes[s]
                want[s] = cap * sizes[s]
                capped.add(s)
    return want


def mixed_table(spark):
    rows = [(k, words(k, 1 + (k * 37) % 90), "en", f"s{k % 7}" if k % 11 else None, 0) for k in range(600)]
    rows += [(k, words(k, 5), "en", "tiny", 0) for k in range(600, 604)] + [(700, None, "en", "silent", 0), (701, "", "en", "silent", 0)]
    return spark.createDataFrame(rows, odd_docs(spark).schema), rows


def test_targets_taken_and_caps(spark):
    docs, rows = mixed_table(spark)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len((t or "").split())
    names = sorted((s for s in sizes if s is not None)) + [None]
    weights = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    want = targets_by_resharing(sizes, weights, 1.5, 2.0)
    of = {i: s for i, _, _, s, _ in rows}
    taken = Counter()
    for r in got:
        s = of[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s])
        assert 0 <= r["taken"] <= 2 * r["size"] and (r["position"] is None) == (r["taken"] == 0)
        taken[s] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(3, 0.02 * want[s])
    at = [r["position"] for r in got if r["position"] is not None]
    assert at == sorted(at) and 0 <= at[0] and at[-1] <= 1
    assert [tuple(r) for r in got] == [tuple(r) for r in mixing.mix(docs.repartition(5)).collect()]


def test_positions_follow_the_schedule():
    for slope in (0.5, 0.0, -0.5, 1.0, -1.0):
        for t in (0.0, 0.1, 0.5, 0.9, 1.0):
            y = t + slope * (t * t - t)
            root = math.sqrt((1 - slope) ** 2 + 4 * slope * y)
            assert (y if slope == 0 else (root - (1 - slope)) / (2 * slope)) == pytest.approx(t)


def test_places_are_the_hash_of_the_id(spark):
    got = spark.createDataFrame([(5,), (None,)], "i long").select(mixing.place_of(F.col("i"))).collect()
    assert [r[0] for r in got] == [int(hashlib.md5(x).hexdigest()[:13], 16) for x in (b"5", b"")]


def test_mixing_odd_rows(spark):
    docs = with_clashes(odd_docs(spark), "size", "target", "taken", "position", "place", "kept")
    got = mixing.mix(docs).collect()
    assert len(got) == len(odd_rows()) and all(r["taken"] == 0 for r in got if r["doc_id"] in (1, 2, 3))
    assert mixing.mix(empty_docs(spark)).count() == 0
    copies = mixing.mixed_documents(docs)
    assert copies.columns == docs.columns and copies.where("doc_id in (1, 2, 3)").count() == 0
    assert mixing.mixed_documents(empty_docs(spark)).count() == 0


def test_mixed_documents_take_whole_copies(spark):
    docs, rows = mixed_table(spark)
    copies = Counter(r["doc_id"] for r in mixing.mixed_documents(docs).collect())
    taken = {r["doc_id"]: r for r in mixing.mix(docs, whole_documents=True).collect()}
    assert max(copies.values()) == 2
    for i, r in taken.items():
        assert r["taken"] == r["copies"] * r["size"] and copies.get(i, 0) == r["copies"]


def test_mixing_uses_no_python(spark):
    docs, _ = mixed_table(spark)
    for df in (mixing.mix(docs), mixing.mixed_documents(docs)):
        plan = df._jdf.queryExecution().toString()
        assert not re.search("Python|Arrow|Pandas", plan)


def plain_search(docs, queries, k):
    tf = [(i, Counter(search.terms_of(t))) for i, t in docs]
    n, mean = len(tf), sum(sum(c.values()) for _, c in tf) / max(len(tf), 1)
    df = Counter(w for _, c in tf for w in c)
    out = []
    for q, t in queries:
        scored = []
        for i, c in tf:
            common = set(search.terms_of(t)) & c.keys()
            if common:
                norm = search.K1 * (1 - search.B + search.B * sum(c.values()) / mean)
                scored.append((-round(sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * (search.K1 + 1) / (c[w] + norm) for w in common), 6), -1 if i is None else i))
        out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


@pytest.mark.parametrize(("shard", "block"), [(1 << 14, 64), (40, 4), (7, 2)])
def test_search_against_all_documents(spark, monkeypatch, shard, block):
    monkeypatch.setattr(search, "SHARD", shard)
    monkeypatch.setattr(search, "BLOCK", block)
    rows = [(i, t[:400] if t else t) for i, t, *_ in odd_rows()] + [(1000 + k, words(k % 90, 30) + " " + words(1000 + k, 10)) for k in range(200)]
    queries = [(1, rows[20][1]), (2, rows[50][1]), (3, None), (4, ""), (5, "nothingatall"), (6, "one TWO"), (6, "three"), (None, "one")]
    docs = with_clashes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "score", "rank", "query_id", "shard")
    got = sorted((r[0], r[1], -1 if r[2] is None else r[2], r[3]) for r in search.top_k(docs, spark.createDataFrame(queries, "query_id long, text string"), k=5).collect())
    want = plain_search(rows, [(1, rows[20][1]), (2, rows[50][1]), (6, "one two three")], 5)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want], abs=2e-6)


@pytest.mark.parametrize("waves", [(1, 2), (8, 64)])
def test_blocks_below_the_threshold_are_not_read(monkeypatch, waves):
    monkeypatch.setattr(search, "BLOCK", 4)
    monkeypatch.setattr(search, "WAVES", waves)
    rows = [(k, f"topic{k % 40} " * 3 + words(k % 40, 12) + " " + words(500 + k, 6)) for k in range(400)]
    hashes = search._Hashes()
    found = [tuple(np.unique([hashes[w] for w in search.terms_of(t)], return_counts=True)) for _, t in rows]
    mean = sum(int(n.sum()) for _, n in found) / len(rows)
    packed = search._shard(pa.array([i for i, _ in rows]), found, 0)
    shard = search.Shard.of(dict(zip(("ids", "lens", "terms", "starts", "docs", "tfs"), packed[1:], strict=True)), mean)
    df = Counter(t for terms, _ in found for t in terms.tolist())
    queries = [(k, found[k][0], np.array([math.log(1 + (len(rows) - df[t] + 0.5) / (df[t] + 0.5)) for t in found[k][0].tolist()])) for k in range(0, 400, 20)]
    got = [(name, rank + 1, shard.ids[int(d)].as_py()) for name, hit, _ in shard.search(queries, 3) for rank, d in enumerate(hit)]
    assert sorted(got) == [w[:3] for w in plain_search(rows, [(k, rows[k][1]) for k in range(0, 400, 20)], 3)]
    assert shard.scored < 0.6 * shard.bounded


def test_no_shard_gives_more_than_k(spark):
    docs = spark.createDataFrame([(k, "one two three") for k in range(500)], "doc_id long, text string").coalesce(1)
    got = search.top_k(docs, spark.createDataFrame([(q, "one two") for q in range(4)], "query_id long, text string"), k=3)
    assert sorted(tuple(r)[:3] for r in got.collect()) == [(q, k + 1, k) for q in range(4) for k in range(3)]
    assert sum(spark.read.parquet(f).count() for f in {f.rsplit("/", 1)[0] for f in got.inputFiles() if "search-hits" in f}) == 12


def test_ties_are_those_of_rounded_scores():
    scores = {3: 1.0000004, 2: 1.0000001, 1: 0.9999999}
    order = np.array([0, 1, 2])
    s = search.Shard(pa.array([3, 2, 1]), np.array([7]), np.array([0, 3]), order, np.array([scores[i] for i in (3, 2, 1)]), np.array([0, 3]), np.array([0]), np.array([1.0000004]), np.array([0, 1]), np.array([2, 1, 0]))
    hit, score = s.top(np.array([0]), np.array([1.0]), 1)
    assert hit.tolist() == [2] and score.tolist() == [1.0]


@pytest.mark.parametrize("columns", [0, 3, 512])
def test_queries_scored_together_have_the_best_by_double_precision(monkeypatch, columns):
    """Scores that float32 cannot tell apart: the order is that of all postings summed in double precision."""
    monkeypatch.setattr(search, "BLOCK", 4)
    monkeypatch.setattr(search, "COLUMNS", columns)
    rng = np.random.default_rng(5)
    tf = np.where(rng.random((300, 40)) < 0.6, 5000 + rng.integers(0, 2, (300, 40)), 0)
    found = [(np.flatnonzero(r), r[r > 0].astype(np.uint32)) for r in tf]
    packed = search._shard(pa.array(range(300)), found, 0)
    shard = search.Shard.of(dict(zip(("ids", "lens", "terms", "starts", "docs", "tfs"), packed[1:], strict=True)), float(tf.sum() / 300))
    queries = [(rng.choice(len(shard.terms), 12, replace=False), 300 * rng.random(12)) for _ in range(9)]
    for (at, w), (hit, score) in zip(queries, shard.top_each(queries, 5), strict=True):
        sums = np.zeros(300)
        for a, x in zip(at, w, strict=True):
            p = slice(shard.starts[a], shard.starts[a + 1])
            sums[shard.docs[p]] += x * shard.impacts[p]
        scores = np.round(sums, 6)
        assert hit.tolist() == np.lexsort((shard.order, -scores))[:5].tolist()
        assert score.tolist() == pytest.approx(scores[hit].tolist(), abs=2e-6)


def test_search_in_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(search, "SENT", 500)
    rows = [(k, words(k % 9, 20)) for k in range(60)]
    queries = [(k, words(k % 9, 20)) for k in range(12)]
    got = search.top_k(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(queries, "query_id long, text string"), k=3).collect()
    assert sorted(tuple(r)[:3] for r in got) == [w[:3] for w in plain_search(rows, queries, 3)]


def test_search_in_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a")], "query_id long, text string")
    assert search.top_k(docs.limit(0), asked).count() == 0
    assert search.top_k(docs, asked.limit(0)).count() == 0
