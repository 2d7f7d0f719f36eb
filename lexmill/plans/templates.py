"""Queries of templates, simple memory look-ups, batches and question answering."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import text as X
from lexmill.operators import memory as T
from lexmill.operators import relational as R
from lexmill.operators import retrieval as Q
from lexmill.operators import segments as G
from lexmill.operators import templates as L
from lexmill.plans.registry import NTH, query

GRAMMAR = L.Grammar(actions=("the", "and", "is", "la", "der"), conditions=("with", "for", "que"), articles=("of", "to"))


@query()
def template_candidates(t):
    sentences = G.exploded(t.conversations, X.sentences(F.col("text"), 15), "conv_id").select((F.col("conv_id") * NTH + F.col("idx")).alias("idx"), "text")
    templates = G.exploded(t.benchmark, X.sentences(F.col("text"), 15), "item_id").select((F.col("item_id") * NTH + F.col("idx")).alias("idx"), "text")
    return L.kept(L.candidates(sentences, templates, GRAMMAR), pending=0.4)


@query(r"""
WITH q AS (SELECT conv_id * 100 + turn AS query_id, text AS q FROM conversations), m AS (SELECT item_id, text AS s FROM benchmark),
x AS (SELECT query_id, item_id, q, s, CASE WHEN length(q) < length(s) THEN q ELSE s END AS a, CASE WHEN length(q) < length(s) THEN s ELSE q END AS b FROM q JOIN m ON length(q) > 20),
n AS (SELECT query_id, max(item_id) AS item_id FROM x WHERE len(list_filter(string_split(a, ''), lambda c: contains(b, c)))::DOUBLE / length(b) > 0.7 GROUP BY 1)
SELECT q.query_id, 't' || coalesce((SELECT min(item_id) FROM m WHERE trim(s) = trim(q.q)), n.item_id) AS translated FROM q LEFT JOIN n USING (query_id)
""")
def tm_simple_lookup(t):
    asked = t.conversations.select((F.col("conv_id") * 100 + F.col("turn")).alias("query_id"), "text")
    bank = t.benchmark.select(F.col("item_id").alias("entry_ord"), F.col("text").alias("source_text"), F.concat(F.lit("t"), "item_id").alias("translated_text"))
    return T.simple_lookup(asked, bank)


@query("""
WITH RECURSIVE r AS (SELECT conv_id, turn, length(text) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
f AS (SELECT conv_id, turn, size, k, CAST(0 AS BIGINT) AS bin, 1 AS items, size AS used FROM r WHERE k = 1
  UNION ALL SELECT r.conv_id, r.turn, r.size, r.k, CASE WHEN f.items = 3 OR f.used + r.size > 1500 THEN f.bin + 1 ELSE f.bin END, CASE WHEN f.items = 3 OR f.used + r.size > 1500 THEN 1 ELSE f.items + 1 END, CASE WHEN f.items = 3 OR f.used + r.size > 1500 THEN r.size ELSE f.used + r.size END
  FROM f JOIN r ON r.conv_id = f.conv_id AND r.k = f.k + 1)
SELECT conv_id, turn, size, bin FROM f
""")
def translation_batches(t):
    rows = t.conversations.select("conv_id", "turn", F.length("text").alias("size"))
    return L.bins(rows, "conv_id", "turn", "size", most_items=3, most_size=1500)


_TOK = r"[\p{L}\p{N}]+"


@query(rf"""
WITH c AS (SELECT doc_id, CAST(i AS INTEGER) AS idx, substr(text, CAST(i * 380 + 1 AS BIGINT), 500) AS text FROM (SELECT doc_id, text, unnest(range(0, (length(text) - 1) // 380 + 1)) AS i FROM documents WHERE text <> '')),
w AS (SELECT doc_id, idx, unnest(regexp_extract_all(lower(text), '{_TOK}')) AS word FROM c), tf AS (SELECT doc_id, idx, word, count(*) AS tf FROM w GROUP BY ALL),
q AS (SELECT item_id AS question_id, unnest(list_distinct(regexp_extract_all(lower(text), '{_TOK}'))) AS word FROM benchmark),
s AS (SELECT question_id, doc_id, idx, round(3.5::DOUBLE * count(*) + 0.8::DOUBLE * least(sum(tf), 10), 4) AS score FROM tf JOIN q USING (word) GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id, idx) AS rank FROM s QUALIFY rank <= 5),
u AS (SELECT b.*, CAST(sum(length(c.text)) OVER (PARTITION BY question_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM b JOIN c USING (doc_id, idx))
SELECT question_id, doc_id, idx, rank, score, used, max(score) OVER (PARTITION BY question_id) < 40 AS unclear FROM u WHERE used <= 1800
""")
def qa_context(t):
    from pyspark.sql import Window

    chunks = G.exploded(t.documents, X.chunks(F.col("text"), 500, 120))
    asked = t.benchmark.select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))
    rows = Q.top_scores(chunks.withColumn("size", F.length("text")), asked, ["doc_id", "idx"], 5, carry=["size"])
    rows = R.within_budget(rows, "question_id", ["rank"], "size", 1800)
    unclear = F.max("score").over(Window.partitionBy("question_id")) < 40
    return rows.select("question_id", "doc_id", "idx", "rank", "score", "used", unclear.alias("unclear"))
