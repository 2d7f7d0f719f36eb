"""Queries of continuations, evaluation suites, manuals with pages, template levels and tables of terms."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexmill.functions import text as X
from lexmill.operators import evaluation as E
from lexmill.operators import issues as I
from lexmill.operators import memory as T
from lexmill.operators import quality as Y
from lexmill.operators import retrieval as Q
from lexmill.operators import segments as G
from lexmill.operators import templates as L
from lexmill.plans.comparison import _SENT
from lexmill.plans.findings import RULES, SLOP, _rules_sql
from lexmill.plans.registry import NTH, query

_NEXT = "SELECT conv_id, turn, text AS a, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations"


def _style(c: str, p: str) -> str:
    return f"""round(coalesce(list_avg(list_transform(list_filter(string_split_regex({c}, '[.!?。！？\\n]'), lambda s: trim(s, ' ') <> ''), lambda s: length(trim(s, ' '))::DOUBLE)), 0), 1) AS {p}l,
  round(len(regexp_extract_all({c}, '[,，]'))::DOUBLE / greatest(length({c}), 1) * 100, 2) AS {p}c, round(len(regexp_extract_all({c}, '\\d+'))::DOUBLE / greatest(length({c}), 1) * 100, 2) AS {p}n, len(regexp_extract_all({c}, '(?m)^(?:The|In|La)')) AS {p}i"""


_CHARS = "list_distinct(string_split({}, ''))"


@query(f"""
WITH p AS ({_NEXT}), s AS (SELECT *, {_style('a', 'a')}, {_style('b', 'b')}, {' + '.join(f"regexp_matches(b, '{p}')::INT" for p in SLOP.values())} AS slop, length(trim(b, ' ')) AS n FROM p WHERE b IS NOT NULL),
t AS (SELECT *, greatest(0::DOUBLE, least(100::DOUBLE, round(100 - (least(25::DOUBLE, abs(al - bl)) + least(25::DOUBLE, abs(ac - bc) * 5) + least(20::DOUBLE, abs(an - bn) * 3)) + CASE WHEN ai = 0 THEN 0 WHEN bi > 0 THEN 5 ELSE -10 END, 0))) AS style FROM s),
q AS (SELECT *, greatest(0, 100 - least(30, 5 * slop) - CASE WHEN style < 60 THEN 20 WHEN style < 80 THEN 10 ELSE 0 END - CASE WHEN n < 10 THEN 40 WHEN n < 30 THEN 20 WHEN n > 500 THEN 15 ELSE 0 END
  - CASE WHEN a <> '' AND b <> '' AND len(list_intersect({_CHARS.format('a')}, {_CHARS.format('b')}))::DOUBLE / greatest(len({_CHARS.format('a')}), 1) < 0.15 AND n > 20 THEN 15 ELSE 0 END) AS score FROM t)
SELECT conv_id, turn, style, slop, CAST(score AS INTEGER) AS score, score >= 70 AS passed FROM q
""")
def continuation_quality(t):
    b = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = t.conversations.select("conv_id", "turn", F.col("text").alias("a"), b.alias("b")).where("b is not null")
    return Y.continuation_quality(rows, SLOP, "The|In|La").select("conv_id", "turn", "style", "slop", "score", "passed")


_C = "lower(regexp_replace({}, '\\s+', '', 'g'))"


@query(rf"""
WITH g AS (SELECT doc_id, contains({_C.format("text || ' ' || lang")}, 'thatin') OR contains({_C.format("text || ' ' || lang")}, 'fr') AS missed FROM documents),
gold AS (SELECT doc_id, count(*) FILTER (NOT missed) AS annotations, count(*) FILTER (missed) AS allowed_misses FROM g GROUP BY 1),
h AS ({_rules_sql()}), i AS (SELECT *, concat_ws(' ', rule, category, original_text, suggestion) AS blob FROM h),
f AS (SELECT doc_id, count(*) FILTER (NOT contains({_C.format('blob')}, 'r001')) AS issues, count(*) FILTER (contains({_C.format('blob')}, 'r001')) AS false_positives, count(*) FILTER (trim(suggestion, ' ') = '') AS empty_suggestions,
  count(*) FILTER (trim(suggestion, ' ') <> '' AND lower(regexp_replace(original_text, '[^\p{{L}}\p{{N}}]+', '', 'g')) = lower(regexp_replace(suggestion, '[^\p{{L}}\p{{N}}]+', '', 'g'))) AS idle_suggestions,
  count(*) FILTER (contains(lower(blob), 'license')) AS has_license, count(*) FILTER (contains(lower(blob), 'mark')) AS has_mark FROM i GROUP BY 1)
SELECT doc_id, coalesce(annotations, 0) AS annotations, coalesce(allowed_misses, 0) AS allowed_misses, coalesce(issues, 0) AS issues, coalesce(false_positives, 0) AS false_positives, coalesce(empty_suggestions, 0) AS empty_suggestions, coalesce(idle_suggestions, 0) AS idle_suggestions,
  coalesce(has_license, 0) AS has_license, coalesce(has_mark, 0) AS has_mark FROM gold FULL JOIN f USING (doc_id)
""")
def evaluation_suite(t):
    gold = t.documents.select("doc_id", F.col("text").alias("selected"), F.col("lang").alias("comment"))
    return E.suite(gold, I.detect(t.documents, RULES), "doc_id", ("thatin", "fr"), ("R001",), ("license", "mark"))


_TOK = r"[\p{L}\p{N}]+"


@query(rf"""
WITH c AS (SELECT conv_id, page_num, CAST(i AS INTEGER) AS idx, substr(text, CAST(i * 450 + 1 AS BIGINT), 600) AS text FROM (SELECT conv_id, turn AS page_num, text, unnest(range(0, (length(text) - 1) // 450 + 1)) AS i FROM conversations WHERE text <> '')),
w AS (SELECT conv_id, page_num, idx, unnest(regexp_extract_all(lower(text), '{_TOK}')) AS word FROM c), tf AS (SELECT conv_id, page_num, idx, word, count(*) AS tf FROM w GROUP BY ALL), q AS (SELECT item_id AS question_id, unnest(list_distinct(regexp_extract_all(lower(text), '{_TOK}'))) AS word FROM benchmark),
s AS (SELECT question_id, conv_id, page_num, idx, round(3.5::DOUBLE * count(*) + 0.8::DOUBLE * least(sum(tf), 10), 4) AS score FROM tf JOIN q USING (word) GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, conv_id, page_num, idx) AS rank FROM s QUALIFY rank <= 10
""")
def manual_pages_topk(t):
    """A conversation is a manual, a turn its page."""
    rows = t.conversations.select(F.struct("conv_id", F.col("turn").alias("page_num")).alias("page"), "text")
    chunks = G.exploded(rows, X.chunks(F.col("text"), 600, 150, 80), "page").select("page.*", "idx", "text")
    asked = t.benchmark.select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))
    return Q.top_scores(chunks, asked, ["conv_id", "page_num", "idx"], 10).select("question_id", "conv_id", "page_num", "idx", "score", "rank")


def _ld(c: str) -> str:
    return f"lower(regexp_replace({c}, '[^\\p{{L}}\\p{{N}}]+', '', 'g'))"


_SYN = _ld(r"regexp_replace(lower(trim(regexp_replace(text, '\s+', ' ', 'g'), ' ')), '(^|[^\p{L}\p{N}])the([^\p{L}\p{N}]|$)', '\1der\2', 'g')")
_W = f"list_distinct(regexp_extract_all(lower(text), '{_TOK}'))"


@query(rf"""
WITH s AS (SELECT conv_id * {NTH} + i - 1 AS idx, x AS text FROM (SELECT conv_id, unnest(s) AS x, unnest(range(1, len(s) + 1)) AS i FROM (SELECT conv_id, {_SENT} AS s FROM (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1)))),
e AS (SELECT item_id * {NTH} + i - 1 AS idx, x AS text FROM (SELECT item_id, unnest(s) AS x, unnest(range(1, len(s) + 1)) AS i FROM (SELECT item_id, {_SENT} AS s FROM benchmark))),
k AS (SELECT idx, {_ld('text')} AS k1, {_SYN} AS k2, {_W} AS w, left(lower(text), 4) AS l4 FROM s), m AS (SELECT idx, {_ld('text')} AS k1, {_SYN} AS k2, {_W} AS w, left(lower(text), 4) AS l4 FROM e),
a AS (SELECT k1, min(idx) AS t1 FROM m WHERE k1 <> '' GROUP BY 1), b AS (SELECT k2, min(idx) AS t2 FROM m WHERE k2 <> '' GROUP BY 1),
c AS (SELECT k.idx, m.idx AS t, len(list_intersect(k.w, m.w))::DOUBLE / nullif(len(list_distinct(list_concat(k.w, m.w))), 0) AS score FROM k JOIN m USING (l4)), d AS (SELECT idx, max(score) AS score, arg_max(t, (score, -t)) AS t FROM c WHERE score IS NOT NULL GROUP BY 1)
SELECT k.idx, coalesce(t1, t2, d.t) AS template_id, CASE WHEN t1 IS NOT NULL THEN 1.0 WHEN t2 IS NOT NULL THEN 0.95::DOUBLE ELSE coalesce(d.score, 0) END AS score,
  CASE WHEN t1 IS NOT NULL THEN 'L1' WHEN t2 IS NOT NULL THEN 'L1.5' WHEN d.score >= 0.3 THEN 'L2' WHEN d.score >= 0.1 THEN 'L3' ELSE 'NONE' END AS level FROM k LEFT JOIN a USING (k1) LEFT JOIN b USING (k2) LEFT JOIN d ON d.idx = k.idx
""")
def template_levels(t):
    """Candidates share their first four characters and score by their words."""
    whole = t.conversations.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias("text"))
    numbered = lambda rows, key: G.exploded(rows, X.sentences(F.col("text"), 5), key).select((F.col(key) * NTH + F.col("idx")).alias("idx"), "text")
    sentences, templates = numbered(whole, "conv_id"), numbered(t.benchmark, "item_id")
    side = lambda rows, s: rows.select(F.col("idx").alias(f"{s}_idx"), F.array_distinct(X.tokens(F.col("text"))).alias(f"{s}_w"), F.left(F.lower("text"), F.lit(4)).alias("l4"))
    scored = side(sentences, "a").join(side(templates, "b"), "l4").select("a_idx", "b_idx", X.jaccard(F.col("a_w"), F.col("b_w")).alias("score"))
    return L.levels(sentences, templates, scored.where(F.col("score").isNotNull()), {"the": "der"}, least=0.3, hint=0.1)


@query(rf"""
WITH q AS (SELECT conv_id * 100 + turn AS query_id, lower(text) AS t FROM conversations), m AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '{_TOK}'))) AS term FROM benchmark)
SELECT query_id, term, CAST((length(t) - length(replace(t, term, ''))) / length(term) AS BIGINT) AS n FROM q JOIN m ON contains(t, term)
""")
def term_table_hits(t):
    asked = t.conversations.select((F.col("conv_id") * 100 + F.col("turn")).alias("query_id"), "text")
    return T.term_hits(asked, t.benchmark.select(F.explode(X.tokens(F.col("text"))).alias("term")))
