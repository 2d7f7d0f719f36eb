"""Queries of proofing, document comparison and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import text as X
from lexmill.operators import compare as C
from lexmill.operators import evaluation as E
from lexmill.operators import issues as I
from lexmill.operators import proofing as P
from lexmill.operators import segments as G
from lexmill.operators.spread import cut
from lexmill.plans.findings import RULES, _rules_sql
from lexmill.plans.registry import BEGIN, NTH, query


@query(r"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '\p{L}+')) AS word FROM documents), c AS (SELECT doc_id, word, count(*) AS n FROM w WHERE length(word) >= 3 GROUP BY ALL),
d AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '\p{L}+'))) AS word FROM conversations), l AS (SELECT DISTINCT unnest(regexp_extract_all(text, '\p{L}+')) AS word FROM benchmark)
SELECT doc_id, word, n FROM c WHERE lower(word) NOT IN (SELECT word FROM d) AND word NOT IN (SELECT word FROM l)
""")
def spelling_unknown(t):
    words = lambda d: d.select(F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}+"), 0)).alias("word"))
    return P.unknown_words(t.documents, words(t.conversations), words(t.benchmark))


@query(r"""
WITH u AS (SELECT DISTINCT w FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) AS w FROM benchmark)), d AS (SELECT DISTINCT s FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS s FROM conversations)),
n AS (SELECT w, s, levenshtein(w, s) AS distance FROM u JOIN d ON left(w, 1) = left(s, 1) AND abs(length(w) - length(s)) <= 2 WHERE levenshtein(w, s) <= 2)
SELECT w AS word, s AS suggestion, distance, row_number() OVER (PARTITION BY w ORDER BY distance, s) AS rank FROM n QUALIFY rank <= 3
""")
def spelling_corrections(t):
    words = lambda d, p: d.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(p), 0)).alias("word"))
    return P.corrections(words(t.benchmark, "[a-z]{5,}"), words(t.conversations, "[a-z]+"))


@query(r"""
SELECT doc_id, md5(regexp_replace(lower(regexp_replace(translate(text, '，。！？；：（）【】“”‘’、', ',.!?;:()[]""'''','), '\s+', '', 'g')), '[.,!?;:]+$', '')) AS key,
  len(list_filter(list_transform(string_split_regex(text, '[,.;:!?\n，。；：！？、]+'), lambda p: trim(p, ' ')), lambda p: length(p) >= 2)) AS clauses FROM documents
""")
def loose_keys_and_clauses(t):
    return t.documents.select("doc_id", F.md5(P.aggressive(F.col("text"))).alias("key"), F.size(P.clauses(F.col("text"))).cast("long").alias("clauses"))


@query(rf"SELECT doc_id, unnest(list_concat(regexp_extract_all(text, '(?i){BEGIN}(an\s+(?:[bcdfgjklmnpqrstvwxyz]|uni|use|eu)\w*)', 1), regexp_extract_all(text, '(?i){BEGIN}(a\s+(?:[aeio]|un[^i]|hour|honest)\w*)', 1))) AS phrase FROM documents WHERE lang = 'en'")
def article_usage(t):
    return P.wrong_articles(t.documents.where("lang = 'en'"))


@query(r"""
WITH a AS (SELECT doc_id, text AS t0, regexp_replace(text, ' \| ', ' ', 'g') AS t1 FROM documents), b AS (SELECT *, regexp_replace(t1, '[!?]{2,}', '!', 'g') AS t2 FROM a), c AS (SELECT *, replace(t2, '(', '[') AS t3 FROM b)
SELECT doc_id, md5(t3) AS text_md5, CAST(regexp_matches(t0, ' \| ') AS INTEGER) + CAST(regexp_matches(t1, '[!?]{2,}') AS INTEGER) + CAST(contains(t2, '(') AS INTEGER) + CAST(regexp_matches(t3, '(?:^|[^\p{L}])\p{Lu}{4,}(?:[^\p{L}]|$)') AS INTEGER) AS n_applied FROM c
""")
def rules_in_order(t):
    return P.rewritten(t.documents, [P.Rewrite(1, r"[!?]{2,}", "!", 5), P.Rewrite(2, r" \| ", " ", 9), P.Rewrite(3, "(", "[", 1), P.Rewrite(4, r"(?:^|[^\p{L}])\p{Lu}{4,}(?:[^\p{L}]|$)", None, 0)]).select("doc_id", F.md5("text").alias("text_md5"), F.size("applied").alias("n_applied"))


@query("SELECT conv_id, turn, CASE WHEN regexp_matches(text, '[?]') THEN 'question' WHEN regexp_matches(text, '[0-9]') THEN 'figures' WHEN length(text) < 80 THEN 'short' ELSE 'other' END AS kind FROM conversations")
def annotation_classes(t):
    return t.conversations.select("conv_id", "turn", P.first_match(F.col("text"), {"question": r"[?]", "figures": r"[0-9]", "short": r"^(?s).{0,79}$"}, "other").alias("kind"))


@query(r"""
WITH x AS (SELECT doc_id, list_distinct(regexp_extract_all(text, '[A-Z][A-Za-z0-9-]{2,}')) AS a, list_distinct(regexp_extract_all(left(text, length(text) // 2), '[A-Z][A-Za-z0-9-]{2,}')) AS b FROM documents)
SELECT doc_id, array_to_string(list_sort(list_filter(a, lambda w: NOT list_contains(b, w))), ' ') AS lost FROM x
""")
def lost_proper_nouns(t):
    half = F.left("text", F.floor(F.length("text") / 2).cast("int"))
    return t.documents.select("doc_id", F.array_join(P.lost_words(F.col("text"), half, r"[A-Z][A-Za-z0-9-]{2,}"), " ").alias("lost"))


def _versions(t):
    """The first and the second document of each pair of documents."""
    rows = t.documents.select((F.col("doc_id") / 2).cast("long").alias("pair"), (F.col("doc_id") % 2).alias("side"), "text")
    return rows.where("side = 0").select("pair", "text"), rows.where("side = 1").select("pair", "text")


@query()
def document_compare(t):
    return C.compare_documents(*_versions(t), "pair")


@query()
def document_differences(t):
    a, b = (cut(C.segments(v, "pair"), "segments") for v in _versions(t))
    from lexmill.operators import matching as M

    return C.differences(a, b, M.with_exact(a, b, "pair", 0.8), "pair")


@query()
def lines_greedy_compare(t):
    """Every turn beside the next but one."""
    kind = t.conversations.select("conv_id", "turn").schema
    pair = lambda turn: t.conversations.select(F.to_json(F.struct("conv_id", turn.cast(kind["turn"].dataType).alias("turn"))).alias("pair"), "text")
    out = C.lines_greedy(pair(F.col("turn")), pair(F.col("turn") - 2), "pair")
    return out.withColumn("pair", F.from_json("pair", kind)).select("pair.*", *out.columns[1:])


@query(r"""
WITH x AS (SELECT conv_id, turn, text AS a, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations)
SELECT conv_id, turn, CASE WHEN regexp_matches(a || ' ' || b, '(?i)\b(?:warning|caution|danger|must|never|voltage|password)\b') OR list_sort(regexp_extract_all(a, '\d+(?:[.,]\d+)*')) <> list_sort(regexp_extract_all(b, '\d+(?:[.,]\d+)*')) THEN 'high'
  WHEN regexp_extract_all(lower(a), '[\p{L}\p{N}]+') <> regexp_extract_all(lower(b), '[\p{L}\p{N}]+') THEN 'medium' ELSE 'low' END AS severity FROM x WHERE b IS NOT NULL
""")
def diff_severity(t):
    from pyspark.sql import Window

    rows = t.conversations.select("conv_id", "turn", F.col("text").alias("a"), F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")).alias("b")).where("b is not null")
    return rows.select("conv_id", "turn", C.severity(F.col("a"), F.col("b")).alias("severity"))


@query("""
WITH d AS (SELECT user_id, event_id, CASE WHEN value >= 50 THEN 'add' ELSE 'del' END AS type, event_type AS text FROM events),
x AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS ord FROM d),
y AS (SELECT *, CASE WHEN lag(type) OVER w = type THEN 0 ELSE 1 END AS fresh FROM x WINDOW w AS (PARTITION BY user_id ORDER BY ord)),
z AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ord) AS run FROM y)
SELECT user_id, type, min(ord) AS first, count(*) AS n, string_agg(text, ' ' ORDER BY ord) AS text FROM z GROUP BY user_id, run, type
""")
def diff_neighbours_merged(t):
    from pyspark.sql import Window

    rows = t.events.select("user_id", F.when(F.col("value") >= 50, "add").otherwise("del").alias("type"), F.col("event_type").alias("text"), F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long").alias("ord"))
    return C.merged_neighbours(rows, "user_id", "ord")


@query(f"WITH h AS ({_rules_sql()}) SELECT 'rule' AS grouping, rule AS name, count(*) AS n FROM h GROUP BY ALL UNION ALL SELECT 'category', category, count(*) FROM h GROUP BY ALL UNION ALL SELECT 'severity', severity, count(*) FROM h GROUP BY ALL")
def annotation_summary(t):
    return E.summary(I.detect(t.documents, RULES), ["rule", "category", "severity"])


@query(f"""
WITH h AS ({_rules_sql()}), i AS (SELECT doc_id, rule, lower(regexp_replace(original_text, '\\s+', '', 'g')) AS o, lower(regexp_replace(concat_ws(' ', rule, category, original_text, suggestion), '\\s+', '', 'g')) AS blob FROM h),
g AS (SELECT doc_id, doc_id AS gold_id, text AS selected, lang AS comment, CASE WHEN doc_id % 3 = 0 THEN 'R00' || (doc_id % 8 + 1) END AS rule FROM documents)
SELECT gold_id, doc_id, g.rule, EXISTS (SELECT 1 FROM i WHERE i.doc_id = g.doc_id AND (coalesce(i.rule = g.rule, false)
  OR (length(s) >= 2 AND contains(blob, s)) OR (length(c) >= 2 AND contains(blob, c)) OR (length(o) >= 2 AND contains(s, o)) OR (length(left(s, 40)) >= 2 AND contains(blob, left(s, 40))))) AS found
FROM (SELECT *, lower(regexp_replace(selected, '\\s+', '', 'g')) AS s, lower(regexp_replace(comment, '\\s+', '', 'g')) AS c FROM g) g
""")
def gold_annotation_match(t):
    gold = t.documents.select("doc_id", F.col("doc_id").alias("gold_id"), F.col("text").alias("selected"), F.col("lang").alias("comment"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("R00"), F.col("doc_id") % 8 + 1)).alias("rule"))
    found = I.detect(t.documents, RULES).withColumn("blob", I.blob())
    return E.gold_hits(gold, found, "doc_id").select("gold_id", "doc_id", "rule", "found")


@query("""
SELECT user_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_at, count(*) AS n, count(*) FILTER (value >= 50) AS accepted, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS categories,
  round(count(*) FILTER (value >= 50)::DOUBLE / count(*)::DOUBLE * 100::DOUBLE, 1) AS accept_rate FROM events GROUP BY user_id ORDER BY max(ts) DESC, user_id LIMIT 20
""")
def session_stats(t):
    out = E.session_dashboard(t.events, "user_id", "event_type", F.col("value") >= 50, "ts")
    return out.withColumns({"categories": F.array_join("categories", ","), "last_at": F.date_format("last_at", "yyyy-MM-dd HH:mm:ss")})


@query("""
WITH s AS (SELECT o_custkey, o_orderkey, o_totalprice, o_orderpriority, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders)
SELECT o_custkey, count(*) AS runs, arg_max(o_totalprice, o_orderkey) AS latest, round(avg(o_totalprice), 6) AS mean, round(arg_max(o_totalprice - before, o_orderkey), 4) AS change, array_to_string(list_sort(list_distinct(list(o_orderpriority))), ',') AS guides FROM s GROUP BY 1
""")
def document_stats(t):
    return E.document_dashboard(t.orders, "o_custkey", "o_orderkey", "o_totalprice", "o_orderpriority")


@query("""
SELECT n_name AS rule, coalesce(n, 0) AS triggers, last AS last_triggered FROM nation LEFT JOIN (SELECT c_nationkey * 2 AS c_nationkey, count(*) AS n, max(c_custkey) AS last FROM customer GROUP BY 1) ON c_nationkey = n_nationkey
""")
def rule_trigger_counts(t):
    rules = t.nation.select("n_nationkey", F.col("n_name").alias("rule"))
    hits = t.customer.select((F.col("c_nationkey") * 2).alias("n_nationkey"), "c_custkey")
    return E.trigger_counts(rules, hits, "n_nationkey", "c_custkey").drop("n_nationkey")


@query()
def gold_assignment(t):
    """The sentences of the benchmark's passages are gold rows; those of all documents are what was found."""
    rows = lambda d, i: G.exploded(d, X.sentences(F.col("text"), 5), i).select(F.lit(0).alias("all"), (F.col(i).cast("long") * NTH + F.col("idx")).alias("idx"), "text")
    return E.gold_assignment(rows(t.benchmark, "item_id"), rows(t.documents, "doc_id"), "all", 0.6).drop("all")
