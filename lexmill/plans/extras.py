"""Further queries: pages, previews, model findings, clauses and glossaries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexmill.functions import text as X
from lexmill.operators import issues as I
from lexmill.operators import matching as M
from lexmill.operators import memory as T
from lexmill.operators import segments as G
from lexmill.plans.findings import RULES, _rules_sql
from lexmill.plans.registry import NTH, query

GLOSSARY = {"the": "der", "tion": "ung", "ment": "heit", "ing": "end"}


@query("""
WITH p AS (SELECT conv_id, CAST(turn AS BIGINT) AS page_num, text FROM conversations), s AS (SELECT conv_id, turn, substr(text, length(text) // 2, 60) AS snippet FROM conversations)
SELECT s.conv_id, s.turn, s.snippet, coalesce((SELECT min(page_num) FROM p WHERE p.conv_id = s.conv_id AND trim(left(s.snippet, 40), ' ') <> '' AND contains(p.text, trim(left(s.snippet, 40), ' '))), 0) AS page FROM s
""")
def snippet_page(t):
    pages = t.conversations.select("conv_id", F.col("turn").alias("page_num"), "text")
    snippets = t.conversations.select("conv_id", "turn", F.substring(F.col("text"), F.floor(F.length("text") / 2).cast("int"), F.lit(60)).alias("snippet"))
    return G.page_of(snippets, pages, key="conv_id")


@query(r"""
WITH x AS (SELECT doc_id, unnest(s) AS text, CAST(unnest(range(0, len(s))) AS INTEGER) AS idx FROM (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?\n]+[.!?]*'), lambda z: trim(z, ' ')), lambda z: length(z) >= 2) AS s FROM documents))
SELECT doc_id, idx, text, row_number() OVER (PARTITION BY doc_id ORDER BY length(text) DESC, idx) AS rank FROM x QUALIFY rank <= 3
""")
def longest_sentences(t):
    return G.longest(G.exploded(t.documents, X.sentences(F.col("text"), 2)), "doc_id", "idx")


@query("SELECT p_partkey, p_name, p_brand, p_type, (SELECT count(*) FROM part) AS total_rows, 6 AS total_columns FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20")
def table_preview(t):
    return G.preview(t.part, [F.desc("p_retailprice"), "p_partkey"], n=20, columns=4)


@query(f"""
WITH h AS ({_rules_sql('doc_id, text', 'doc_id, text')}), c AS (SELECT * FROM h WHERE confidence >= 88 AND trim(original_text, ' ') <> '' AND contains(lower(regexp_replace(text, '\\s+', '', 'g')), lower(regexp_replace(original_text, '\\s+', '', 'g'))))
SELECT doc_id, rule, nth FROM c QUALIFY row_number() OVER (PARTITION BY doc_id, lower(regexp_replace(original_text, '\\s+', '', 'g')) ORDER BY rule, nth) = 1
""")
def model_findings_normalized(t):
    rows = I.detect(t.documents, RULES).join(t.documents.select("doc_id", X.compact(F.col("text")).alias("compact")), "doc_id")
    rows = rows.withColumn("order", F.struct("rule", "nth"))
    return I.normalized_candidates(rows, "doc_id", "order", least=88, content=F.col("compact")).select("doc_id", "rule", F.col("nth").cast("long").alias("nth"))


@query(r"""
WITH c AS (SELECT doc_id, k, x, lower(regexp_replace(x, '[^\p{L}\p{N}]+', '', 'g')) AS key FROM (SELECT doc_id, unnest(p) AS x, unnest(range(0, len(p))) AS k FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '[,;:.!?\n]+'), lambda z: trim(z, ' ')), lambda z: z <> '') AS p FROM documents))),
m AS (SELECT key, arg_min(x, (item_id, k)) AS hit FROM (SELECT item_id, k, x, lower(regexp_replace(x, '[^\p{L}\p{N}]+', '', 'g')) AS key FROM (SELECT item_id, unnest(p) AS x, unnest(range(0, len(p))) AS k FROM (SELECT item_id, list_filter(list_transform(string_split_regex(text, '[,;:.!?\n]+'), lambda z: trim(z, ' ')), lambda z: z <> '') AS p FROM benchmark))) WHERE key <> '' GROUP BY 1)
SELECT doc_id AS query_id, string_agg(coalesce('t:' || hit, x), ', ' ORDER BY k) AS translated, count(hit) AS matched, count(*) AS clauses FROM c LEFT JOIN m USING (key) GROUP BY doc_id HAVING count(hit) > 0
""")
def tm_by_clauses(t):
    parts = F.filter(F.transform(F.split("text", r"[,;:.!?\n]+"), lambda p: F.trim(p)), lambda p: p != "")
    bank = G.exploded(t.benchmark, parts, "item_id").select((F.col("item_id") * NTH + F.col("idx")).alias("entry_ord"), F.col("text").alias("source_text"), F.concat(F.lit("t:"), "text").alias("translated_text"))
    return T.by_clauses(t.documents, bank, query_id="doc_id")


@query(" UNION ALL ".join(f"SELECT * FROM (SELECT conv_id * 100 + turn AS query_id, '{a}' AS term, '{b}' AS translation, CAST((length(text) - length(replace(lower(text), '{a}', ''))) / {len(a)} AS BIGINT) AS n FROM conversations) WHERE n > 0" for a, b in GLOSSARY.items()))
def glossary_hits(t):
    rows = t.conversations.select((F.col("conv_id") * 100 + F.col("turn")).alias("query_id"), "text")
    return T.glossary_hits(rows, GLOSSARY)


@query()
def clause_similarity(t):
    b = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = t.conversations.select("conv_id", "turn", F.col("text").alias("a"), b.alias("b")).where("b is not null")
    return rows.select("conv_id", "turn", M.clause_similarity(F.col("a"), F.col("b"), M.lcs_ratio("a", "b")).alias("similarity"))


@query()
def topic_match(t):
    rows = t.part.select("p_brand", F.col("p_partkey").alias("idx"), F.concat_ws(" ", "p_name", "p_type").alias("text"), (F.col("p_size") > 25).alias("large"))
    return M.topic_match(rows.where("large"), rows.where("NOT large"), "p_brand")
