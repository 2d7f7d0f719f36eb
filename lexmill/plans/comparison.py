"""Queries of matching, translation memory, parameters, readability and evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexmill.functions import text as X
from lexmill.operators import matching as M
from lexmill.operators import memory as T
from lexmill.operators import params as P
from lexmill.operators import quality as Y
from lexmill.operators import segments as G
from lexmill.operators.spread import cut
from lexmill.plans.registry import NTH, query


def _memory(t):
    """Sentences of the benchmark passages as entries, each with an invented translation."""
    rows = G.exploded(t.benchmark, X.sentences(F.col("text"), 5), "item_id")
    return rows.select((F.col("item_id") * NTH + F.col("idx")).alias("entry_ord"), F.col("text").alias("source_text"), F.concat(F.lit("t:"), "text").alias("translated_text"))


def _asked(t):
    rows = G.exploded(t.documents, X.sentences(F.col("text"), 5))
    return rows.select((F.col("doc_id") * NTH + F.col("idx")).alias("query_id"), "doc_id", "text")


_SENT = r"list_filter(list_transform(regexp_extract_all(text, '[^.!?\n]+[.!?]*'), lambda z: trim(z, ' ')), lambda z: length(z) >= 5)"
_META = rf"trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(regexp_replace(x, '\s+', ' ', 'g'), ' ')), '[_/]+', ' ', 'g'), '{X.metadata_pattern()}', ' ', 'g'), '\s+', ' ', 'g'), ' ')"
_TIERS = [
    r"lower(trim(regexp_replace(x, '\s+', ' ', 'g'), ' '))",
    r"lower(regexp_replace(x, '[^\p{L}\p{N}]+', '', 'g'))",
    r"array_to_string(regexp_extract_all(lower(x), '[\p{L}\p{N}]+'), ' ')",
    _META,
    rf"lower(regexp_replace({_META}, '[^\p{{L}}\p{{N}}]+', '', 'g'))",
    rf"array_to_string(regexp_extract_all({_META}, '[\p{{L}}\p{{N}}]+'), ' ')",
]
_TM = f"""
q AS (SELECT doc_id * {NTH} + i - 1 AS query_id, doc_id, x FROM (SELECT doc_id, unnest(s) AS x, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, {_SENT} AS s FROM documents))),
m AS (SELECT item_id * {NTH} + i - 1 AS entry_ord, x FROM (SELECT item_id, unnest(s) AS x, unnest(range(1, len(s) + 1)) AS i FROM (SELECT item_id, {_SENT} AS s FROM benchmark))),
qk AS ({' UNION ALL '.join(f"SELECT query_id, {i} AS tier, {k} AS key FROM q" for i, k in enumerate(_TIERS))}),
mk AS ({' UNION ALL '.join(f"SELECT entry_ord, x, {i} AS tier, {k} AS key FROM m" for i, k in enumerate(_TIERS))}),
mm AS (SELECT tier, key, min(entry_ord) AS entry_ord, arg_min(x, entry_ord) AS source FROM mk WHERE key <> '' GROUP BY ALL),
h AS (SELECT query_id, min(tier) AS tier, arg_min(entry_ord, tier) AS entry_ord, arg_min(source, tier) AS source FROM qk JOIN mm USING (tier, key) GROUP BY 1)
"""
_REASON = "CASE tier " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(T.TIERS)) + " END"


@query(f"WITH {_TM} SELECT q.query_id, {_REASON} AS reason, entry_ord, 't:' || source AS translated FROM q LEFT JOIN h USING (query_id)")
def tm_exact_cascade(t):
    return T.exact_tiers(_asked(t), _memory(t))


@query(rf"""
WITH {_TM}, u AS (SELECT q.query_id, d.lang, h.tier, len(regexp_extract_all(q.x, '[\x{{3400}}-\x{{4DBF}}\x{{4E00}}-\x{{9FFF}}\x{{F900}}-\x{{FAFF}}]|[\p{{L}}\p{{N}}]+(?:[''_.+-][\p{{L}}\p{{N}}]+)*')) AS units FROM q JOIN documents d USING (doc_id) LEFT JOIN h USING (query_id))
SELECT lang, count(*) AS rows, count(tier) AS matched_rows, sum(units)::BIGINT AS units, coalesce(sum(units) FILTER (tier IS NOT NULL), 0)::BIGINT AS matched_units,
  round(count(tier)::DOUBLE / count(*)::DOUBLE * 100::DOUBLE, 1) AS row_rate, coalesce(round(coalesce(sum(units) FILTER (tier IS NOT NULL), 0)::DOUBLE / nullif(sum(units), 0)::DOUBLE * 100::DOUBLE, 1), 0) AS unit_rate FROM u GROUP BY lang
""")
def tm_coverage(t):
    asked = _asked(t)
    units = asked.join(t.documents.select("doc_id", "lang"), "doc_id").select("query_id", "lang", X.text_units(F.col("text")).alias("units"))
    return T.coverage(T.exact_tiers(asked, _memory(t)), units, ["lang"])


@query()
def tm_fuzzy(t):
    asked, bank = _asked(t), _memory(t)
    left = asked.join(T.exact_tiers(asked, bank).where("reason is null").select("query_id"), "query_id")
    return T.fuzzy_tail(left, bank, 0.8)


@query(rf"""
WITH q AS (SELECT doc_id * {NTH} + i - 1 AS query_id, ' ' || array_to_string(regexp_extract_all(lower(x), '[\p{{L}}\p{{N}}]+'), ' ') || ' ' AS line FROM (SELECT doc_id, unnest(s) AS x, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, {_SENT} AS s FROM documents))),
m AS (SELECT item_id * {NTH} + i - 1 AS entry_ord, x, regexp_extract_all(lower(x), '[\p{{L}}\p{{N}}]+') AS w FROM (SELECT item_id, unnest(s) AS x, unnest(range(1, len(s) + 1)) AS i FROM (SELECT item_id, {_SENT} AS s FROM benchmark))),
j AS (SELECT query_id, entry_ord, CAST(len(w) AS INTEGER) AS words, 't:' || x AS translated FROM q JOIN m ON len(w) >= 4 AND contains(line, ' ' || array_to_string(w, ' ') || ' '))
SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY words DESC, entry_ord) = 1
""")
def tm_contained(t):
    return T.contained(_asked(t), _memory(t), least_words=4)


def _sides(t):
    """Sentences of the first and of the second document of each pair of documents."""
    rows = G.exploded(t.documents, X.sentences(F.col("text"), 5)).select((F.col("doc_id") / 2).cast("long").alias("pair"), (F.col("doc_id") % 2).alias("side"), "idx", "text")
    return rows.where("side = 0").drop("side"), rows.where("side = 1").drop("side")


@query()
def fuzzy_sentence_match(t):
    return M.with_exact(*_sides(t), "pair", 0.80)


@query()
def fuzzy_jaccard(t):
    a, b = (cut(rows, "sentences") for rows in _sides(t))
    return M.fuzzy_jaccard(M.with_exact(a, b, "pair", 0.80), a, b, "pair")


@query()
def optimal_assignment(t):
    a, b = _sides(t)
    return M.optimal(M.alike(a, b, "pair", 0.5), "pair")


@query()
def aligned_turns(t):
    """The first and third turns of each four, of whatever role, against the second and fourth."""
    rows = t.conversations.select("conv_id", F.col("turn").alias("idx"), "text")
    return M.aligned_in_order(rows.where("idx % 2 = 0"), rows.where("idx % 2 = 1"), "conv_id", least=0.3)


def _neighbours(t):
    b = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return t.conversations.select("conv_id", "turn", F.col("text").alias("a"), b.alias("b")).where("b is not null")


@query()
def cat_similarity(t):
    a, b = X.tokens(F.col("a")), X.tokens(F.col("b"))
    rows = _neighbours(t).withColumns({"edit": M.ratio("a", "b"), "lcs": M.lcs_ratio("a", "b")})
    return rows.select("conv_id", "turn", "edit", "lcs", M.combined_similarity(F.col("edit"), X.jaccard(X.word_ngrams(a), X.word_ngrams(b)), X.overlap(F.array_distinct(a), F.array_distinct(b))).alias("similarity"))


@query()
def word_diff(t):
    return _neighbours(t).select("conv_id", "turn", F.posexplode(M.word_diff("a", "b")).alias("step", "d")).select("conv_id", "turn", "step", "d.*")


@query("""
WITH s AS (SELECT l_discount * 10 AS x, CASE WHEN l_discount * 10 >= 1 AND l_discount * 10 <= 1 THEN '100' WHEN l_discount * 10 >= 0.99 AND l_discount * 10 <= 1 THEN '99-100' WHEN l_discount * 10 >= 0.8 AND l_discount * 10 <= 0.99 THEN '80-99'
  WHEN l_discount * 10 >= 0.7 AND l_discount * 10 <= 0.8 THEN '70-80' WHEN l_discount * 10 >= 0.5 AND l_discount * 10 <= 0.7 THEN '50-70' WHEN l_discount * 10 >= 0 AND l_discount * 10 <= 0.5 THEN '0-50' END AS bucket FROM lineitem)
SELECT bucket, count(*) AS n FROM s GROUP BY 1
""".replace("0.99 ", "0.99::DOUBLE ").replace("0.8 ", "0.8::DOUBLE ").replace("0.7 ", "0.7::DOUBLE ").replace("0.5 ", "0.5::DOUBLE "))
def similarity_buckets(t):
    return t.lineitem.groupBy(M.bucket(F.col("l_discount") * 10).alias("bucket")).agg(F.count("*").alias("n"))


@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(0, len(string_split(text, chr(10))))) AS ord FROM documents),
m AS (SELECT doc_id, ord, regexp_replace(raw, '^\s*(?:[-*•+]|\d+[.)])\s+', '') AS line, trim(lead(raw) OVER (PARTITION BY doc_id ORDER BY ord), ' ') AS below FROM l),
x AS (SELECT doc_id, ord, line, below, regexp_extract(line, '^\s*([^:|]+?)\s*:\s*(\S.*?)\s*$', 1) AS n1, regexp_extract(line, '^\s*([^:|]+?)\s*:\s*(\S.*?)\s*$', 2) AS v1,
  regexp_extract(line, '^\s*\|?\s*([^|]+?)\s*\|\s*([^|]+?)\s*\|?\s*$', 1) AS n2, regexp_extract(line, '^\s*\|?\s*([^|]+?)\s*\|\s*([^|]+?)\s*\|?\s*$', 2) AS v2, regexp_matches(line, '^\s*([^:|]+?)\s*:\s*(\S.*?)\s*$') AS colon FROM m),
y AS (SELECT *, CASE WHEN colon THEN n1 ELSE n2 END AS n3, CASE WHEN colon THEN v1 ELSE v2 END AS v3, NOT regexp_matches(line, '[\d:|]') AND regexp_matches(coalesce(below, ''), '^[<>≤≥±~]?\s*\d') AS over_ FROM x),
z AS (SELECT doc_id, ord, CASE WHEN n3 = '' AND over_ THEN trim(line, ' ') ELSE n3 END AS name, CASE WHEN n3 = '' AND over_ THEN below ELSE v3 END AS value FROM y)
SELECT doc_id, ord, name, value FROM z WHERE name <> '' AND value <> '' AND length(name) <= 40 AND NOT regexp_matches(value, '^[-=\s]+$')
""")
def param_extraction(t):
    return P.extract(t.documents, longest_name=40, two_lines=True).withColumn("ord", F.col("ord").cast("long"))


@query()
def param_compare(t):
    rows = t.part.select("p_brand", F.col("p_partkey").alias("ord"), F.concat("p_name", F.lit(" ("), "p_type", F.lit(")")).alias("name"), F.col("p_size").cast("string").alias("value"), (F.col("p_partkey") % 2).alias("side"))
    return P.compare(rows.where("side = 0"), rows.where("side = 1"), "p_brand")


_MEAN = "coalesce(list_avg(list_transform({}, lambda z: len(list_filter(string_split_regex(trim(z, ' '), '\\s+'), lambda w: w <> ''))::DOUBLE)), 0)"


@query(rf"""
WITH x AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?\n]+[.!?]*'), lambda z: trim(z, ' ')), lambda z: length(z) >= 2) AS s,
  list_filter(list_transform(string_split_regex(text, '\n+'), lambda z: trim(z, ' ')), lambda z: length(z) >= 5) AS p, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS t,
  len(regexp_extract_all(lower(text), '{Y.Readability().stack}')) AS stacks FROM documents),
y AS (SELECT doc_id, CAST(len(s) AS INTEGER) AS sentences, CAST(len(p) AS INTEGER) AS paragraphs, {_MEAN.format('s')} AS sm, {_MEAN.format('p')} AS pm, stacks,
  CASE WHEN len(t) > 0 THEN len(list_filter(t, lambda w: length(w) > 6 OR regexp_matches(w, '\d')))::DOUBLE / len(t) ELSE 0 END AS terms,
  CASE WHEN len(s) > 0 THEN len(list_filter(s, lambda z: regexp_matches(lower(z), '{Y.Readability().passive}')))::DOUBLE / len(s) ELSE 0 END AS passives FROM x),
z AS (SELECT doc_id, sentences, paragraphs, greatest(0::DOUBLE, least(100::DOUBLE, round(100 - greatest(0::DOUBLE, sm - 20) * 3::DOUBLE, 1))) AS sentence_score,
  greatest(0::DOUBLE, least(100::DOUBLE, round(100 - greatest(0::DOUBLE, terms - 0.15::DOUBLE) / 0.05::DOUBLE * 8::DOUBLE, 1))) AS term_score,
  greatest(0::DOUBLE, least(100::DOUBLE, round(100 - greatest(0::DOUBLE, passives - 0.1::DOUBLE) / 0.05::DOUBLE * 10::DOUBLE, 1))) AS passive_score,
  greatest(0::DOUBLE, least(100::DOUBLE, round(100 - greatest(0::DOUBLE, pm - 80) / 20::DOUBLE * 10::DOUBLE, 1))) AS paragraph_score,
  greatest(0::DOUBLE, least(100::DOUBLE, round(100 - stacks * 4::DOUBLE, 1))) AS stack_score FROM y),
o AS (SELECT *, greatest(0::DOUBLE, least(100::DOUBLE, round(0::DOUBLE + sentence_score * 0.25::DOUBLE + term_score * 0.2::DOUBLE + passive_score * 0.2::DOUBLE + paragraph_score * 0.15::DOUBLE + stack_score * 0.2::DOUBLE, 1))) AS overall FROM z)
SELECT *, CASE WHEN overall >= 85 THEN 'excellent' WHEN overall >= 70 THEN 'good' WHEN overall >= 55 THEN 'fair' ELSE 'poor' END AS level FROM o
""")
def readability_score(t):
    return Y.readability(t.documents)
