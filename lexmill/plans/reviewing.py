"""Queries of the review pipeline: scores, noise, keys and the checks of model findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import text as X
from lexmill.operators import issues as I
from lexmill.operators import review as V
from lexmill.operators import segments as G
from lexmill.plans.findings import RULES, TOPICS, _rules_sql
from lexmill.plans.registry import query

POLICY = V.Policy(
    high="credential|license|address",
    high_prefixes=("R004",),
    low="one mark",
    layout="one space",
    unit_categories=("unit",),
    mark_rules=("R002",),
    minor_categories=("tone",),
    spelling_rules=("R007",),
    model_categories=("tone", "privacy"),
    quote_rules=("R003",),
    sole_rules=("R005",),
    position_rules=("R001", "R008"),
    kept_of={"R006": 2},
)


def _found(t):
    """Findings of all rules, each with its place as position, the source as chapter and a penalty of its own."""
    rows = I.detect(t.documents.withColumnRenamed("source", "chapter"), RULES, keep=("doc_id", "chapter"))
    return rows.withColumns({"nth": F.col("nth").cast("long"), "position": F.col("nth"), "penalty": (F.col("nth") % 7).cast("int"), "context": F.lit("")})


_B = "concat_ws(' ', rule, category, original_text, suggestion)"
_MINOR = "severity IN ('general', 'suggestion')"
_LAYOUT = f"regexp_matches({_B}, '(?i)one space')"
_HIGH = f"(NOT ({_LAYOUT} OR (rule = 'R002' OR category = 'tone') AND {_MINOR}) AND (starts_with(rule, 'R004') OR regexp_matches({_B}, '(?i)credential|license|address')))"
_LOW = f"regexp_matches({_B}, '(?i)one mark')"
_VALUE = f"""greatest(0, least(100, 50 + CASE severity WHEN 'fatal' THEN 25 WHEN 'serious' THEN 18 WHEN 'general' THEN 6 WHEN 'suggestion' THEN -8 ELSE 0 END
  + CASE source WHEN 'rule' THEN 8 WHEN 'term' THEN 6 WHEN 'ai' THEN -2 ELSE 0 END + CASE WHEN confidence >= 95 THEN 10 WHEN confidence >= 90 THEN 6 WHEN confidence > 0 AND confidence < 80 THEN -12 ELSE 0 END
  + CASE WHEN {_HIGH} THEN 30 ELSE 0 END + CASE WHEN rule <> 'R007' THEN 0 WHEN severity = 'serious' OR confidence >= 95 THEN 14 ELSE -18 END + CASE WHEN category = 'unit' THEN -42 ELSE 0 END
  + CASE WHEN rule = 'R002' AND {_MINOR} THEN -32 ELSE 0 END + CASE WHEN category = 'tone' AND NOT {_HIGH} THEN -26 ELSE 0 END + CASE WHEN {_LOW} THEN -55 ELSE 0 END
  + CASE WHEN source = 'spellcheck' AND NOT {_HIGH} THEN -4 ELSE 0 END + CASE WHEN source = 'ai' AND category IN ('tone', 'privacy') AND NOT {_HIGH} THEN -20 ELSE 0 END
  + CASE WHEN original_text = '' OR suggestion = '' THEN -20 ELSE 0 END - penalty))"""
_T = "trim(regexp_replace(original_text, '\\s+', ' ', 'g'), ' ')"
_NOISE = f"""(source <> 'spellcheck' AND ({_MINOR} AND length({_T}) <= 3 AND regexp_matches({_T}, '^[^\\p{{L}}\\p{{N}}]+$') OR {_LAYOUT} OR rule = 'R003' AND NOT regexp_matches(original_text, '[''"“”‘’]')
  OR category = 'unit' AND {_MINOR} OR rule = 'R002' AND {_MINOR} OR category = 'tone' AND {_MINOR} AND NOT {_HIGH} OR source = 'ai' AND (value < 30 AND NOT {_HIGH} OR {_LOW}) OR regexp_matches(original_text, '(?i)one mark') AND NOT {_HIGH}))"""
_TOPIC = f"CASE WHEN regexp_matches({_B}, '(?i)credential|password') THEN 'credential' WHEN regexp_matches({_B}, '(?i)license') THEN 'license' WHEN regexp_matches({_B}, '(?i)address') THEN 'privacy' ELSE '' END"
_FOUND = f"h AS (SELECT *, nth AS position, CAST(nth % 7 AS INTEGER) AS penalty FROM ({_rules_sql('doc_id, source AS chapter', 'doc_id, chapter')})), v AS (SELECT *, {_VALUE} AS value FROM h), n AS (SELECT *, {_NOISE} AS noise, {_HIGH} AS high FROM v)"


@query(f"WITH {_FOUND} SELECT doc_id, rule, nth, CAST(value AS INTEGER) AS score, high, noise FROM n")
def review_values(t):
    rows = _found(t)
    return rows.select("doc_id", "rule", "nth", V.value_score(POLICY).alias("score"), V.is_high(POLICY).alias("high"), V.is_noise(POLICY).alias("noise"))


@query(rf"""
WITH {_FOUND}, f AS (SELECT *, {_TOPIC} AS topic, lower(regexp_replace(original_text, '\s+', '', 'g')) AS x, sum(CASE WHEN regexp_matches({_B}, '(?i)R006') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY rule, nth ROWS UNBOUNDED PRECEDING) AS k FROM n WHERE NOT noise AND trim(original_text, ' ') <> ''),
s AS (SELECT *, value AS score, CASE WHEN topic <> '' THEN 'topic|' || topic || '|' || left(x, 80) WHEN rule = 'R005' THEN rule WHEN source = 'spellcheck' OR rule = 'R007' THEN 'spell|' || rule || '|' || x WHEN rule IN ('R001', 'R008') THEN rule || '|' || x || '|' || position
  ELSE rule || '|' || x || '|' || lower(regexp_replace(chapter, '\s+', '', 'g')) END AS dedupe_key FROM f WHERE (NOT regexp_matches({_B}, '(?i)R006') OR k <= 2) AND value >= CASE WHEN severity IN ('fatal', 'serious') THEN 38 ELSE 45 END),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY doc_id, dedupe_key ORDER BY score DESC, CASE severity WHEN 'fatal' THEN 4 WHEN 'serious' THEN 3 WHEN 'general' THEN 2 WHEN 'suggestion' THEN 1 ELSE 0 END DESC,
  CASE source WHEN 'rule' THEN 4 WHEN 'term' THEN 3 WHEN 'grammar' THEN 2 WHEN 'ai' THEN 1 ELSE 0 END DESC, confidence DESC, nth, rule) = 1)
SELECT doc_id, rule, nth, CAST(score AS INTEGER) AS score, dedupe_key FROM (SELECT *, bool_or(source <> 'ai') OVER (PARTITION BY doc_id, topic) AS bt, bool_or(source <> 'ai') OVER (PARTITION BY doc_id, topic, x) AS bx FROM b)
WHERE NOT (source = 'ai' AND topic <> '' AND (bx OR (topic = 'privacy' AND bt)))
""")
def review_selection(t):
    return V.select(_found(t), POLICY, TOPICS, shadowed=("privacy",)).select("doc_id", "rule", "nth", "score", "dedupe_key")


CHECKS = V.Checks(no_change="no change needed", basis="style guide", protected=(("thatin", "thitan"),), rewriting=("ensure",), fillers=("so", "the"), dangling=r"\b(?:the|die)$", label_report="button label", label_text="^en", control_report="missing icon", control_text="^th", swaps=(("der", "die"),))


def _proposed(t):
    """A suggestion of one of 18 kinds for every sentence of every turn."""
    rows = G.exploded(t.conversations.withColumn("key", F.struct("conv_id", "turn", "text")), X.sentences(F.col("text"), 5), "key")
    rows = rows.select("key.conv_id", "key.turn", "idx", F.col("key.text").alias("content"), F.col("text").alias("o"))
    k, o = (F.col("turn") * 5 + F.col("idx")) % 18, F.col("o")
    original = F.when(k == 0, "").when(k == 4, F.concat(o, F.lit("qq"))).when(k == 5, F.substring(o, 2, 4)).otherwise(o)
    suggestion = (
        F.when(k.isin(0, 1), "").when(k == 6, F.concat(F.lit("("), o, F.lit(")"))).when(k == 7, F.concat(o, F.lit(" 5ml"))).when(k == 8, F.replace(o, F.lit("the "), F.lit("thet ")))
        .when(k == 9, F.reverse(o)).when(k == 10, F.concat(o, F.lit(" "), o, F.lit(" and so it goes on for long"))).when(k == 11, F.concat(F.lit("so "), o)).when(k == 12, F.concat(F.lit("it "), o))
        .when(k == 13, F.replace(o, F.lit("der"), F.lit("die"))).when(k == 14, F.replace(o, F.lit("th"), F.lit("the "))).when(k == 15, F.concat(o, F.lit(" the"))).when(k == 16, F.concat(F.lit("ensure that one of all "), o)).otherwise(F.replace(o, F.lit("e"), F.lit("a")))
    )
    about = F.when(k == 1, "").when(k == 2, "No change needed").when(k == 3, "see the style guide").when(k == 11, "button label").when(k == 12, "missing icon").otherwise("better")
    empty = F.lit("")
    return rows.select("conv_id", "turn", "idx", "content", original.alias("original_text"), suggestion.alias("suggestion"), about.alias("description"), empty.alias("rule"), empty.alias("category"), empty.alias("chapter"), empty.alias("audit_basis"))


_R = "regexp_replace(lower(trim(regexp_replace({}, '\\s+', ' ', 'g'), ' ')), '\\.+$', '')"
_ER = "CASE WHEN length({a}) + length({b}) = 0 THEN 1 ELSE greatest(0::DOUBLE, 1 - 2 * levenshtein({a}, {b})::DOUBLE / (length({a}) + length({b}))) END"
_LIKE = f"((length(x) > 3 AND length(y) > 3 AND {_ER.format(a='x', b='y')} >= 0.72) OR (regexp_replace(x, 's+$', '') = regexp_replace(y, 's+$', '') AND abs(length(x) - length(y)) <= 2))"
_JAC = "len(list_intersect({a}, {b}))::DOUBLE / nullif(len(list_distinct(list_concat({a}, {b}))), 0)"
CHECK_SQL = rf"""
WITH e AS (SELECT conv_id, turn, content, unnest(s) AS o, CAST(unnest(range(0, len(s))) AS INTEGER) AS idx FROM (SELECT conv_id, turn, text AS content, list_filter(list_transform(regexp_extract_all(text, '[^.!?\n]+[.!?]*'), lambda z: trim(z, ' ')), lambda z: length(z) >= 5) AS s FROM conversations)),
p AS (SELECT *, (turn * 5 + idx) % 18 AS k FROM e),
q AS (SELECT conv_id, turn, idx, content, CASE k WHEN 0 THEN '' WHEN 4 THEN o || 'qq' WHEN 5 THEN substr(o, 2, 4) ELSE o END AS original,
  CASE k WHEN 0 THEN '' WHEN 1 THEN '' WHEN 6 THEN '(' || o || ')' WHEN 7 THEN o || ' 5ml' WHEN 8 THEN replace(o, 'the ', 'thet ') WHEN 9 THEN reverse(o) WHEN 10 THEN o || ' ' || o || ' and so it goes on for long' WHEN 11 THEN 'so ' || o WHEN 12 THEN 'it ' || o
    WHEN 13 THEN replace(o, 'der', 'die') WHEN 14 THEN replace(o, 'th', 'the ') WHEN 15 THEN o || ' the' WHEN 16 THEN 'ensure that one of all ' || o ELSE replace(o, 'e', 'a') END AS suggestion,
  CASE k WHEN 1 THEN '' WHEN 2 THEN 'No change needed' WHEN 3 THEN 'see the style guide' WHEN 11 THEN 'button label' WHEN 12 THEN 'missing icon' ELSE 'better' END AS description FROM p),
r AS (SELECT conv_id, turn, idx, {_R.format('original')} AS o, {_R.format('suggestion')} AS s, {_R.format('description')} AS d, {_R.format('content')} AS c FROM q),
w AS (SELECT *, instr(c, o) AS at_, list_distinct(regexp_extract_all(o, '[a-z][a-z0-9'']+')) AS wo, list_distinct(regexp_extract_all(s, '[a-z][a-z0-9'']+')) AS ws,
  regexp_extract_all(o, '\b\d+(?:\.\d+)?\b') AS no, regexp_extract_all(s, '\b\d+(?:\.\d+)?\b') AS ns, list_filter(regexp_extract_all(o, '[a-z0-9]+'), lambda z: z NOT IN ('a', 'an', 'the')) AS po, list_filter(regexp_extract_all(s, '[a-z0-9]+'), lambda z: z NOT IN ('a', 'an', 'the')) AS ps,
  regexp_matches(o, '\b\d+(?:\.\d+)?(?:ml|mm|cm|kg|mg|min|gb|mb)\b') AND regexp_matches(s, '\b\d+(?:\.\d+)?\s+(?:ml|mm|cm|kg|mg|min|gb|mb)\b') AS unit_fixed FROM r),
y AS (SELECT *, list_filter(ws, lambda z: NOT list_contains(wo, z)) AS fresh, list_filter(wo, lambda z: NOT list_contains(ws, z)) AS gone, list_distinct(list_filter(po, lambda z: length(z) > 1)) AS so, list_distinct(list_filter(ps, lambda z: length(z) > 1)) AS ss FROM w),
z AS (SELECT *, len(fresh) = len(gone) AND len(fresh) BETWEEN 1 AND 2 AND len(list_filter(fresh, lambda y: len(list_filter(gone, lambda x: {_LIKE})) = 0)) = 0 AS small, coalesce({_JAC.format(a='wo', b='ws')}, 0) AS jac, length(s)::DOUBLE / greatest(length(o), 1) AS size,
  len(list_filter(list_concat(list_filter(so, lambda q: NOT list_contains(ss, q)), list_filter(ss, lambda q: NOT list_contains(so, q))), lambda q: q NOT IN ('so', 'the'))) AS moved FROM y)
SELECT conv_id, turn, idx, CASE WHEN o = '' THEN 'missing_original_text' WHEN s = '' AND d = '' THEN 'missing_suggestion_and_description' WHEN regexp_matches(concat_ws(' ', o, s, d), 'no change needed') THEN 'explicit_no_change'
  WHEN regexp_matches(concat_ws(' ', o, s, d), 'style guide') THEN 'audit_basis_leak' WHEN at_ = 0 THEN 'original_text_not_found'
  WHEN regexp_matches(left(o, 1), '^\p{{L}}$') AND at_ > 1 AND regexp_matches(substr(c, at_ - 1, 1), '^\p{{L}}$') OR regexp_matches(right(o, 1), '^\p{{L}}$') AND regexp_matches(substr(c, at_ + length(o), 1), '^\p{{L}}$') THEN 'truncated_word_fragment'
  WHEN s <> '' AND NOT unit_fixed AND regexp_replace(regexp_replace(o, '<[^>]+>', ' ', 'g'), '[^\p{{L}}\p{{N}}%°+]+', '', 'g') = regexp_replace(regexp_replace(s, '<[^>]+>', ' ', 'g'), '[^\p{{L}}\p{{N}}%°+]+', '', 'g') THEN 'noop_suggestion'
  WHEN s <> '' AND regexp_matches(s, '\b\d+(?:\.\d+)?(?:ml|mm|cm|kg|mg|min|gb|mb)\b') AND NOT unit_fixed THEN 'number_unit_spacing_regression'
  WHEN s <> '' AND (len(no) > 0 AND len(ns) > 0 AND no <> ns OR contains(o, 'thatin') AND contains(s, 'thitan') AND NOT contains(s, 'thatin')) THEN 'protected_meaning_changed'
  WHEN s <> '' AND o <> s AND NOT small AND len(wo) + len(ws) > 0 AND (jac < 0.5 AND size BETWEEN 0.55 AND 1.9 OR jac < 0.55 AND size < 0.72 OR len(fresh) + len(gone) >= 5 AND list_contains(fresh, 'ensure') AND jac < 0.9) THEN 'aggressive_rewrite'
  WHEN s <> '' AND starts_with(s, o) AND s <> o AND (regexp_matches(o, '\b(?:the|die)$') AND length(s) >= length(o) + 8 OR length(o) <= 40 AND length(s) >= 2 * length(o)) THEN 'speculative_completion'
  WHEN regexp_matches(concat_ws(' ', '', '', d, s), 'button label') AND regexp_matches(o, '^en') THEN 'low_value_ui_bracket_labeling' WHEN regexp_matches(concat_ws(' ', '', '', d, s), 'missing icon') AND regexp_matches(o, '^th') THEN 'visual_control_ambiguity'
  WHEN s <> '' AND contains(o, 'der') AND contains(s, 'die') AND replace(o, 'der', '') = replace(s, 'die', '') THEN 'low_value_cn_term_swap'
  WHEN s <> '' AND NOT small AND (len(po) > 0 AND po = ps OR len(so) > 0 AND len(ss) > 0 AND coalesce({_JAC.format(a='so', b='ss')}, 0) >= 0.6 AND moved <= 3
    OR {_ER.format(a="array_to_string(po, ' ')", b="array_to_string(ps, ' ')")} >= 0.72 AND moved <= 4 AND len(po) > 0 AND len(ps) > 0) THEN 'low_value_english_rewrite' ELSE 'accepted' END AS reason FROM z
"""


@query(f"SELECT *, reason = 'accepted' AS accepted FROM ({CHECK_SQL})")
def issue_validation(t):
    return V.checked(_proposed(t), CHECKS).select("conv_id", "turn", "idx", "reason", "accepted")


@query(f"SELECT reason, count(*) AS n FROM ({CHECK_SQL}) WHERE reason <> 'accepted' GROUP BY 1")
def drop_reason_counts(t):
    return I.reason_counts(V.checked(_proposed(t), CHECKS).where("not accepted"))
