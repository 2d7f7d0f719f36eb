"""Queries of rule engines and the issue pipeline over documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexmill.functions import text as X
from lexmill.operators import issues as I
from lexmill.operators import stats as S
from lexmill.plans.registry import BEGIN, query

RULES = (
    I.Rule("R001", r"[!?]{2,}", "punctuation", "suggestion", suggestion="one mark"),
    I.Rule("R002", r"[#%$&*]{3,}", "punctuation", "general", suggestion="remove", confidence=96),
    I.Rule("R003", r"\b\d+(?:mm|cm|kg|ml)\b", "unit", "general", suggestion="space before the unit"),
    I.Rule("R004", r"[A-Z0-9_]+ = \"[0-9A-F]+\"", "security", "fatal", suggestion="remove the credential", confidence=97),
    I.Rule("R005", r"Licensed under [^.\n]+", "license", "serious", "term", "check the license", 91),
    I.Rule("R006", r"[\w.]+@[\w.]+\w", "privacy", "serious", "ai", "remove the address", 78),
    I.Rule("R007", r" {2,}", "spacing", "suggestion", "spellcheck", "one space", 85),
    I.Rule("R008", r"\b(?:stupid|idiot|moron)\b", "tone", "serious", "ai", "rephrase", 88),
)
TOPICS = {"credential": "credential|password", "license": "license", "privacy": "address"}
SCORING = I.Scoring(high_value="credential|license|address", low_value="one mark", low_rules=("R007",))


def _rules_sql(columns: str = "doc_id", names: str | None = None) -> str:
    return " UNION ALL ".join(
        f"SELECT {names or columns}, '{r.rule}' AS rule, '{r.category}' AS category, '{r.severity}' AS severity, '{r.source}' AS source, '{r.suggestion}' AS suggestion, {r.confidence} AS confidence, unnest(h) AS original_text, unnest(range(0, len(h))) AS nth FROM (SELECT {columns}, regexp_extract_all(text, '{r.pattern}') AS h FROM documents)"
        for r in RULES
    )


@query(_rules_sql())
def regex_rule_hits(t):
    return I.detect(t.documents, RULES).withColumn("nth", F.col("nth").cast("long"))


_BLOB = "concat_ws(' ', rule, category, original_text, suggestion)"
_SCORE = f"""greatest(0, least(100, 50 + CASE severity WHEN 'fatal' THEN 25 WHEN 'serious' THEN 18 WHEN 'general' THEN 6 WHEN 'suggestion' THEN -8 ELSE 0 END
  + CASE source WHEN 'rule' THEN 8 WHEN 'term' THEN 6 WHEN 'ai' THEN -2 ELSE 0 END
  + CASE WHEN confidence >= 95 THEN 10 WHEN confidence >= 90 THEN 6 WHEN confidence > 0 AND confidence < 80 THEN -12 ELSE 0 END
  + CASE WHEN regexp_matches({_BLOB}, '(?i)credential|license|address') THEN 30 ELSE 0 END
  - CASE WHEN regexp_matches({_BLOB}, '(?i)one mark') THEN 55 ELSE 0 END - CASE WHEN rule = 'R007' THEN 45 ELSE 0 END
  - CASE WHEN original_text = '' OR suggestion = '' THEN 20 ELSE 0 END))"""
_TOPIC = f"CASE WHEN regexp_matches({_BLOB}, '(?i)credential|password') THEN 'credential' WHEN regexp_matches({_BLOB}, '(?i)license') THEN 'license' WHEN regexp_matches({_BLOB}, '(?i)address') THEN 'privacy' ELSE '' END"


@query(f"WITH h AS ({_rules_sql()}) SELECT doc_id, rule, nth, {_SCORE} AS score, {_TOPIC} AS topic FROM h")
def issue_value_score(t):
    rows = I.detect(t.documents, RULES)
    return rows.select("doc_id", "rule", F.col("nth").cast("long").alias("nth"), I.value_score(SCORING).alias("score"), I.topic_of(TOPICS).alias("topic"))


_KEY = r"CASE WHEN topic <> '' THEN 'topic|' || topic || '|' || left(x, 80) WHEN source = 'spellcheck' THEN 'spell|' || rule || '|' || x ELSE rule || '|' || x || '|' || lower(regexp_replace(chapter, '\s+', '', 'g')) END"
_SELECTED = rf"""
WITH h AS ({_rules_sql('doc_id, source AS chapter', 'doc_id, chapter')}),
s AS (SELECT *, {_SCORE} AS score, {_TOPIC} AS topic, lower(regexp_replace(original_text, '\s+', '', 'g')) AS x FROM h
  WHERE trim(original_text, ' ') <> '' AND NOT (severity IN ('general', 'suggestion') AND length(trim(regexp_replace(original_text, '\s+', ' ', 'g'), ' ')) <= 3 AND regexp_matches(trim(regexp_replace(original_text, '\s+', ' ', 'g'), ' '), '^[^\p{{L}}\p{{N}}]+$'))),
k AS (SELECT *, {_KEY} AS dedupe_key FROM s WHERE score >= CASE WHEN severity IN ('fatal', 'serious') THEN 38 ELSE 45 END),
b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY doc_id, dedupe_key ORDER BY score DESC,
  CASE severity WHEN 'fatal' THEN 4 WHEN 'serious' THEN 3 WHEN 'general' THEN 2 WHEN 'suggestion' THEN 1 ELSE 0 END DESC,
  CASE source WHEN 'rule' THEN 4 WHEN 'term' THEN 3 WHEN 'grammar' THEN 2 WHEN 'ai' THEN 1 ELSE 0 END DESC, confidence DESC, nth, rule) = 1)
"""


@query(_SELECTED + "SELECT doc_id, rule, dedupe_key, score FROM b")
def issue_dedupe(t):
    rows = _scored(t)
    return I.best_per_key(rows, "doc_id", "nth").select("doc_id", "rule", "dedupe_key", "score")


def _found(t):
    return I.detect(t.documents.withColumnRenamed("source", "chapter"), RULES, keep=("doc_id", "chapter"))


def _scored(t):
    rows = _found(t).where(F.trim("original_text") != "").where(~I.is_noise())
    rows = rows.withColumn("score", I.value_score(SCORING)).withColumn("topic", I.topic_of(TOPICS))
    rows = rows.where(F.col("score") >= F.when(F.col("severity").isin("fatal", "serious"), 38).otherwise(45))
    return rows.withColumn("dedupe_key", I.dedupe_key())


@query(_SELECTED + """
SELECT doc_id, rule, nth, score, topic FROM (SELECT *, bool_or(source <> 'ai') OVER (PARTITION BY doc_id, topic) AS bt, bool_or(source <> 'ai') OVER (PARTITION BY doc_id, topic, x) AS bx FROM b)
WHERE NOT (source = 'ai' AND topic <> '' AND (bx OR (topic IN ('privacy', 'credential') AND bt)))
""")
def shadow_suppress(t):
    chosen = I.select_issues(_found(t), SCORING, TOPICS, shadowed=("privacy", "credential"))
    return I.ordered(chosen).select("doc_id", "rule", F.col("nth").cast("long").alias("nth"), "score", "topic")


@query(f"WITH h AS ({_rules_sql()}) SELECT CASE WHEN regexp_matches(category, 'security|privacy|license') THEN 'compliance' WHEN regexp_matches(category, 'punct|spac|unit') THEN 'format' ELSE 'content' END AS layer, count(*) AS n FROM h GROUP BY 1")
def issue_layers(t):
    return I.layers(I.detect(t.documents, RULES), {"compliance": "security|privacy|license", "format": "punct|spac|unit"})


@query(f"""
WITH h AS ({_rules_sql()}), s AS (SELECT *, {_SCORE} AS score FROM h)
SELECT rule, source, count(*) AS n, count(*) FILTER (score >= 60) AS high, round(count(*) FILTER (score >= 60)::DOUBLE / count(*)::DOUBLE * 100::DOUBLE, 1) AS high_rate,
  count(DISTINCT doc_id) AS documents FROM s GROUP BY ALL
""")
def effectiveness_summary(t):
    rows = I.detect(t.documents, RULES).withColumn("score", I.value_score(SCORING))
    out = rows.groupBy("rule", "source").agg(F.count("*").alias("n"), F.count_if(F.col("score") >= 60).alias("high"), F.countDistinct("doc_id").alias("documents"))
    return out.withColumn("high_rate", S.rate(F.col("high"), F.col("n")))


TERMS = {"thanor": "thanore", "onea": "oneable", "theer": "there", "que": "queue"}


@query(" UNION ALL ".join(f"SELECT * FROM (SELECT doc_id, '{b}' AS term, '{g}' AS standard, CAST(len(list_filter(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+'), lambda z: z = '{b}')) AS INTEGER) AS n FROM documents WHERE NOT contains(text, '{g}')) WHERE n > 0" for b, g in TERMS.items()))
def term_replace_hits(t):
    return I.replaced_terms(t.documents, TERMS)


@query(r"SELECT doc_id, unnest(regexp_extract_all(text, '\b\d+(?:mm|cm|kg|ml|GB|MB)\b')) AS original_text FROM documents".replace("unnest(", "unnest("))
def unit_spacing_issues(t):
    return I.detect(t.documents, [I.Rule("unit", r"\b\d+(?:mm|cm|kg|ml|GB|MB)\b")]).select("doc_id", "original_text")


@query(rf"""
SELECT doc_id, number FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '{BEGIN}th([a-f])', 1))) AS number, list_distinct(regexp_extract_all(lower(text), '{BEGIN}en([a-f])', 1)) AS defined FROM documents) WHERE NOT list_contains(defined, number)
""")
def reference_integrity(t):
    rows = t.documents.withColumn("text", F.lower("text"))
    return I.missing_references(rows, r"\bth([a-f])", r"\ben([a-f])")


FORMS = {"iso": r"\b\d{4}-\d{2}-\d{2}\b", "dotted": r"\b\d{1,2}\.\d{1,2}\.\d{4}\b", "digits": r"\b\d{3,}\b", "colon": r"\b\d+:\d+\b"}


@query("SELECT * FROM (SELECT *, CAST((iso > 0)::INT + (dotted > 0)::INT + (digits > 0)::INT + (colon > 0)::INT AS INTEGER) AS kinds FROM (SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(text, '{p}')) AS {n}" for n, p in FORMS.items()) + " FROM documents)) WHERE kinds >= 2")
def mixed_date_formats(t):
    return I.mixed_forms(t.documents, FORMS)


SLOP = {"emphasis": r"(?:very|really|truly|highly)", "filler": r" (?:the the|of of|and and|in in) ", "marks": r"[!?]{2,}", "symbols": r"[#%$&*]{3}", "pipes": r"\|", "caps": r"[A-Z]{4,}"}


@query("SELECT *, greatest(0, 100 - least(30, 5 * (" + " + ".join(f"(\"{n}\" > 0)::INT" for n in SLOP) + "))) AS quality FROM (SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(text, '{p}')) AS \"{n}\"" for n, p in SLOP.items()) + " FROM documents)")
def slop_scan(t):
    rows = t.documents.select("doc_id", *(F.regexp_count("text", F.lit(p)).cast("long").alias(n) for n, p in SLOP.items()))
    kinds = sum((F.col(n) > 0).cast("int") for n in SLOP)
    return rows.withColumn("quality", F.greatest(F.lit(0), 100 - F.least(F.lit(30), 5 * kinds)))


@query(r"""
WITH x AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?\n]+[.!?]*'), lambda z: trim(z, ' ')), lambda z: length(z) >= 2) AS s, text FROM documents)
SELECT doc_id, len(s) AS sentences, round(coalesce(list_avg(list_transform(s, lambda z: length(z)::DOUBLE)), 0), 6) AS mean_length, coalesce(list_max(list_transform(s, lambda z: length(z))), 0) AS longest,
  len(regexp_extract_all(text, ',')) AS commas, round(len(regexp_extract_all(text, ','))::DOUBLE / greatest(len(s), 1)::DOUBLE, 3) AS commas_per_sentence FROM x
""")
def voice_features(t):
    s = X.sentences(F.col("text"), 2)
    rows = t.documents.select("doc_id", F.transform(s, lambda z: F.length(z)).alias("s"), F.regexp_count("text", F.lit(",")).cast("long").alias("commas"))
    total = F.aggregate("s", F.lit(0).cast("long"), lambda a, z: a + z)
    n = F.size("s")
    return rows.select("doc_id", n.cast("long").alias("sentences"), F.round(F.when(n > 0, total / n).otherwise(0.0), 6).alias("mean_length"), F.coalesce(F.array_max("s"), F.lit(0)).cast("long").alias("longest"), "commas", F.round(F.col("commas") / F.greatest(n, F.lit(1)), 3).alias("commas_per_sentence"))


@query(f"""
WITH h AS ({_rules_sql('doc_id, source AS src', 'doc_id, src')}), r AS (SELECT src AS document, doc_id % 50 AS run, list_sort(list_distinct(list(rule))) AS rules, count(*) AS n FROM h GROUP BY ALL),
x AS (SELECT *, lag(rules) OVER w AS rb, lag(n) OVER w AS nb FROM r WINDOW w AS (PARTITION BY document ORDER BY run))
SELECT document, run, round(len(list_intersect(rules, rb))::DOUBLE / len(list_distinct(list_concat(rules, rb)))::DOUBLE, 4) AS jaccard, round(abs(n - nb) * 100::DOUBLE / greatest(nb, 1), 2) AS change,
  round(len(list_intersect(rules, rb))::DOUBLE / len(list_distinct(list_concat(rules, rb)))::DOUBLE, 4) >= 0.5 AND round(abs(n - nb) * 100::DOUBLE / greatest(nb, 1), 2) <= 30 AS consistent FROM x WHERE rb IS NOT NULL
""")
def consistency_vs_previous(t):
    rows = I.detect(t.documents.withColumnRenamed("source", "document"), RULES, keep=("doc_id", "document"))
    runs = rows.groupBy("document", (F.col("doc_id") % 50).alias("run")).agg(F.array_sort(F.collect_set("rule")).alias("rules"), F.count("*").alias("n"))
    return S.consistency(runs, "document", "run", "rules", "n")


FLAGGED = "stupid|idiot|moron|trash|clown|loser|scum|pathetic|worthless|disgusting"


@query("""
WITH p AS (SELECT d.doc_id, l.toxic, regexp_matches(lower(d.text), '\\b(?:FLAGGED)\\b')::INT AS flagged, d.lang FROM documents d JOIN labels l USING (doc_id))
SELECT lang, count(*) AS n, sum(CASE WHEN toxic = 1 AND flagged = 1 THEN 1 ELSE 0 END)::BIGINT AS tp, sum(CASE WHEN toxic = 0 AND flagged = 1 THEN 1 ELSE 0 END)::BIGINT AS fp, sum(CASE WHEN toxic = 1 AND flagged = 0 THEN 1 ELSE 0 END)::BIGINT AS fn,
  round(sum(CASE WHEN toxic = 1 AND flagged = 1 THEN 1 ELSE 0 END)::DOUBLE / nullif(sum(flagged), 0)::DOUBLE * 100::DOUBLE, 1) AS hit_precision,
  round(sum(CASE WHEN toxic = 1 AND flagged = 1 THEN 1 ELSE 0 END)::DOUBLE / nullif(sum(toxic), 0)::DOUBLE * 100::DOUBLE, 1) AS hit_recall FROM p GROUP BY lang
""".replace("FLAGGED", FLAGGED))
def label_evaluation(t):
    flagged = F.lower("text").rlike(rf"\b(?:{FLAGGED})\b")
    rows = t.documents.select("doc_id", "lang", flagged.alias("flagged")).join(t.labels, "doc_id")
    toxic = F.col("toxic") == 1
    out = rows.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(toxic & F.col("flagged")).alias("tp"), F.count_if(~toxic & F.col("flagged")).alias("fp"), F.count_if(toxic & ~F.col("flagged")).alias("fn"))
    return out.withColumns({"hit_precision": S.rate(F.col("tp"), F.col("tp") + F.col("fp"), empty=None), "hit_recall": S.rate(F.col("tp"), F.col("tp") + F.col("fn"), empty=None)})


def _spans_sql() -> str:
    """Places of matches: what stands before the k-th is the parts up to it and the matches before it."""
    size = lambda xs: f"coalesce(list_sum(list_transform({xs}, lambda z: length(z))), 0)"
    one = "SELECT doc_id, '{r}' AS rule, h, string_split_regex(text, '{p}') AS parts, unnest(range(1, len(h) + 1)) AS k FROM (SELECT doc_id, text, regexp_extract_all(text, '{p}') AS h FROM documents)"
    every = " UNION ALL ".join(one.format(r=r.rule, p=r.pattern) for r in RULES)
    return f"SELECT doc_id, rule, CAST(start AS INTEGER) AS start, CAST(start + length(x) AS INTEGER) AS \"end\", x AS original_text FROM (SELECT doc_id, rule, h[k] AS x, {size('parts[1:k]')} + {size('h[1:k - 1]')} AS start FROM ({every}))"


@query(_spans_sql())
def rule_spans(t):
    return I.detect_spans(t.documents, RULES)
