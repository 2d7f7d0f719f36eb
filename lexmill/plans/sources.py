"""Queries of readers, sinks, batch forms of the streaming operators, and provider fallbacks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.operators import providers as V
from lexmill.plans.registry import query
from lexmill.sources import readers, sinks
from lexmill.streaming import logs


@query("SELECT doc_id, CASE WHEN regexp_matches(source, '[05]$') THEN 'pdf' WHEN regexp_matches(source, '[16]$') THEN 'dita' WHEN regexp_matches(source, '[27]$') THEN 'xlsx' WHEN regexp_matches(source, '[38]$') THEN NULL ELSE 'md' END AS type FROM documents")
def file_type_label(t):
    exts = F.array(*(F.lit(x) for x in ("PDF", "zip", "xls", "unknown", "markdown")))
    path = F.concat(F.lit("/data/"), "source", F.lit("."), F.element_at(exts, (F.substring("source", -1, 1).cast("int") % 5 + 1)))
    return t.documents.select("doc_id", readers.file_type(path).alias("type"))


@query()
def html_title_text(t):
    return readers.html_pages(t.pages)


@query("""
WITH inc AS (SELECT doc_id, lang, source FROM documents), st AS (SELECT doc_id + 100 AS doc_id, lang, CASE WHEN n_chars > 900 THEN source ELSE 'old' END AS source FROM documents)
SELECT inc.doc_id, CASE WHEN st.doc_id IS NULL THEN 'created' WHEN st.source = inc.source AND st.lang = inc.lang THEN 'skipped' ELSE 'updated' END AS action FROM inc LEFT JOIN st USING (doc_id)
""")
def rule_import_counts(t):
    rows = t.documents.select("doc_id", "lang", "source")
    stored = t.documents.select((F.col("doc_id") + 100).alias("doc_id"), "lang", F.when(F.col("n_chars") > 900, F.col("source")).otherwise("old").alias("source"))
    return sinks.import_plan(stored, rows, "doc_id", ["lang", "source"])


@query("SELECT DISTINCT user_id, event_type FROM events e WHERE ts >= TIMESTAMP '2024-01-05' AND NOT EXISTS (SELECT 1 FROM events s WHERE s.ts < TIMESTAMP '2024-01-05' AND s.user_id = e.user_id AND s.event_type = e.event_type)")
def trace_sync_new_rows(t):
    rows, stored = t.events.where("ts >= '2024-01-05'").select("user_id", "event_type"), t.events.where("ts < '2024-01-05'")
    return sinks.new_rows(rows, stored, ["user_id", "event_type"])


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS calls, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def windowed_usage(t):
    return logs.windowed_usage(t.events, "ts", "event_type", "value").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "calls", F.round("total", 2).alias("total"))


@query("""
WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 360 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
y AS (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM x)
SELECT user_id, n, count(*) AS sessions FROM (SELECT user_id, s, count(*) AS n FROM y GROUP BY ALL) GROUP BY ALL
""")
def event_sessions(t):
    return logs.sessions(t.events, "ts", "user_id", "360 minutes").groupBy("user_id", "n").agg(F.count("*").alias("sessions"))


@query(r"SELECT conv_id, turn, trim(split_part(regexp_extract(trim(text), '[^\n]*$'), '.', 1)) AS answer, 'fallback' AS provider FROM conversations WHERE role = 'user'")
def provider_fallback(t):
    rows = t.conversations.where("role = 'user'").select("conv_id", "turn", "text")
    return V.answered(rows, F.col("text")).drop("text")
