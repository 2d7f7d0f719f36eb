"""Queries over the event log, conversations and the order tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from lexmill.operators import relational as R
from lexmill.operators import stats as S
from lexmill.plans.registry import query

HIT = "value >= 50"
TYPES = ("click", "error", "purchase", "signup", "view")
AS_OF = dt.date(2024, 1, 25)


def _day(c: str = "day"):
    return F.date_format(c, "yyyy-MM-dd").alias("day")


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(DISTINCT user_id) AS active FROM events GROUP BY 1")
def active_users_daily(t):
    return S.daily_distinct(t.events, "ts", "user_id").select(_day(), "active")


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, count(*) FILTER (value >= 50) AS hits, round(count(*) FILTER (value >= 50)::DOUBLE / count(*)::DOUBLE * 100::DOUBLE, 1) AS hit_rate FROM events GROUP BY 1")
def hit_rate_daily(t):
    return S.daily_rate(t.events, "ts", F.expr(HIT)).select(_day(), "n", "hits", "hit_rate")


@query("""
WITH f AS (SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, count(*) FILTER (props LIKE '%9%') AS hits FROM events GROUP BY ALL)
SELECT d.day, k.event_type, coalesce(n, 0) AS n, coalesce(hits, 0) AS hits, coalesce(round(hits::DOUBLE / n::DOUBLE * 100::DOUBLE, 1), 0::DOUBLE) AS hit_rate
FROM (SELECT DISTINCT day FROM f) d CROSS JOIN (SELECT DISTINCT event_type FROM f) k LEFT JOIN f ON f.day = d.day AND f.event_type = k.event_type
""")
def hit_rate_by_type_daily(t):
    found = S.daily_rate(t.events, "ts", F.col("props").contains("9"), by=["event_type"]).withColumn("day", F.date_format("day", "yyyy-MM-dd"))
    return S.with_spine(found, ["day"], ["event_type"], {"n": 0, "hits": 0, "hit_rate": 0.0})


def _period_sql() -> str:
    ranges = ", ".join("('{}', '{}', DATE '{}', DATE '{}')".format(p, w, a, b) for p in S.PERIODS for w, (a, b) in zip(("now", "before"), (S.period_bounds(p, AS_OF)[:2], S.period_bounds(p, AS_OF)[2:]), strict=True))
    return f"""
WITH r AS (SELECT * FROM (VALUES {ranges}) v(period, part, a, b)),
x AS (SELECT period, part, user_id, value >= 50 AS hit FROM events JOIN r ON ts >= a AND ts < b),
g AS (SELECT period, count(*) FILTER (part = 'now') AS n_now, count(*) FILTER (part = 'before') AS n_before,
  count(DISTINCT user_id) FILTER (part = 'now') AS users_now, count(DISTINCT user_id) FILTER (part = 'before') AS users_before,
  coalesce(round(count(*) FILTER (part = 'now' AND hit)::DOUBLE / nullif(count(*) FILTER (part = 'now'), 0)::DOUBLE * 100::DOUBLE, 1), 0) AS rate_now,
  coalesce(round(count(*) FILTER (part = 'before' AND hit)::DOUBLE / nullif(count(*) FILTER (part = 'before'), 0)::DOUBLE * 100::DOUBLE, 1), 0) AS rate_before
  FROM x GROUP BY period)
SELECT *, n_now - n_before AS n_trend, users_now - users_before AS users_trend, round(rate_now - rate_before, 1) AS rate_trend FROM g
"""


@query(_period_sql())
def period_over_period(t):
    return S.period_over_period(t.events, "ts", "user_id", F.expr(HIT), AS_OF)


@query("""
SELECT conv_id, turn, min(b.turn) AS next_turn, arg_min(length(b.text), b.turn) AS next_length
FROM (SELECT conv_id, turn FROM conversations WHERE role = 'user') u LEFT JOIN LATERAL (SELECT c.turn, c.text FROM conversations c WHERE c.conv_id = u.conv_id AND c.turn > u.turn AND c.role = 'assistant') b ON true
GROUP BY u.conv_id, u.turn
""".replace("SELECT conv_id, turn, min", "SELECT u.conv_id, u.turn, min"))
def next_reply_asof(t):
    rows = t.conversations.select("conv_id", "turn", "role", F.length("text").alias("length"))
    return R.next_event(rows, "conv_id", "turn", "role", "user", "assistant", ["turn", "length"]).select("conv_id", "turn", "next_turn", F.col("next_length").cast("long").alias("next_length"))


@query("""
WITH m AS (SELECT conv_id, turn, role FROM conversations WHERE contains(lower(text), 'tion') AND role = 'user')
SELECT *, (SELECT count(*) FROM m) AS total FROM (SELECT * FROM m ORDER BY conv_id DESC, turn LIMIT 20 OFFSET 20)
""")
def conversation_search_paged(t):
    rows = R.filtered(t.conversations.where(R.any_contains("TION", "text")), role="user").select("conv_id", "turn", "role")
    return R.page(rows, [F.desc("conv_id"), "turn"], number=2, size=20)


@query("""
SELECT c_custkey, c_name, o_orderkey, l_linenumber, p_name FROM customer
LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey
WHERE contains(lower(c_mktsegment), 'mach') AND (contains(lower(p_name), 'ring') OR contains(lower(o_orderpriority), 'urgent'))
""")
def left_chain_search(t):
    customers = t.customer.where(R.any_contains("mach", "c_mktsegment"))
    rows = (
        customers.join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left")
        .join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"), "left")
        .join(t.part, F.col("p_partkey") == F.col("l_partkey"), "left")
    )
    return rows.where(R.any_contains("ring", "p_name") | R.any_contains("urgent", "o_orderpriority")).select("c_custkey", "c_name", "o_orderkey", "l_linenumber", "p_name")


@query("SELECT d.doc_id, d.source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti_join_unseen(t):
    return R.unseen(t.documents.select("doc_id", "source"), t.labels, ["doc_id"])


@query("SELECT DISTINCT c_custkey, c_mktsegment FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_orderdate >= DATE '1997-01-01' AND o_orderdate < DATE '1998-01-01')")
def semi_join_active(t):
    placed = R.within_days(R.filtered(t.orders, o_orderstatus="F"), "o_orderdate", "1997-01-01", "1997-12-31")
    return t.customer.join(placed, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey", "c_mktsegment").distinct()


@query("""
WITH q AS (SELECT l_suppkey % 2 AS side, l_returnflag || '-part-' || l_partkey AS name, CAST(sum(l_quantity) AS BIGINT) AS value FROM lineitem GROUP BY ALL),
a AS (SELECT name, value FROM q WHERE side = 0), b AS (SELECT name, value FROM q WHERE side = 1)
SELECT coalesce(a.name, b.name) AS name, a.value AS value_a, b.value AS value_b,
  CASE WHEN a.name IS NULL THEN 'only_b' WHEN b.name IS NULL THEN 'only_a' WHEN a.value = b.value THEN 'same' ELSE 'different' END AS status
FROM a FULL JOIN b ON a.name = b.name
""")
def param_full_outer_exact(t):
    rows = t.lineitem.groupBy((F.col("l_suppkey") % 2).alias("side"), F.concat("l_returnflag", F.lit("-part-"), "l_partkey").alias("name")).agg(F.sum("l_quantity").cast("long").alias("value"))
    return R.compare_by_key(rows.where("side = 0").select("name", "value"), rows.where("side = 1").select("name", "value"), ["name"], "value")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value, max((ts, event_id))[2] AS event_id FROM events GROUP BY user_id".replace("max((ts, event_id))[2]", "arg_max(event_id, (ts, event_id))"))
def latest_per_key(t):
    return S.latest_per_key(t.events, "user_id", ["ts", "event_id"], ["event_id", "event_type", "value"])


@query("""
SELECT event_type AS category, count(*) AS submissions,
  round(avg(least(100::DOUBLE, value * 100::DOUBLE / greatest(CAST(json_extract_string(props, '$.k') AS INTEGER), 1))), 2) AS mean_accuracy
FROM events GROUP BY 1
""")
def feedback_clamped_mean(t):
    rows = t.events.withColumn("k", F.get_json_object("props", "$.k").cast("int")).withColumnRenamed("event_type", "category")
    return S.clamped_mean(rows, "category", "value", "k")


@query(f"""
SELECT strftime(ts, '%Y-%m-%d') AS day, {', '.join(f"count(*) FILTER (event_type = '{x}') AS \"{x}\"" for x in TYPES)}
FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 14
""")
def category_trend_pivot(t):
    return S.trend_pivot(t.events, "ts", "event_type", TYPES, days=14).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("SELECT event_type, count(*) AS n, round(count(*)::DOUBLE / (sum(count(*)) OVER ())::DOUBLE * 100::DOUBLE, 1) AS share FROM events GROUP BY 1")
def category_pie(t):
    return S.share_of_total(t.events, "event_type")


@query("""
WITH f AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, source) AS rank FROM f),
g AS (SELECT CASE WHEN rank <= 5 THEN source ELSE 'other' END AS source, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1)
SELECT source, n, round(n::DOUBLE / (sum(n) OVER ())::DOUBLE * 100::DOUBLE, 1) AS share FROM g
""")
def top_sources_and_other(t):
    return S.top_and_other(t.documents, "source", 5)


@query("""
SELECT event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) // 10 AS bucket, count(*) AS n, round(sum(value), 2) AS total, max(value) AS most
FROM events GROUP BY ALL
""")
def json_props_rollup(t):
    bucket = F.floor(F.from_json("props", "k int")["k"] / 10).cast("int")
    return t.events.groupBy("event_type", bucket.alias("bucket")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"), F.max("value").alias("most"))


@query("""
SELECT CASE WHEN grouping(event_type) = 1 AND grouping(provider) = 1 THEN 'total' WHEN grouping(provider) = 1 THEN 'request' ELSE 'provider' END AS kind,
  coalesce(event_type, provider, 'all') AS name, count(*) AS calls, round(sum(value), 2) AS tokens
FROM (SELECT event_type, value, 'p' || (user_id % 4) AS provider FROM events) GROUP BY GROUPING SETS ((), (event_type), (provider))
""")
def usage_by_request_provider(t):
    rows = t.events.select("event_type", "value", F.concat(F.lit("p"), F.col("user_id") % 4).alias("provider"))
    return S.usage_rollup(rows, "event_type", "provider", "value")


@query("""
SELECT source, count(*) AS n, count(*) FILTER (action = 'accepted') AS accepted, count(*) FILTER (action = 'rejected') AS rejected,
  count(*) FILTER (action = 'modified') AS modified, count(*) FILTER (action = 'pending') AS pending,
  round(count(*) FILTER (action = 'accepted')::DOUBLE / nullif(count(*) FILTER (action <> 'pending'), 0)::DOUBLE * 100::DOUBLE, 1) AS accept_rate,
  round(count(*) FILTER (action = 'rejected')::DOUBLE / nullif(count(*) FILTER (action <> 'pending'), 0)::DOUBLE * 100::DOUBLE, 1) AS reject_rate,
  round(count(*) FILTER (action = 'pending')::DOUBLE / count(*)::DOUBLE * 100::DOUBLE, 1) AS pending_rate
FROM (SELECT d.source, CASE WHEN l.doc_id IS NULL THEN 'pending' WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 THEN 'accepted' ELSE 'modified' END AS action
      FROM documents d LEFT JOIN labels l USING (doc_id)) GROUP BY source
""")
def decision_accuracy(t):
    action = F.when(F.col("toxic").isNull(), "pending").when(F.col("toxic") == 1, "rejected").when(F.col("quality") == 1, "accepted").otherwise("modified")
    rows = t.documents.select("doc_id", "source").join(t.labels, "doc_id", "left").withColumn("action", action)
    return S.decision_accuracy(rows, "source", "action")


@query("""
WITH RECURSIVE nodes AS (
  SELECT 'all' AS node, NULL AS parent UNION ALL SELECT 'r' || r_regionkey, 'all' FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier),
tree AS (SELECT node, 0 AS depth, node AS path FROM nodes WHERE parent IS NULL
  UNION ALL SELECT n.node, depth + 1, path || '/' || n.node FROM tree t JOIN nodes n ON n.parent = t.node)
SELECT node, depth, path FROM tree
""")
def folder_tree_recursive(t):
    c = lambda p, k: F.concat(F.lit(p), k)
    root = t.region.agg(F.lit("all").alias("node"), F.lit(None).cast("string").alias("parent"))
    nodes = (
        root.union(t.region.select(c("r", "r_regionkey"), F.lit("all")))
        .union(t.nation.select(c("n", "n_nationkey"), c("r", "n_regionkey")))
        .union(t.supplier.select(c("s", "s_suppkey"), c("n", "s_nationkey")))
    )
    return R.subtree(nodes, F.col("parent").isNull())


@query("""
WITH x AS (SELECT *, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
y AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS run FROM x)
SELECT user_id, run, event_type, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last FROM y GROUP BY ALL
""")
def adjacent_merge_islands(t):
    found = R.islands(t.events, "user_id", ["ts", "event_id"], "event_type")
    return found.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("first", "last")})


@query("""
SELECT conv_id, turn, used FROM (SELECT conv_id, turn, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM conversations) WHERE used <= 1500
""")
def budget_prefix_pack(t):
    rows = t.conversations.select("conv_id", "turn", F.length("text").alias("size"))
    return R.within_budget(rows, "conv_id", ["turn"], "size", 1500).select("conv_id", "turn", "used")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def first_n_per_key(t):
    return R.first_n_per_key(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 3)


@query("""
SELECT m.conv_id, coalesce(m.n, 0) AS n_turns, coalesce(d.source, 'unknown') AS source FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1) m LEFT JOIN documents d ON d.doc_id = m.conv_id * 7
""")
def dictionary_lookup(t):
    turns = t.conversations.groupBy("conv_id").agg(F.count("*").alias("n_turns")).withColumn("owner", F.col("conv_id") * 7)
    return R.lookup(turns, t.documents, "owner", "doc_id", "source", "unknown").drop("owner")


@query("SELECT DISTINCT lang, source FROM documents WHERE lang IS NOT NULL AND source <> '' ORDER BY 1, 2")
def distinct_banks(t):
    return t.documents.where("lang is not null and source <> ''").select("lang", "source").distinct().orderBy("lang", "source")


@query("SELECT printf('R%03d', coalesce(max(CAST(substr(rule_no, 2) AS INTEGER)), 0) + 1) AS next_key FROM (SELECT printf('R%03d', n_nationkey) AS rule_no FROM nation)")
def next_rule_number(t):
    return S.next_key(t.nation.select(F.format_string("R%03d", "n_nationkey").alias("rule_no")), "rule_no")


@query("""
SELECT count(*) AS n, count(DISTINCT user_id) AS users, coalesce(round(sum(value), 2), 0) AS total,
  count(*) FILTER (event_type = 'purchase') AS purchases, coalesce(round(sum(value) FILTER (event_type = 'purchase'), 2), 0) AS spent,
  arg_max(event_type, (ts, event_id)) AS latest_type, arg_max(event_id, (ts, event_id)) FILTER (event_type = 'purchase') AS latest_purchase
FROM events
""")
def composite_stats(t):
    last = F.max_by("event_type", F.struct("ts", "event_id")).alias("latest_type")
    bought = F.max_by("event_id", F.when(F.col("event_type") == "purchase", F.struct("ts", "event_id"))).alias("latest_purchase")
    spent = F.sum(F.when(F.col("event_type") == "purchase", F.col("value")))
    return t.events.agg(
        F.count("*").alias("n"),
        F.countDistinct("user_id").alias("users"),
        F.coalesce(F.round(F.sum("value"), 2), F.lit(0.0)).alias("total"),
        F.count_if(F.col("event_type") == "purchase").alias("purchases"),
        F.coalesce(F.round(spent, 2), F.lit(0.0)).alias("spent"),
        last,
        bought,
    )


_SIDE = "SELECT lower(o_orderpriority) AS rule, lower(o_orderstatus) AS category, 'c' || (o_custkey % {a}) AS chapter, 'o' || (o_orderkey % {b}) AS original_text, 's' || (o_orderkey % 2) AS suggestion, CAST(o_orderkey % {n} AS INTEGER) AS confidence, '{m}' AS m FROM orders"


@query(f"""
SELECT rule, category, chapter, original_text, suggestion, CASE WHEN bool_or(m = 'a') AND bool_or(m = 'b') THEN 'a,b' WHEN bool_or(m = 'a') THEN 'a' ELSE 'b' END AS models, max(confidence) AS best,
  least(99, max(confidence) + 8 * (count(DISTINCT m) - 1)) AS consensus
FROM ({_SIDE.format(a=7, b=11, n=100, m='a')} UNION ALL {_SIDE.format(a=5, b=13, n=97, m='b')}) GROUP BY ALL
""")
def merge_two_models(t):
    def side(a, b, n, m):
        c = lambda p, k, size: F.concat(F.lit(p), (F.col(k) % size).cast("string"))
        return t.orders.select(F.col("o_orderpriority").alias("rule"), F.col("o_orderstatus").alias("category"), c("C", "o_custkey", a).alias("chapter"), c("o", "o_orderkey", b).alias("original_text"), c("S", "o_orderkey", 2).alias("suggestion"), (F.col("o_orderkey") % n).cast("int").alias("confidence"), F.lit(m).alias("model"))

    merged = R.merge_by_key(side(7, 11, 100, "a"), side(5, 13, 97, "b"), ["rule", "category", "chapter", "original_text", "suggestion"], "confidence")
    return merged.withColumn("models", F.array_join("models", ","))
