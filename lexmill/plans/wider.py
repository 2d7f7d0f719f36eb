"""Queries of rules that look at more than one place, template guards, memories end to end, packages and small functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexmill.functions import text as X
from lexmill.operators import cat as K
from lexmill.operators import compare as C
from lexmill.operators import grammar as N
from lexmill.operators import graph, proofing, relational
from lexmill.operators import issues as I
from lexmill.operators import matching as M
from lexmill.operators import memory as T
from lexmill.operators import retrieval as Q
from lexmill.operators import segments as G
from lexmill.operators import stats as S
from lexmill.plans.comparison import _SENT
from lexmill.plans.findings import RULES, SCORING, _rules_sql
from lexmill.plans.findings import _SCORE as SCORE
from lexmill.plans.registry import BEGIN, NTH, ascii_words, query
from lexmill.sources import readers, sinks
from lexmill.streaming import logs

MIXED = {"end": (r"\bthe\b", r"\bThe\b"), "joined": (r"\band\b", r"\bund\b", r"\by\b"), "sum": ("[0-9],[0-9]", "[0-9][.][0-9]")}


@query("SELECT doc_id, name, unnest(f).form AS form, unnest(f).n AS n FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{name}' AS name, list_filter([{', '.join('{{form: {0}, n: len(regexp_extract_all({1}, {0}))}}'.format(chr(39) + p + chr(39), ascii_words('text')) for p in forms)}], lambda z: z.n > 0) AS f FROM documents" for name, forms in MIXED.items()) + ") WHERE len(f) >= 2")
def mixed_terms(t):
    return N.mixed_terms(t.documents, MIXED)


_NUMBERED = "replace(replace(text, '. ', ' 1. (2) '), '!', ' 3)')"


@query(rf"""
WITH l AS (SELECT doc_id, unnest(x) AS line, CAST(unnest(range(1, len(x) + 1)) AS INTEGER) AS line_number FROM (SELECT doc_id, string_split({_NUMBERED}, chr(10)) AS x FROM documents)),
c AS (SELECT doc_id, line_number, list_filter([{{style: 'dot', n: len(regexp_extract_all(line, '\b\d+\.(?:\s|$)'))}}, {{style: 'bracket', n: len(regexp_extract_all(line, '\b\d+\)'))}}, {{style: 'brackets', n: len(regexp_extract_all(line, '\(\d+\)'))}}], lambda z: z.n > 0) AS f FROM l)
SELECT doc_id, line_number, unnest(f).style AS style, unnest(f).n AS n FROM c WHERE len(f) >= 2
""")
def mixed_numbering(t):
    body = F.replace(F.replace(F.col("text"), F.lit(". "), F.lit(" 1. (2) ")), F.lit("!"), F.lit(" 3)"))
    return N.mixed_numbering(t.documents.withColumn("text", body))


WORDS = N.Agreement(singular=("he", "she", "it", "this", "thon"), singular_verbs=("is", "was", "has", "does", "the"), plural_verbs=("are", "were", "have", "and", "la"))


def _any(xs) -> str:
    return ", ".join(f"'{x}'" for x in xs)


_PAIRS = {
    "there": (r"(?:^|[^\p{L}])there\s+(is|was|the|are|were|and|la)\s+(?:(?:" + "|".join(WORDS.no_subjects) + r")\s+)*(\p{L}+)", 2, 1),
    "subject": (r"(\p{L}+)\s+(is|was|has|does|the|are|were|have|and|la)(?:[^\p{L}]|$)", 1, 2),
    "person": (r"(?:^|[^\p{L}])(he|she)\s+(\p{L}+)", 1, 2),
}


@query("WITH p AS (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, unnest(regexp_extract_all(text, '{p}', {s})) AS subject, unnest(regexp_extract_all(text, '{p}', {v})) AS verb FROM (SELECT doc_id, lower(text) AS text FROM documents)" for k, (p, s, v) in _PAIRS.items()) + f""")
SELECT * FROM p WHERE CASE WHEN kind = 'person' THEN verb NOT IN ({_any(WORDS.auxiliaries + WORDS.no_subjects)}) AND NOT ends_with(verb, 's')
  ELSE (CASE WHEN subject IN ({_any(WORDS.singular)}) THEN true WHEN subject IN ({_any(WORDS.plural)}) THEN false ELSE NOT ends_with(subject, 's') END) <> (verb IN ({_any(WORDS.singular_verbs)})) AND subject NOT IN ({_any(WORDS.no_subjects)}) END
""")
def agreement_issues(t):
    """Words of the invented languages stand for verbs, so that the rules meet something."""
    return N.disagreements(t.documents, WORDS)


@query(r"""
WITH d AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS word FROM benchmark),
p AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?:^|[^\p{L}])([A-Za-z]{2,12}) ([a-z]{1,2})(?:[^\p{L}]|$)', 1)) AS a, unnest(regexp_extract_all(text, '(?:^|[^\p{L}])([A-Za-z]{2,12}) ([a-z]{1,2})(?:[^\p{L}]|$)', 2)) AS b FROM documents
  UNION ALL SELECT doc_id, unnest(regexp_extract_all(text, '(?:^|[^\p{L}])([a-z]) ([a-z]{2,12})(?:[^\p{L}]|$)', 1)), unnest(regexp_extract_all(text, '(?:^|[^\p{L}])([a-z]) ([a-z]{2,12})(?:[^\p{L}]|$)', 2)) FROM documents)
SELECT doc_id, a || ' ' || b AS original, a || b AS joined, count(*) AS n FROM p WHERE length(a || b) >= 4 AND lower(a || b) IN (SELECT word FROM d) AND NOT (lower(a) IN (SELECT word FROM d) AND lower(b) IN (SELECT word FROM d)) GROUP BY ALL
""")
def split_words(t):
    words = t.benchmark.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), 0)).alias("word"))
    return N.split_words(t.documents, words)


@query(r"""
WITH l AS (SELECT doc_id, trim(unnest(x), ' ') AS line, CAST(unnest(range(1, len(x) + 1)) AS INTEGER) AS line_number FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
k AS (SELECT doc_id, line_number, unnest([{kind: 'imperative', original: regexp_extract(line, '(?i)\bthe\s+(?:and|in|that)\b')}, {kind: 'conditional', original: regexp_extract(line, '(?i)^(?:in|the|on|and)\s[^,，.;]{10,}[.;]?$')},
  {kind: 'open_end', original: CASE WHEN len(regexp_extract_all(line, '\S+')) >= 6 AND NOT regexp_matches(line, '[.!?:;。！？：；]$') THEN line ELSE '' END}]) AS x FROM l)
SELECT doc_id, line_number, x.kind AS kind, x.original AS original FROM k WHERE x.original <> ''
""")
def line_findings(t):
    return N.line_findings(t.documents, "the", ("and", "in", "that"), ("in", "the", "on", "and"))


_NOUN = "[A-Z][a-z]{2,}"


@query(rf"""
WITH p AS (SELECT doc_id, string_split_regex(text, '{_NOUN}') AS parts, regexp_extract_all(text, '{_NOUN}') AS words FROM documents)
SELECT doc_id, len(words) AS protected, md5(array_to_string(list_transform(list_zip(parts, words), lambda z: translate(coalesce(z[1], ''), 'e', 'E') || coalesce(z[2], '')), '')) AS restored_md5,
  CASE WHEN len(words) > 1 THEN 'rejected' ELSE 'kept' END AS reordered FROM p
""")
def protect_restore(t):
    """The rest of a text rewritten, its names as they were; marks out of order are told."""
    rows = t.documents.select("doc_id", N.protected(F.col("text"), _NOUN).alias("p"))
    swapped = F.regexp_replace("p.masked", "⟦0⟧", "⟦1⟧")
    back = N.restored(F.translate("p.masked", "e", "E"), F.col("p.words"))
    return rows.select("doc_id", F.size("p.words").cast("long").alias("protected"), F.md5(back).alias("restored_md5"), F.when(N.restored(swapped, F.col("p.words")).isNull() & (F.size("p.words") > 1), "rejected").otherwise("kept").alias("reordered"))


@query()
def sentence_windows(t):
    return N.sentence_windows(t.documents, r"(?i)^(?:in|the|on|and|la|der)\b")


@query("""
WITH r AS (SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders)
SELECT 'k' || (o_custkey - o_custkey % 4) AS record, max(o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM (SELECT o_orderkey, o_totalprice, o_custkey FROM r) GROUP BY o_custkey - o_custkey % 4
""")
def alias_latest(t):
    """An order has two names, its customer's and its customer's pair's; pairs of pairs share a third."""
    c = F.col("o_custkey")
    name = lambda n: F.concat(F.lit("k"), n.cast("string"))
    customers = t.orders.select("o_custkey").distinct()
    names = customers.select(c.alias("a"), (c - c % 2).alias("b")).union(customers.select(c - c % 2, c - c % 4))
    roots = graph.components(names).select(name(F.col("node")).alias("node"), name(F.col("root")).alias("root"))
    rows = t.orders.select(name(c).alias("alias"), "o_orderkey", "o_totalprice")
    return N.latest_of_aliases(rows, roots, "alias", ["o_orderkey"], ["o_orderkey", "o_totalprice"])


_PAIR = "SELECT conv_id, turn, text AS a, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations"
_L = "regexp_replace({}, '[^\\p{{L}}\\p{{N}}]+', '', 'g')"
LABELS = {"number": r"\d+", "end": r"tion\b"}
GROUPS = {"one": ("any", ("the", "der")), "two": ("none", ("ing", "ich")), "three": ("half", ("and", "est", "que", "ent")), "four": ("most", ("on", "er", "an", "in", "ou"))}


def _entities_sql(a: str, b: str) -> str:
    found = lambda c, p: f"list_distinct(regexp_extract_all({ascii_words(f'lower({c})')}, '{p}'))"
    return "(" + " AND ".join(f"(len({found(a, p)}) = 0 OR len(list_intersect({found(a, p)}, {found(b, p)})) > 0)" for p in LABELS.values()) + ")"


def _anchors_sql(a: str, b: str) -> str:
    out = []
    for rule, ps in GROUPS.values():
        has = lambda c, ps=ps: "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower({c}), '{p}') THEN {k} END" for k, p in enumerate(ps)) + "], lambda z: z IS NOT NULL)"
        x, y = has(a), has(b)
        share = f"len(list_intersect({x}, {y}))::DOUBLE / greatest(len({x}), len({y}), 1)"
        clash = {"any": "true", "none": f"{share} = 0", "half": f"{share} < 0.5", "most": f"({share} = 0 OR len({x}) >= 2 AND len({y}) >= 2 AND {share} < 0.75)"}[rule]
        out.append(f"NOT (len({x}) > 0 AND len({y}) > 0 AND len(list_filter({x}, lambda z: NOT list_contains({y}, z))) > 0 AND len(list_filter({y}, lambda z: NOT list_contains({x}, z))) > 0 AND {clash})")
    return "(" + " AND ".join(out) + ")"


def _turns(t):
    b = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return t.conversations.select("conv_id", "turn", F.col("text").alias("a"), b.alias("b")).where("b is not null")


@query(rf"""
WITH p AS ({_PAIR}), q AS (SELECT *, {_L.format('a')} AS la, {_L.format('b')} AS lb FROM p WHERE b IS NOT NULL)
SELECT conv_id, turn, regexp_matches(trim(b, ' '), '{BEGIN}[A-Z]\d+\s*(?:=|->)\s*\w+') OR length(lb) >= 15 AND (regexp_matches(trim(b, ' '), '[.!?;。！？；]$') OR regexp_matches(trim(b, ' '), '[:：]') AND regexp_matches(trim(b, ' '), '@[A-Za-z0-9.-]+')) AS valid,
  la = '' OR lb = '' OR length(lb)::DOUBLE / greatest(length(la), 1) < 0.65 OR length(lb)::DOUBLE / greatest(length(la), 1) > CASE WHEN length(la) <= 18 THEN 2.35 WHEN length(la) <= 26 THEN 1.9 ELSE 1.55 END
    OR length(lb)::DOUBLE / greatest(length(la), 1) < 0.78 AND (contains(la, lb) OR contains(lb, la)) AS fragment,
  {_entities_sql('a', 'b')} AS entities, {_anchors_sql('a', 'b')} AS anchors FROM q
""")
def cat_guards(t):
    a, b = F.col("a"), F.col("b")
    return _turns(t).select("conv_id", "turn", K.valid_template(b).alias("valid"), K.fragment(a, b).alias("fragment"), K.entities_agree(a, b, LABELS).alias("entities"), K.anchors_agree(a, b, GROUPS).alias("anchors"))


@query("""
WITH s AS (SELECT l_orderkey, l_linenumber, l_discount * 10 AS string, CASE WHEN l_linenumber % 3 = 0 THEN l_tax * 12 END AS semantic, l_tax * 3 AS penalty, l_returnflag = 'R' AS negative, CAST(l_quantity AS INTEGER) % 5 AS terms, l_discount * 7 AS overlap, l_linestatus, l_shipdate FROM lineitem),
f AS (SELECT *, greatest(0::DOUBLE, coalesce(semantic, string) - CASE WHEN negative THEN 0.22::DOUBLE ELSE 0 END) AS g FROM s),
h AS (SELECT *, round(greatest(0::DOUBLE, g - CASE WHEN terms >= 2 AND overlap < 0.35 THEN 0.12::DOUBLE WHEN terms >= 2 AND overlap < 0.6 THEN 0.05::DOUBLE ELSE 0 END), 4) AS filtered FROM f),
k AS (SELECT *, CASE WHEN terms = 4 THEN 'keep' WHEN terms = 3 AND negative THEN 'drop' WHEN filtered >= 0.5 AND filtered < 0.54 AND (penalty >= 0.18 OR l_linestatus = 'F') OR filtered < 0.5 THEN 'drop' WHEN filtered < 0.65 THEN 'needs_review' ELSE 'keep' END AS state FROM h)
SELECT l_orderkey, l_linenumber, filtered, state, state <> 'drop' OR string >= 0.38 AND filtered >= 0.38 AND overlap >= 0.2 AS by_hand FROM k
""".replace("0.35 ", "0.35::DOUBLE ").replace("0.6 ", "0.6::DOUBLE ").replace("0.54 ", "0.54::DOUBLE ").replace("0.18 ", "0.18::DOUBLE ").replace("0.65 ", "0.65::DOUBLE ").replace("0.38 ", "0.38::DOUBLE ").replace("0.2 ", "0.2::DOUBLE "))
def cat_keep_states(t):
    """Order lines stand for candidates: their numbers for scores, penalties and overlaps."""
    rows = t.lineitem.select("l_orderkey", "l_linenumber", (F.col("l_discount") * 10).alias("string"), F.when(F.col("l_linenumber") % 3 == 0, F.col("l_tax") * 12).alias("semantic"), (F.col("l_tax") * 3).alias("penalty"), (F.col("l_returnflag") == "R").alias("negative"), (F.col("l_quantity").cast("int") % 5).alias("terms"), (F.col("l_discount") * 7).alias("overlap"), "l_linestatus")
    c = F.col
    rows = rows.withColumn("filtered", K.filtered_score(c("semantic"), c("string"), c("negative"), c("terms"), c("overlap"), model=False))
    state = K.keep_state(c("filtered"), c("penalty"), c("terms") == 4, F.when((c("terms") == 3) & c("negative"), "exact_duplicate"), c("l_linestatus") == "F", model=False)
    rows = rows.withColumn("state", state)
    same = F.lit("a text")
    return rows.select("l_orderkey", "l_linenumber", "filtered", "state", K.manual_fallback(c("state"), c("string"), c("filtered"), c("overlap"), same, same).alias("by_hand"))


@query("""
SELECT l_orderkey, l_linenumber, round((CASE WHEN l_quantity > 10 THEN l_discount * 10 * 0.15::DOUBLE ELSE 0 END + CASE WHEN l_quantity > 20 THEN l_tax * 10 * 0.3::DOUBLE ELSE 0 END + CASE WHEN l_returnflag <> 'N' THEN l_discount * 10 * 0.3::DOUBLE ELSE 0 END
  + CASE WHEN l_linenumber > 2 THEN l_tax * 10 * 0.2::DOUBLE ELSE 0 END + CASE WHEN l_linestatus = 'F' THEN l_discount * 10 * 0.05::DOUBLE ELSE 0 END)
  / greatest(0.5::DOUBLE, CASE WHEN l_quantity > 10 THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN l_quantity > 20 THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN l_returnflag <> 'N' THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN l_linenumber > 2 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN l_linestatus = 'F' THEN 0.05::DOUBLE ELSE 0 END), 6) AS total FROM lineitem
""")
def segment_totals(t):
    d, x = F.col("l_discount") * 10, F.col("l_tax") * 10
    scores = {"condition": d, "action": x, "object": d, "result": x, "additional": d}
    on = {"condition": F.col("l_quantity") > 10, "action": F.col("l_quantity") > 20, "object": F.col("l_returnflag") != "N", "result": F.col("l_linenumber") > 2, "additional": F.col("l_linestatus") == "F"}
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(K.segment_total(scores, on), 6).alias("total"))


_TOKS = "list_distinct(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+'))"


@query(rf"""
WITH s AS (SELECT conv_id, turn, text, {_TOKS.format('text')} AS w, list_distinct(regexp_extract_all(text, '\d+')) AS d FROM conversations), p AS (SELECT a.conv_id, a.turn, b.turn AS other, a.w AS wa, b.w AS wb, a.d AS da, b.d AS db FROM s a JOIN s b ON a.conv_id = b.conv_id AND a.turn <> b.turn),
r AS (SELECT conv_id, turn, other, round(4::DOUBLE * len(list_intersect(wa, wb)) + 2::DOUBLE * len(list_intersect(da, db)) + 8::DOUBLE * (len(list_intersect(wa, wb))::DOUBLE / nullif(len(list_distinct(list_concat(wa, wb))), 0)), 4) AS score FROM p)
SELECT conv_id, turn, other, coalesce(score, 0) AS score, row_number() OVER (PARTITION BY conv_id, turn ORDER BY coalesce(score, 0) DESC, other) AS rank FROM r QUALIFY rank <= 120
""")
def candidate_recall(t):
    """The other turns of a conversation are a turn's templates."""
    side = lambda s: t.conversations.select("conv_id", F.col("turn").alias(s), F.array_distinct(X.tokens(F.col("text"))).alias(f"w_{s}"), F.array_distinct(F.regexp_extract_all("text", F.lit(r"\d+"), 0)).alias(f"d_{s}"))
    rows = side("turn").join(side("other"), "conv_id").where("turn <> other")
    common = lambda c: F.size(F.array_intersect(f"{c}_turn", f"{c}_other"))
    score = K.recall_score({"markers": common("w"), "numbers": common("d"), "similarity": X.jaccard(F.col("w_turn"), F.col("w_other"))})
    rows = rows.select(F.struct("conv_id", "turn").alias("sentence"), "other", score.alias("score"))
    return K.recalled(rows, "sentence", "score", ["other"]).select("sentence.*", "other", "score", "rank")


@query()
def sentence_similarity(t):
    a, b = F.col("a"), F.col("b")
    rows = _turns(t).withColumns({"x": X.compact(a), "y": X.compact(b)})
    rows = rows.withColumns({"lcs": M.lcs_ratio("x", "y"), "part": M.longest_common("x", "y"), "indel": F.round(M.indel_ratio("a", "b"), 4)})
    return rows.select("conv_id", "turn", K.sentence_similarity(a, b, F.col("lcs"), F.col("part")).alias("similarity"), "indel")


_KEY = "lower(regexp_replace(regexp_replace(trim({0}, ' '), '^[(\\[]?\\d+[)\\]]?[.:、-]*\\s*', ''), '[^\\p{{L}}\\p{{N}}]+', '', 'g'))"


def _kind(c: str, key: str) -> str:
    return f"CASE WHEN length({key}) = 0 THEN 'empty' WHEN regexp_matches(trim({c}, ' '), '[\\n.!?;。！？；]') OR regexp_matches({c}, '[,:，：]') AND length({key}) >= 8 OR length({key}) >= 12 THEN 'sentence' ELSE 'term' END"


@query(rf"""
WITH s AS (SELECT conv_id, turn, unnest(x) AS a, CAST(unnest(range(0, len(x))) AS INTEGER) AS idx FROM (SELECT conv_id, turn, list_filter(list_transform(string_split_regex(text, '[,;:.!?\n]+'), lambda p: trim(p, ' ')), lambda p: length(p) >= 2) AS x FROM conversations)),
p AS (SELECT *, lead(a) OVER (PARTITION BY conv_id, turn ORDER BY idx) AS b FROM s), k AS (SELECT *, {_KEY.format('a')} AS x, {_KEY.format('b')} AS y FROM p WHERE b IS NOT NULL),
j AS (SELECT *, {_kind('a', 'x')} AS ka, {_kind('b', 'y')} AS kb, least(length(x), length(y)) AS lo, greatest(length(x), length(y)) AS hi FROM k)
SELECT conv_id, turn, idx, ka AS kind, x <> '' AND y <> '' AND (x = y OR ka = kb AND CASE WHEN ka = 'term' THEN lo::DOUBLE / greatest(hi, 1) >= 0.75 AND hi <= greatest(lo + 4, lo * 2) ELSE lo::DOUBLE / greatest(hi, 1) >= 0.65 END) AS eligible FROM j
""")
def tm_eligible(t):
    rows = G.exploded(t.conversations.withColumn("key", F.struct("conv_id", "turn", "text")), proofing.clauses(F.col("text")), "key").select("key.conv_id", "key.turn", "idx", F.col("text").alias("a"))
    rows = rows.withColumn("b", F.lead("a").over(Window.partitionBy("conv_id", "turn").orderBy("idx"))).where("b is not null")
    return rows.select("conv_id", "turn", "idx", T.kind_of(F.col("a")).alias("kind"), T.eligible(F.col("a"), F.col("b")).alias("eligible"))


@query()
def tm_ranked(t):
    """Neighbouring turns are candidates for each other."""
    rows = _turns(t).select((F.col("conv_id") * NTH + F.col("turn")).alias("query_id"), F.col("a").alias("text"), F.col("turn").cast("long").alias("entry_ord"), F.col("b").alias("source_text"), F.concat(F.lit("t:"), "b").alias("translated_text"))
    return T.ranked(rows, least=0.3)


def _bank(t):
    parts = F.transform(F.regexp_extract_all("text", F.lit(T.CLAUSE), 0), lambda p: F.regexp_replace(F.trim(p), r"[.!?;:,]$", ""))
    rows = G.exploded(t.benchmark, F.filter(parts, lambda p: F.length(p) >= 2), "item_id")
    return rows.select((F.col("item_id") * NTH + F.col("idx")).alias("entry_ord"), F.col("text").alias("source_text"), F.concat(F.lit("t:"), "text").alias("translated_text"))


TERMS = {"tion of": "ung von", "the": "der"}
_LD = "lower(regexp_replace({}, '[^\\p{{L}}\\p{{N}}]+', '', 'g'))"


def _steps(name: str, pattern: str, every: bool) -> str:
    return rf"""{name}_p AS (SELECT query_id, unnest(x) AS piece, unnest(range(0, len(x))) AS k FROM (SELECT query_id, regexp_extract_all(x, '{pattern}') AS x FROM q)),
{name}_m AS (SELECT query_id, piece, k, trim(replace(piece, chr(10), ' '), ' ') = '' AS blank, hit FROM (SELECT *, {_LD.format("regexp_replace(trim(piece, ' '), '[.!?;:,。！？；：，]$', '')")} AS key FROM {name}_p) LEFT JOIN bank USING (key)),
{name}_j AS (SELECT query_id, string_agg(CASE WHEN hit IS NOT NULL THEN regexp_extract(piece, '^\s*') || hit || regexp_extract(trim(piece, ' '), '[.!?;:,。！？；：，]$') ELSE piece END, '' ORDER BY k) AS {name} FROM {name}_m GROUP BY 1 HAVING count(hit) > 0 {"AND count(hit) = count(*) FILTER (NOT blank)" if every else ""})"""


_META = rf"trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(regexp_replace(x, '\s+', ' ', 'g'), ' ')), '[_/]+', ' ', 'g'), '{X.metadata_pattern()}', ' ', 'g'), '\s+', ' ', 'g'), ' ')"
_FORMS = (r"lower(trim(regexp_replace(x, '\s+', ' ', 'g'), ' '))", _LD.format("x"), r"array_to_string(regexp_extract_all(lower(x), '[\p{L}\p{N}]+'), ' ')", _META, _LD.format(_META), rf"array_to_string(regexp_extract_all({_META}, '[\p{{L}}\p{{N}}]+'), ' ')")


@query(rf"""
WITH q AS (SELECT conv_id * {NTH} + turn AS query_id, text AS x FROM conversations),
e AS (SELECT item_id * {NTH} + i - 1 AS entry_ord, x FROM (SELECT item_id, unnest(s) AS x, unnest(range(1, len(s) + 1)) AS i FROM (SELECT item_id, list_filter(list_transform(regexp_extract_all(text, '{T.CLAUSE}'), lambda p: regexp_replace(trim(p, ' '), '[.!?;:,]$', '')), lambda p: length(p) >= 2) AS s FROM benchmark))),
bank AS (SELECT key, arg_min('t:' || x, entry_ord) AS hit FROM (SELECT *, {_LD.format('x')} AS key FROM e) WHERE key <> '' GROUP BY 1),
qk AS ({' UNION ALL '.join(f"SELECT query_id, {i} AS tier, {k} AS key FROM q" for i, k in enumerate(_FORMS))}), mk AS ({' UNION ALL '.join(f"SELECT entry_ord, x, {i} AS tier, {k} AS key FROM e" for i, k in enumerate(_FORMS))}),
h AS (SELECT query_id, arg_min('t:' || x, (tier, entry_ord)) AS exact FROM qk JOIN mk USING (tier, key) WHERE key <> '' GROUP BY 1),
{_steps('segments', T.SEGMENT, True)},
{_steps('clauses', T.CLAUSE, False)},
g AS (SELECT query_id, x, nullif(replace(replace(x, 'tion of', 'ung von'), 'the', 'der'), x) AS glossary FROM q)
SELECT query_id, CASE WHEN exact IS NOT NULL THEN 'exact' WHEN segments IS NOT NULL THEN 'segments' WHEN clauses IS NOT NULL THEN 'clauses' WHEN glossary IS NOT NULL THEN 'glossary' ELSE 'none' END AS attempt, coalesce(exact, segments, clauses, glossary, x) AS translated
FROM g LEFT JOIN h USING (query_id) LEFT JOIN segments_j USING (query_id) LEFT JOIN clauses_j USING (query_id)
""")
def tm_translate(t):
    asked = t.conversations.select((F.col("conv_id") * NTH + F.col("turn")).alias("query_id"), "text")
    return T.translated(asked, _bank(t), TERMS)


@query()
def tm_translate_fuzzy(t):
    """Every sentence of the conversations against the sentences of the benchmark, with the fuzzy step."""
    rows = lambda d, i: G.exploded(d, X.sentences(F.col("text"), 5), i)
    asked = rows(t.conversations.withColumn("key", F.struct("conv_id", "turn")), "key").select(((F.col("key.conv_id") * 4096 + F.col("key.turn")) * 4096 + F.col("idx")).alias("query_id"), "text")
    bank = rows(t.benchmark, "item_id").select((F.col("item_id") * NTH + F.col("idx")).alias("entry_ord"), F.col("text").alias("source_text"), F.concat(F.lit("t:"), "text").alias("translated_text"))
    return T.translated(asked, bank, TERMS, fuzzy=T.nearest(asked, bank, 0.6))


@query(rf"""
WITH x AS (SELECT conv_id, turn, text AS s, CASE turn % 7 WHEN 0 THEN '' WHEN 1 THEN 'Only output this: ' || text WHEN 2 THEN repeat(text, 6) WHEN 3 THEN ' Done ' WHEN 4 THEN 'ab' WHEN 5 THEN text ELSE '翻译' || text END AS r FROM conversations),
y AS (SELECT *, trim(r, ' ') AS t, len(regexp_extract_all(trim(s, ' '), '[A-Za-z]{{2,}}')) AS words, len(regexp_extract_all(trim(s, ' '), '{X.UNIT.replace("'", "''")}')) AS units FROM x)
SELECT conv_id, turn, CASE WHEN t = '' THEN 'empty' WHEN contains(lower(t), 'only output') THEN 'instructions' WHEN length(t) > greatest(length(trim(s, ' ')) * 5, 500) THEN 'too_long' WHEN lower(t) IN ('ok', 'done', 'success', 'received') THEN 'acknowledgement'
  WHEN length(t) <= 3 AND length(trim(s, ' ')) >= 20 AND units >= 4 THEN 'too_short' WHEN turn % 2 = 1 AND NOT regexp_matches(t, '{X.CJK}') AND words >= 4 AND NOT regexp_matches(trim(s, ' '), '^[A-Za-z0-9._:/#%+=-]{{1,120}}$') THEN 'untranslated' ELSE '' END AS problem FROM y
""")
def output_checks(t):
    k, s = F.col("turn") % 7, F.col("text")
    result = F.when(k == 0, "").when(k == 1, F.concat(F.lit("Only output this: "), s)).when(k == 2, F.repeat(s, 6)).when(k == 3, " Done ").when(k == 4, "ab").when(k == 5, s).otherwise(F.concat(F.lit("翻译"), s))
    return t.conversations.select("conv_id", "turn", T.output_check(result, s, F.col("turn") % 2 == 1, signals=("only output",)).alias("problem"))


@query()
def chapter_match(t):
    """Two documents of a pair; a sentence's chapter is its first letter."""
    rows = G.exploded(t.documents, X.sentences(F.col("text"), 5)).select((F.col("doc_id") / 2).cast("long").alias("pair"), (F.col("doc_id") % 2).alias("side"), "idx", "text", F.left("text", F.lit(1)).alias("chapter"))
    return M.by_chapter(rows.where("side = 0"), rows.where("side = 1"), "pair", "chapter", 0.8)


@query("""
WITH s AS (SELECT p_brand, CASE WHEN p_size % 5 = 0 THEN NULL ELSE (p_partkey % 101) / 100::DOUBLE END AS similarity, CASE WHEN p_size % 2 = 0 THEN 'a' ELSE 'b' END AS side FROM part)
SELECT p_brand, count(similarity) AS matched, count(*) FILTER (similarity IS NULL AND side = 'a') AS only_a, count(*) FILTER (similarity IS NULL AND side = 'b') AS only_b, count(*) FILTER (similarity >= 0.99) AS same, count(*) FILTER (similarity >= 0.95 AND similarity < 0.99) AS high,
  count(*) FILTER (similarity >= 0.85 AND similarity < 0.95) AS mostly, count(*) FILTER (similarity >= 0.7 AND similarity < 0.85) AS partly, count(*) FILTER (similarity >= 0.5 AND similarity < 0.7) AS low, count(*) FILTER (similarity < 0.5) AS very_low,
  round(coalesce(avg(similarity), 0), 4) AS mean, round(coalesce(avg(CASE WHEN similarity >= 0.99 THEN 1.0::DOUBLE WHEN similarity >= 0.7 THEN 0.5::DOUBLE WHEN similarity IS NOT NULL THEN 0 END), 0), 4) AS weighted FROM s GROUP BY 1
""")
def package_rollup(t):
    rows = t.part.select("p_brand", F.when(F.col("p_size") % 5 != 0, (F.col("p_partkey") % 101) / 100.0).alias("similarity"), F.when(F.col("p_size") % 2 == 0, "a").otherwise("b").alias("side"))
    return C.rollup(rows, "p_brand")


def _promised(text: str) -> str:
    return ", ".join(f"sum(len(regexp_extract_all({text}, '{p}'))) AS {n}" for n, p in C.PROMISES.items())


_LINES = "replace(replace(replace(text, '. ', '.' || chr(10) || '- note '), ', ', chr(10) || '2. '), '!', chr(10) || 'Table 3 ![x](y)')"


@query(f"""
WITH d AS (SELECT doc_id, {_LINES} AS text FROM documents), s AS (SELECT doc_id, {_promised('text')} FROM d GROUP BY 1), p AS (SELECT doc_id, {_promised('text')} FROM (SELECT doc_id, replace(text, '2. ', '') AS text FROM d WHERE doc_id % 3 > 0) GROUP BY 1),
u AS (""" + " UNION ALL ".join(f"SELECT s.doc_id, '{n}' AS promise, CAST(s.{n} AS BIGINT) AS expected, CAST(coalesce(p.{n}, 0) AS BIGINT) AS found FROM s LEFT JOIN p USING (doc_id)" for n in C.PROMISES) + """)
SELECT *, CASE WHEN found = expected THEN 'ok' WHEN found < expected THEN 'missing' ELSE 'more' END AS status FROM u WHERE expected > 0 OR found > 0
""")
def package_verify(t):
    """A package lacks numbered lines, and every third is empty."""
    body = F.replace(F.replace(F.replace(F.col("text"), F.lit(". "), F.lit(".\n- note ")), F.lit(", "), F.lit("\n2. ")), F.lit("!"), F.lit("\nTable 3 ![x](y)"))
    docs = t.documents.select("doc_id", body.alias("text"))
    made = docs.select("doc_id", F.when(F.col("doc_id") % 3 > 0, F.replace(F.col("text"), F.lit("2. "), F.lit(""))).alias("text"))
    return C.verify_package(docs, made, "doc_id")


@query("""
WITH f AS (SELECT event_type, 'p' || (user_id % 4) AS provider, count(*) AS n FROM events GROUP BY ALL)
SELECT event_type, CAST(sum(n) AS BIGINT) AS calls, string_agg(provider || ':' || n, ',' ORDER BY provider) AS providers FROM f GROUP BY 1
""")
def usage_provider_map(t):
    rows = t.events.select("event_type", F.concat(F.lit("p"), F.col("user_id") % 4).alias("provider"))
    pairs = F.array_sort(F.transform(F.map_entries("providers"), lambda e: F.concat_ws(":", e["key"], e["value"])))
    return S.usage_map(rows, "event_type", "provider").select("event_type", "calls", F.array_join(pairs, ",").alias("providers"))


@query(f"""
WITH h AS ({_rules_sql()}), s AS (SELECT *, {SCORE} AS score FROM h), g AS (SELECT CASE WHEN grouping(rule) = 1 AND grouping(category) = 1 THEN 'total' WHEN grouping(rule) = 1 THEN 'category' ELSE 'rule' END AS grouping, coalesce(rule, category, 'all') AS name,
  count(*) AS n, count(*) FILTER (score >= 60) AS high, round(count(*) FILTER (score >= 60)::DOUBLE / count(*)::DOUBLE * 100::DOUBLE, 1) AS high_rate, count(DISTINCT doc_id) AS documents FROM s GROUP BY GROUPING SETS ((), (category), (rule)))
SELECT * FROM g WHERE grouping <> 'rule' OR name IN (SELECT name FROM g WHERE grouping = 'rule' ORDER BY n DESC, name LIMIT 20)
""")
def effectiveness_by_group(t):
    rows = I.detect(t.documents, RULES).withColumn("score", I.value_score(SCORING))
    return S.effectiveness(rows, "rule", "category", F.col("score") >= 60, "doc_id")


_GRAMS = "list_distinct(list_transform(range(1, greatest(length(x) - 1, 1) + 1), lambda i: substr(x, i, 2)))"


@query(rf"""
WITH c AS (SELECT doc_id, CAST(i AS INTEGER) AS idx, substr(text, CAST(i * 380 + 1 AS BIGINT), 500) AS text FROM (SELECT doc_id, text, unnest(range(0, (length(text) - 1) // 380 + 1)) AS i FROM documents WHERE text <> '')),
w AS (SELECT doc_id, idx, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS word FROM c), tf AS (SELECT doc_id, idx, word, count(*) AS tf FROM w GROUP BY ALL),
q AS (SELECT item_id AS question_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+'))) AS word FROM benchmark), b AS (SELECT question_id, doc_id, idx, round(3.5::DOUBLE * count(*) + 0.8::DOUBLE * least(sum(tf), 10), 4) AS base FROM tf JOIN q USING (word) GROUP BY ALL),
cg AS (SELECT doc_id, idx, {_GRAMS} AS g FROM (SELECT doc_id, idx, lower(regexp_replace(text, '\s+', '', 'g')) AS x FROM c)), qg AS (SELECT item_id AS question_id, {_GRAMS} AS g FROM (SELECT item_id, lower(regexp_replace(text, '\s+', '', 'g')) AS x FROM benchmark)),
m AS (SELECT question_id, max(base) FILTER (rn = 5) AS fifth FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY base DESC) AS rn FROM b) GROUP BY 1),
s AS (SELECT question_id, doc_id, idx, round(base + 0.25::DOUBLE * least(len(list_intersect(cg.g, qg.g)), 30), 4) AS score FROM b JOIN m USING (question_id) JOIN cg USING (doc_id, idx) JOIN qg USING (question_id) WHERE fifth IS NULL OR base >= fifth - 7.6)
SELECT question_id, doc_id, idx, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id, idx) AS rank FROM s QUALIFY rank <= 5
""")
def qa_score_topk(t):
    chunks = G.exploded(t.documents, X.chunks(F.col("text"), 500, 120))
    asked = t.benchmark.select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))
    return Q.qa_scores(chunks, asked, ["doc_id", "idx"], 5)


WANTED = ("the", "theor", "der", "andre")


@query(rf"""
WITH w AS (SELECT conv_id, turn, role, {_TOKS.format('text')} AS x, {_TOKS.format('role')} AS y FROM conversations)
SELECT conv_id, turn, round(greatest(2::DOUBLE * len(list_intersect(x, ['the', 'theor', 'der', 'andre'])) / 4, 4::DOUBLE * len(list_intersect(y, ['the', 'theor', 'der', 'andre'])) / 4) + 0.35::DOUBLE * (turn % 3)
  + CASE WHEN role = 'user' THEN 1.8::DOUBLE ELSE 0 END + CASE WHEN turn = 0 THEN 0.6::DOUBLE ELSE 0 END, 4) AS score FROM w
""")
def section_function_score(t):
    rows = t.conversations.select("conv_id", "turn", "role", "text", (F.col("turn") % 3).alias("priority"), (F.col("role") == "user").alias("is_summary"), (F.col("turn") == 0).alias("is_checklist"))
    return Q.function_score(rows, Q.best_field({"text": 2.0, "role": 4.0}, list(WANTED)), {"is_summary": 1.8, "is_checklist": 0.6}).select("conv_id", "turn", "score")


@query("""
WITH w AS (SELECT event_type, date_trunc('day', ts) - INTERVAL (k) DAY AS start FROM events, (VALUES (0), (1)) v(k))
SELECT strftime(start, '%Y-%m-%d') AS day, event_type, count(*) AS requests FROM w GROUP BY ALL
""")
def sliding_requests(t):
    out = logs.recent_requests(t.events, "ts", "event_type", "2 days", "1 day")
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "requests")


@query("SELECT event_type, count(*) AS n, count(*) FILTER (hit) AS hits FROM (SELECT event_type, coalesce(ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 3 HOUR, false) AS hit FROM events) GROUP BY 1")
def cache_hit_counts(t):
    return logs.cache_hits(t.events, "ts", "user_id", "3 HOURS").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"))


@query("SELECT 't' || doc_id || '_0.dita' AS path, md5('<topic id=\"t' || doc_id || '_0\"><title>' || source || '</title><body>' || array_to_string(list_transform(list_filter(string_split_regex(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\\n+'), lambda p: trim(p, ' ') <> ''), lambda p: '<p>' || trim(p, ' ') || '</p>'), '') || '</body></topic>') AS content_md5 FROM documents")
def topic_file_contents(t):
    rows = t.documents.select("doc_id", F.lit(0).alias("ord"), F.lit(1).alias("level"), F.col("source").alias("title"), F.col("text").alias("content"))
    return sinks.topic_files(rows, kind="dita").select("path", F.md5("content").alias("content_md5"))


_HEAD = r"(?:chapter\s+\d+|appendix\s+[a-z]|\d+(?:\.\d+)*\.?)\s+\p{L}.{0,80}"


@query(rf"""
WITH l AS (SELECT doc_id, unnest(x) AS line, unnest(range(0, len(x))) AS k FROM (SELECT doc_id, string_split(replace(text, '. ', chr(10) || '1.2 '), chr(10)) AS x FROM documents)),
h AS (SELECT *, regexp_full_match(lower(trim(line, ' ')), '{_HEAD}') AND NOT regexp_matches(trim(line, ' '), '\.{{3,}}|[.;,]$') AS head FROM l),
o AS (SELECT *, CAST(sum(head::INT) OVER (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS INTEGER) AS ord FROM h),
g AS (SELECT doc_id, ord, coalesce(max(CASE WHEN head THEN trim(line, ' ') END), '') AS title, count(*) AS n_lines, coalesce(trim(string_agg(CASE WHEN NOT head THEN line END, chr(10) ORDER BY k), ' '), '') AS content FROM o GROUP BY ALL)
SELECT doc_id, ord, title, n_lines, md5(content) AS content_md5 FROM g WHERE ord > 0 OR content <> ''
""")
def text_chapters(t):
    docs = t.documents.select("doc_id", F.replace(F.col("text"), F.lit(". "), F.lit("\n1.2 ")).alias("text"))
    return readers.chapters(docs).select("doc_id", "ord", "title", "n_lines", F.md5("content").alias("content_md5"))


@query("SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id = 7")
def point_lookup(t):
    return relational.filtered(t.documents, doc_id=7).select("doc_id", "lang", "source", "n_chars")


@query(rf"""
SELECT doc_id, CASE WHEN s = '' THEN 'empty' WHEN regexp_matches(s, '[.!?;]') OR len(regexp_extract_all(s, '{X.UNIT.replace("'", "''")}')) > 8 THEN 'sentence' ELSE 'term' END AS kind,
  len(regexp_extract_all(regexp_replace({_META.replace('lower(trim(regexp_replace(x,', 'lower(trim(regexp_replace(text,')}, '{X.CODE}', ' ', 'g'), '{X.UNIT.replace("'", "''")}')) AS translatable,
  substr(text, greatest(n - 50, 0) + 1, n + 5 + 50 - greatest(n - 50, 0)) AS around, md5(regexp_replace(text, '[0-9]', '#', 'g')) AS masked_md5,
  CASE doc_id % 3 WHEN 0 THEN n WHEN 1 THEN n + 1 ELSE 0 END AS start, CASE WHEN doc_id % 2 = 0 THEN doc_id ELSE -1 END AS k
FROM (SELECT doc_id, text, trim(regexp_replace(text, '\s+', ' ', 'g'), ' ') AS s, CAST(length(text) // 2 AS INTEGER) AS n FROM documents)
""")
def text_helpers(t):
    """Kinds, translatable units, context, masks, positions in two forms, and JSON with a default."""
    n = F.floor(F.length("text") / 2).cast("int")
    position = F.when(F.col("doc_id") % 3 == 0, F.to_json(F.struct(n.alias("start")))).when(F.col("doc_id") % 3 == 1, F.concat((n + 1).cast("string"), F.lit("-"), (n + 9).cast("string"))).otherwise("nowhere")
    said = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('```json\n{"k": '), F.col("doc_id").cast("string"), F.lit("}\n```"))).otherwise("{oops")
    c = F.col("text")
    k = F.coalesce(X.json_or(said, "k long", F.struct(F.lit(-1).cast("long").alias("k")))["k"], F.lit(-1))
    return t.documents.select("doc_id", X.unit_kind(c).alias("kind"), X.translatable_units(c).alias("translatable"), X.context_window(c, n, F.lit(5)).alias("around"), F.md5(X.masked(c, "[0-9]")).alias("masked_md5"), X.span_start(position).alias("start"), k.alias("k"))


@query(r"""
WITH b AS (SELECT item_id AS entry_ord, text AS source_text, left(text, 9) AS translated_text, 0 AS bank FROM benchmark UNION ALL SELECT doc_id, text, left(text, 9 + doc_id % 2), 1 FROM documents UNION ALL SELECT item_id, text, left(text, 9), 2 FROM benchmark)
SELECT entry_ord, md5(source_text) AS source_md5, translated_text, bank FROM b QUALIFY row_number() OVER (PARTITION BY source_text, translated_text ORDER BY bank, entry_ord) = 1
""")
def tm_precedence(t):
    bank = t.benchmark.select(F.col("item_id").alias("entry_ord"), F.col("text").alias("source_text"), F.left("text", F.lit(9)).alias("translated_text"))
    files = t.documents.select(F.col("doc_id").alias("entry_ord"), F.col("text").alias("source_text"), F.left("text", (9 + F.col("doc_id") % 2).cast("int")).alias("translated_text"))
    return T.with_precedence([bank, files, bank]).select("entry_ord", F.md5("source_text").alias("source_md5"), "translated_text", "bank")


@query("""
WITH f AS (SELECT user_id, CAST(floor(value) AS INTEGER) AS start, CAST(floor(value) AS INTEGER) + 5 AS "end", event_type AS type, 'm' || (event_id % 3) AS message, 0 AS e FROM events UNION ALL SELECT user_id, CAST(floor(value) AS INTEGER), CAST(floor(value) AS INTEGER) + 5, 'click', 'other', 1 FROM events)
SELECT user_id, start, "end", type, message FROM f QUALIFY row_number() OVER (PARTITION BY user_id, start, "end", type ORDER BY e, message) = 1
""")
def span_sort_dedupe(t):
    start = F.floor("value").cast("int")
    found = t.events.select("user_id", start.alias("start"), (start + 5).alias("end"), F.col("event_type").alias("type"), F.concat(F.lit("m"), F.col("event_id") % 3).alias("message"))
    return proofing.spell_response([found, found.withColumns({"type": F.lit("click"), "message": F.lit("other")})], key="user_id")


@query("SELECT doc_id, md5(regexp_replace(regexp_replace(x, '([\\x{4E00}-\\x{9FFF}])([A-Za-z0-9])', '\\1 \\2', 'g'), '([A-Za-z0-9])([\\x{4E00}-\\x{9FFF}])', '\\1 \\2', 'g')) AS spaced_md5 FROM (SELECT doc_id, translate(text, 'aei', '的一是') AS x FROM documents)")
def script_spacing(t):
    return t.documents.select("doc_id", F.md5(proofing.spaced_scripts(F.translate("text", "aei", "的一是"))).alias("spaced_md5"))
