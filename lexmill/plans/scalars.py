"""Queries of scalar functions: languages, Markdown, extracted text, sentence forms, prefixes, sets, entities."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexmill.functions import text as X
from lexmill.operators import retrieval as Q
from lexmill.plans.registry import query

_ZH = f"len(regexp_extract_all(text, '{X.CJK}'))"


@query(f"""
SELECT doc_id, CASE WHEN length(text) = 0 THEN 'unknown' WHEN {_ZH}::DOUBLE / length(text) >= 0.25 THEN 'zh' ELSE 'en' END AS by_share,
  CASE WHEN {_ZH} > len(regexp_extract_all(text, '[A-Za-z]')) THEN 'zh' WHEN {_ZH} < len(regexp_extract_all(text, '[A-Za-z]')) THEN 'en' ELSE 'unknown' END AS by_majority,
  CASE WHEN len(regexp_extract_all(text, '[A-Za-z]{{2,}}')) >= 5 AND len(regexp_extract_all(text, '[A-Za-z]{{2,}}')) >= greatest(1, {_ZH} * 2) THEN 'english' ELSE 'chinese' END AS of_document
FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN translate(text, 'aeiou', '的一是不了') ELSE text END AS text FROM documents)
""")
def language_checks(t):
    """Every third document has CJK characters for its vowels."""
    body = F.when(F.col("doc_id") % 3 == 0, F.translate("text", "aeiou", "的一是不了")).otherwise(F.col("text"))
    return t.documents.select("doc_id", X.language_by_share(body).alias("by_share"), X.language_by_majority(body).alias("by_majority"), X.language_of_document(body).alias("of_document"))


def _chain(c: str, steps) -> str:
    for pattern, instead in steps:
        for k in "123":
            instead = instead.replace("$" + k, "\\" + k)
        c = f"regexp_replace({c}, '{pattern}', '{instead}', 'g')"
    return c


_MARKED = "'## ' || replace(text, '. ', '**. ** [link](x) `code` ') || '\n> quote\n| a | b |\n|---|---|\n'"


@query(f"SELECT doc_id, md5(trim({_chain(f'({_MARKED})', X.PLAIN_MARKDOWN)}, ' ')) AS plain_md5 FROM documents")
def markdown_plain(t):
    body = F.concat(F.lit("## "), F.replace(F.col("text"), F.lit(". "), F.lit("**. ** [link](x) `code` ")), F.lit("\n> quote\n| a | b |\n|---|---|\n"))
    return t.documents.select("doc_id", F.md5(X.plain_markdown(body)).alias("plain_md5"))


@query(f"SELECT doc_id, md5(trim({_chain(chr(40) + 'replace(replace(text, chr(32) || chr(116), chr(45) || chr(10) || chr(116)), chr(33), chr(46) || chr(46) || chr(46) || chr(46) || chr(49) || chr(10))' + chr(41), X.EXTRACT_REPAIRS)}, ' ')) AS cleaned_md5 FROM documents")
def extract_cleaned(t):
    """Words that begin with t follow a hyphen and a line end; exclamation marks are rows of dots with a page number."""
    body = F.replace(F.replace(F.col("text"), F.lit(" t"), F.lit("-\nt")), F.lit("!"), F.lit("....1\n"))
    return t.documents.select("doc_id", F.md5(X.cleaned_extract(body)).alias("cleaned_md5"))


def _form(name: str) -> str:
    pattern, instead, least = X.SENTENCE_FORMS[name]
    base = "text" if name == "whole" else r"trim(regexp_replace(text, '\s+', ' ', 'g'), ' ')"
    found = f"string_split({_chain(base, [(pattern, instead)])}, '{X.MARK}')"
    found = found if name == "whole" else f"list_transform({found}, lambda z: trim(z, ' '))"
    return f"list_filter({found}, lambda z: length(z) >= {least})"


@query("SELECT doc_id, form, len(s) AS n, md5(array_to_string(s, chr(10))) AS joined_md5 FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{f}' AS form, {_form(f)} AS s FROM documents" for f in X.SENTENCE_FORMS) + ")")
def sentence_forms(t):
    forms = F.array(*(F.struct(F.lit(f).alias("form"), X.sentences_by(F.col("text"), f).alias("s")) for f in X.SENTENCE_FORMS))
    return t.documents.select("doc_id", F.inline(forms)).select("doc_id", "form", F.size("s").cast("long").alias("n"), F.md5(F.array_join("s", "\n")).alias("joined_md5"))


@query(r"""
SELECT doc_id, len(p) AS n, md5(array_to_string(p, chr(1))) AS joined_md5 FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(regexp_replace(text, '\n([A-Z0-9\x{4E00}-\x{9FFF}])', chr(10) || chr(10) || '\1', 'g'), '\n\s*\n'), lambda z: trim(z, ' ')), lambda z: length(z) >= 5) AS p FROM documents)
""")
def blank_line_paragraphs(t):
    p = X.blank_line_paragraphs(F.col("text"))
    return t.documents.select("doc_id", F.size(p).cast("long").alias("n"), F.md5(F.array_join(p, "\x01")).alias("joined_md5"))


@query("""
WITH x AS (SELECT p_partkey, p_name || ' ' || p_type AS a, lead(p_name || ' ' || p_type) OVER (PARTITION BY p_brand ORDER BY p_name, p_type, p_partkey) AS b FROM part),
y AS (SELECT p_partkey, a, b, len(list_filter(range(1, least(length(a), length(b)) + 1), lambda k: left(a, k) = left(b, k))) AS n FROM x WHERE b IS NOT NULL)
SELECT p_partkey, round(CASE WHEN n >= 2 AND n::DOUBLE / greatest(length(a), length(b)) >= 0.3 THEN 0.6::DOUBLE + 0.25::DOUBLE * (n::DOUBLE / greatest(length(a), length(b))) ELSE 0 END, 6) AS prefix,
  round(greatest(0::DOUBLE, 1 - 2 * levenshtein(a, b)::DOUBLE / (length(a) + length(b))), 6) AS edits FROM y
""")
def name_similarity(t):
    name = F.concat_ws(" ", "p_name", "p_type")
    rows = t.part.select("p_partkey", name.alias("a"), F.lead(name).over(Window.partitionBy("p_brand").orderBy("p_name", "p_type", "p_partkey")).alias("b")).where("b is not null")
    return rows.select("p_partkey", F.round(X.prefix_similarity(F.col("a"), F.col("b")), 6).alias("prefix"), F.round(X.edit_ratio(F.col("a"), F.col("b")), 6).alias("edits"))


@query(r"""
WITH x AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS a, lead(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations)
SELECT conv_id, turn, array_to_string(list_sort(list_concat(list_filter(a, lambda w: NOT list_contains(b, w)), list_filter(b, lambda w: NOT list_contains(a, w)))), ' ') AS changed FROM x WHERE b IS NOT NULL
""")
def token_symmetric_difference(t):
    words = F.array_distinct(X.tokens(F.col("text")))
    rows = t.conversations.select("conv_id", "turn", words.alias("a"), F.lead(words).over(Window.partitionBy("conv_id").orderBy("turn")).alias("b")).where("b is not null")
    return rows.select("conv_id", "turn", F.array_join(F.array_sort(X.symmetric_difference(F.col("a"), F.col("b"))), " ").alias("changed"))


@query("""
SELECT header, CASE WHEN k IN ('zh', 'zhcn', 'cn', 'chinese', '中文') THEN 'zh' WHEN k IN ('en', 'enus', 'english', '英文') THEN 'en' WHEN k IN ('ja', 'jajp', 'japanese', '日文') THEN 'ja' WHEN k IN ('ko', 'kokr', 'korean', '韩文') THEN 'ko' END AS language, n
FROM (SELECT header, lower(regexp_replace(header, '[\\s_-]+', '', 'g')) AS k, count(*) AS n FROM (SELECT CASE doc_id % 4 WHEN 0 THEN upper(lang) WHEN 1 THEN lang || '_US' WHEN 2 THEN ' zh-CN ' ELSE '英 文' END AS header FROM documents) GROUP BY 1)
""")
def header_languages(t):
    k = F.col("doc_id") % 4
    header = F.when(k == 0, F.upper("lang")).when(k == 1, F.concat("lang", F.lit("_US"))).when(k == 2, " zh-CN ").otherwise("英 文")
    rows = t.documents.groupBy(header.alias("header")).agg(F.count("*").alias("n"))
    return rows.select("header", X.header_language(F.col("header")).alias("language"), "n")


@query(r"""
WITH w AS (SELECT unnest(regexp_extract_all(text, '\p{Lu}[\p{L}-]{1,20}')) AS entity, doc_id FROM documents)
SELECT entity, count(*) AS n, count(DISTINCT doc_id) AS documents FROM w GROUP BY 1 HAVING count(*) >= 2 ORDER BY n DESC, entity LIMIT 200
""")
def entity_frequency(t):
    return Q.entities(t.documents, "doc_id", r"\p{Lu}[\p{L}-]{1,20}", least=2, k=200)
