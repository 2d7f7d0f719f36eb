"""Scalar text functions as columns: normalising, splitting, counting, comparing.

All are built-in expressions that Spark compiles. Patterns are written in the syntax common to
Java and RE2, so the same pattern serves a Spark plan and a SQL oracle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}]+"
CJK = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]"
SENTENCE = r"[^.!?\n]+[.!?]*"
#: One unit: a CJK character, or letters and digits with connectors between them.
UNIT = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]|[\p{L}\p{N}]+(?:['_.+-][\p{L}\p{N}]+)*"
SCRIPTS = (("ko", r"[\x{AC00}-\x{D7AF}]"), ("ja", r"[\x{3040}-\x{30FF}]"), ("ru", r"[\x{0400}-\x{04FF}]"), ("zh", CJK))


def text_of(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def collapsed(c: Column) -> Column:
    """White space as single spaces, none at the ends; null as empty."""
    return F.trim(F.regexp_replace(text_of(c), r"\s+", " "))


def compact(c: Column) -> Column:
    """Without white space, in lower case."""
    return F.lower(F.regexp_replace(text_of(c), r"\s+", ""))


def letters_digits(c: Column) -> Column:
    """Only letters and digits, in lower case: keys that ignore spaces and symbols."""
    return F.lower(F.regexp_replace(text_of(c), r"[^\p{L}\p{N}]+", ""))


def tokens(c: Column, pattern: str = TOKEN) -> Column:
    """Words of letters and digits in lower case, in order."""
    return F.regexp_extract_all(F.lower(text_of(c)), F.lit(pattern), 0)


def token_key(c: Column) -> Column:
    """The words joined by single spaces with one at each end: containment is ``contains``."""
    return F.concat(F.lit(" "), F.array_join(tokens(c), " "), F.lit(" "))


#: Words that say how a text was made, not what it says: names of languages, and states. Callers have their own.
METADATA_WORDS = ("english", "german", "french", "spanish", "chinese", "japanese", "draft", "revised")
LOCALE = r"\b[a-z]{2}-[a-z]{2}\b"
VERSION = r"\bv(?:er|ersion)?\.? ?\d[\d.]*|\b\d+\.\d+\.\d[\d.]*"
CODE = r"\b\w*\d[\w.+-]*"


def metadata_pattern(words: Sequence[str] = METADATA_WORDS) -> str:
    """Locales, versions and the given words, as one pattern for lower-case text."""
    return "|".join([LOCALE, VERSION, *(rf"\b{w}\b" for w in words)])


def without_metadata(c: Column, words: Sequence[str] = METADATA_WORDS) -> Column:
    """Collapsed lower-case text without locales, version numbers and the given words."""
    out = F.regexp_replace(F.lower(collapsed(c)), r"[_/]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, metadata_pattern(words), " "), r"\s+", " "))


def text_units(c: Column) -> Column:
    """CJK characters and words."""
    return F.regexp_count(text_of(c), F.lit(UNIT)).cast("long")


def translatable_units(c: Column) -> Column:
    """Units left after codes, versions and numbers are taken out."""
    return text_units(F.regexp_replace(without_metadata(c), CODE, " "))


def unit_kind(c: Column) -> Column:
    """empty, sentence or term."""
    t = collapsed(c)
    return F.when(t == "", "empty").when(t.rlike(r"[.!?;]") | (text_units(t) > 8), "sentence").otherwise("term")


def sentences(c: Column, least: int = 2) -> Column:
    """Sentences ended by . ! ? or a line, trimmed, of at least ``least`` characters."""
    found = F.transform(F.regexp_extract_all(text_of(c), F.lit(SENTENCE), 0), lambda s: F.trim(s))
    return F.filter(found, lambda s: F.length(s) >= least)


def paragraphs(c: Column, least: int = 5) -> Column:
    found = F.transform(F.split(text_of(c), r"\n+"), lambda s: F.trim(s))
    return F.filter(found, lambda s: F.length(s) >= least)


def blank_line_paragraphs(c: Column, least: int = 5) -> Column:
    """Parts between blank lines; a line that begins with a capital, a digit or a CJK character opens one too."""
    marked = F.regexp_replace(text_of(c), r"\n([A-Z0-9\x{4E00}-\x{9FFF}])", "\n\n$1")
    found = F.transform(F.split(marked, r"\n\s*\n"), lambda s: F.trim(s))
    return F.filter(found, lambda s: F.length(s) >= least)


#: Ways to end a sentence: pattern, what stands for it with a mark where the sentence ends, and the least length.
MARK = "␞"
SENTENCE_FORMS = {
    "either": (r"([。；！？])|([.;!?])\s+", "$1$2" + MARK, 2),
    "spaced": (r"([.!?;。！？；])\s+", "$1" + MARK, 2),
    "capital": (r"([.!])\s+([A-Z])", "$1" + MARK + "$2", 5),
    "whole": (r"([.!?])(\s)|(\n+)", "$1$2$3" + MARK, 1),
}


def sentences_by(c: Column, form: str) -> Column:
    """Sentences in one of ``SENTENCE_FORMS``, trimmed except in the form ``whole``, which loses nothing."""
    pattern, instead, least = SENTENCE_FORMS[form]
    t = text_of(c) if form == "whole" else collapsed(c)
    found = F.split(F.regexp_replace(t, pattern, instead), MARK)
    found = found if form == "whole" else F.transform(found, lambda s: F.trim(s))
    return F.filter(found, lambda s: F.length(s) >= least)


def lines(c: Column) -> Column:
    return F.split(text_of(c), "\n")


def chunks(c: Column, size: int, overlap: int, least_step: int = 120) -> Column:
    """Overlapping windows of characters; each starts ``max(size - overlap, least_step)`` after the last."""
    step, t = max(size - overlap, least_step), text_of(c)
    starts = F.sequence(F.lit(0), F.greatest(F.length(t) - 1, F.lit(0)), F.lit(step))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.transform(starts, lambda s: F.substring(t, s + 1, F.lit(size))))


def bound(c: Column, use) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.transform(F.array(c), use)[0]


def char_ngrams(c: Column, n: int = 2) -> Column:
    """Distinct n-grams of characters; a shorter text is one n-gram, an empty text none."""

    def grams(t: Column) -> Column:
        m = F.length(t)
        found = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(m - (n - 1), F.lit(1))), lambda i: F.substring(t, i, F.lit(n))))
        return F.when(m == 0, F.array().cast("array<string>")).otherwise(found)

    return bound(c, grams)


def word_ngrams(words: Column, n: int = 2) -> Column:
    """Distinct n-grams of words."""

    def grams(w: Column) -> Column:
        m = F.size(w)
        found = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(m - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), " ")))
        return F.when(m < n, F.array().cast("array<string>")).otherwise(found)

    return bound(words, grams)


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def overlap(a: Column, b: Column) -> Column:
    """Common members over the larger set; 0 where it is empty."""
    larger = F.greatest(F.size(a), F.size(b))
    return F.when(larger == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / larger)


def symmetric_difference(a: Column, b: Column) -> Column:
    """Members of just one of two sets."""
    return F.array_union(F.array_except(a, b), F.array_except(b, a))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the beginning that two texts share."""
    n = F.least(F.length(text_of(a)), F.length(text_of(b)))
    return F.when(n == 0, 0).otherwise(F.size(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.left(text_of(a), k) == F.left(text_of(b), k))))


def prefix_similarity(a: Column, b: Column, base: float = 0.60, share: float = 0.25) -> Column:
    """base + share times the common beginning over the longer length; 0 if that is under two characters or 0.3."""

    def score(n: Column) -> Column:
        part = n / F.greatest(F.length(text_of(a)), F.length(text_of(b)), F.lit(1))
        return F.when((n >= 2) & (part >= 0.3), base + share * part).otherwise(0.0)

    return bound(common_prefix(a, b), score)


def edit_ratio(a: Column, b: Column) -> Column:
    """1 - 2 edits / both lengths, at least 0: never above the ratio of matched characters."""
    both = F.length(text_of(a)) + F.length(text_of(b))
    return F.when(both == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - 2 * F.levenshtein(text_of(a), text_of(b)) / both))


def edit_similarity(a: Column, b: Column, longest: int = 15) -> Column:
    """1 - edit distance / longer length of short texts; 0 where one is longer than ``longest`` or both are empty."""
    most = F.greatest(F.length(a), F.length(b))
    return F.when((most == 0) | (most > longest), 0.0).otherwise(1 - F.levenshtein(a, b) / most)


def language_by_script(c: Column, hints: dict[str, Sequence[str]], marks: dict[str, str], default: str = "en") -> Column:
    """Language by script (two characters of one decide), else by hint words (3 each) and marks (2 each).

    Ties and texts without either go to the default, then to the first name in order.
    """
    t = F.lower(text_of(c))
    found = None
    for name, pattern in SCRIPTS:
        hit = F.regexp_count(t, F.lit(pattern)) >= 2
        found = F.when(hit, name) if found is None else found.when(hit, name)
    scores = [
        F.struct(
            (3 * F.regexp_count(t, F.lit(rf"\b(?:{'|'.join(words)})\b")) + 2 * F.regexp_count(t, F.lit(marks.get(name, r"[^\s\S]")))).alias("score"),
            F.lit(int(name == default)).alias("is_default"),
            F.lit(-k).alias("order"),
            F.lit(name).alias("name"),
        )
        for k, (name, words) in enumerate(sorted(hints.items()))
    ]
    return found.otherwise(F.array_max(F.array(*scores))["name"])


def language_by_share(c: Column, least: float = 0.25) -> Column:
    """zh if at least this share of the characters is CJK, else en; unknown without a character."""
    n = F.length(text_of(c))
    return F.when(n == 0, "unknown").when(F.regexp_count(text_of(c), F.lit(CJK)) / n >= least, "zh").otherwise("en")


def language_by_majority(c: Column) -> Column:
    """zh or en, as CJK characters or Latin letters are more; unknown where neither."""
    zh, en = F.regexp_count(text_of(c), F.lit(CJK)), F.regexp_count(text_of(c), F.lit("[A-Za-z]"))
    return F.when(zh > en, "zh").when(en > zh, "en").otherwise("unknown")


def language_of_document(c: Column, least_words: int = 5, factor: int = 2) -> Column:
    """english with enough Latin words, ``factor`` for each CJK character; else chinese."""
    zh, words = F.regexp_count(text_of(c), F.lit(CJK)), F.regexp_count(text_of(c), F.lit(r"[A-Za-z]{2,}"))
    return F.when((words >= least_words) & (words >= F.greatest(F.lit(1), zh * factor)), "english").otherwise("chinese")


# Column headers that name a language.
HEADER_LANGUAGES = {"zh": "zh", "zhcn": "zh", "cn": "zh", "chinese": "zh", "中文": "zh", "en": "en", "enus": "en", "english": "en", "英文": "en", "ja": "ja", "jajp": "ja", "japanese": "ja", "日文": "ja", "ko": "ko", "kokr": "ko", "korean": "ko", "韩文": "ko"}


def header_language(c: Column) -> Column:
    """The language that a column header names, in any case, with any separators; null for others."""
    return F.element_at(F.create_map(*(F.lit(x) for kv in HEADER_LANGUAGES.items() for x in kv)), F.lower(F.regexp_replace(text_of(c), r"[\s_-]+", "")))


def plain_markdown(c: Column) -> Column:
    """Markdown as plain text: marks of headings, quotes, emphasis, code, links and tables go, their words stay."""
    out = text_of(c)
    for pattern, instead in PLAIN_MARKDOWN:
        out = F.regexp_replace(out, pattern, instead)
    return F.trim(out)


PLAIN_MARKDOWN = (
    (r"(?m)^[ |:-]*-{3,}[ |:-]*$", ""),
    (r"(?m)^ *(?:#{1,6}|>) *", ""),
    (r"!?\[([^\]\n]*)\]\([^)\n]*\)", "$1"),
    (r"\*\*([^*\n]+)\*\*", "$1"),
    (r"\*([^*\n]+)\*", "$1"),
    (r"`+([^`\n]+)`+", "$1"),
    (r"(?m)^[ |]+|[ |]+$", ""),
    (r"\n{3,}", "\n\n"),
)

#: What taking text out of laid-out pages leaves behind: control characters, broken words, rows of dots, missing spaces.
EXTRACT_REPAIRS = (
    (r"\r\n?", "\n"),
    (r"[\x00-\x08\x0B\x0E-\x1F\x7F]", ""),
    (r"([A-Za-z])-\n([a-z])", "$1$2"),
    (r"(?m)^.{2,80}?\.{3,} *\d+ *$\n?", ""),
    (r"\.{4,}", " "),
    (r"(\d)(mL|mm|cm|kg|mg|GB|MB|rpm|min)\b", "$1 $2"),
    (r"(\d) *(?:℃|° *C)", "$1 °C"),
    (r"[ \t]{2,}", " "),
    (r"\n{3,}", "\n\n"),
)


def cleaned_extract(c: Column) -> Column:
    """Text as ``EXTRACT_REPAIRS`` leave it, in their order, trimmed."""
    out = text_of(c)
    for pattern, instead in EXTRACT_REPAIRS:
        out = F.regexp_replace(out, pattern, instead)
    return F.trim(out)


def masked(c: Column, pattern: str, mark: str = "#") -> Column:
    """Text with every character of a one-character pattern replaced: lengths and offsets stay."""
    return F.regexp_replace(text_of(c), pattern, mark)


def context_window(c: Column, start: Column, length: Column, around: int = 50) -> Column:
    """The characters around a span that starts at ``start`` (from 0)."""
    first = F.greatest(start - around, F.lit(0))
    return F.substring(text_of(c), first + 1, start + length + around - first)


def span_start(position: Column) -> Column:
    """Start of a position given as ``{"start": n}`` or ``a-b``; 0 for anything else."""
    found = F.coalesce(F.get_json_object(position, "$.start").try_cast("int"), F.regexp_extract(position, r"^(\d+)-\d+", 1).try_cast("int"))
    return F.coalesce(found, F.lit(0))


def json_or(c: Column, schema: str, default: Column) -> Column:
    """JSON text with a schema, or the default where it is null or malformed."""
    return F.coalesce(F.from_json(F.trim(F.regexp_replace(c, r"^\s*```(?:json)?|```\s*$", "")), schema), default)


def clamped(c: Column, digits: int = 1) -> Column:
    """Rounded and between 0 and 100."""
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.round(c, digits)))
