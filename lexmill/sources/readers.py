"""Readers: files of many kinds as DataFrames of documents, lines, entries, rules and terms.

Text, CSV, JSON, XML and HTML are read by Spark itself. Formats that need a library go through
``parse_files``, whose parsers are plug-ins; a missing library fails only when its format is met.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import text as X

# Labels of file extensions.
FILE_TYPES = {"pdf": "pdf", "docx": "docx", "doc": "docx", "md": "md", "markdown": "md", "txt": "txt", "csv": "csv", "xlsx": "xlsx", "xls": "xlsx", "pptx": "pptx", "idml": "idml", "xlf": "xlf", "xliff": "xlf", "dita": "dita", "ditamap": "dita", "xml": "dita", "zip": "dita", "html": "html", "htm": "html"}
ENCODINGS = ("utf-8", "gb18030", "utf-16", "latin-1")


def file_type(path: Column) -> Column:
    """Label of a path's extension, null if it is unknown."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.element_at(F.create_map(*(F.lit(x) for kv in FILE_TYPES.items() for x in kv)), ext)


def decoded(data: bytes, encodings: Sequence[str] = ENCODINGS) -> str:
    """Text of bytes by the first encoding that fits."""
    for e in encodings:
        try:
            return data.decode(e)
        except UnicodeDecodeError:
            continue
    return data.decode(encodings[0], "replace")


def decoded_text(content: Column, encodings: Sequence[str] = ENCODINGS) -> Column:
    """Text of binary contents, the first encoding that fits."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for contents in batches:
            yield pd.Series([None if c is None else decoded(bytes(c), encodings) for c in contents], dtype=object)

    return run(content)


def text_files(spark: SparkSession, path: str, glob: str = "*.txt", encodings: Sequence[str] = ENCODINGS) -> DataFrame:
    """path and text of whole files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", decoded_text(F.col("content"), encodings).alias("text"))


class _Html(HTMLParser):
    BLOCKS = frozenset("p div li ul ol tr td h1 h2 h3 h4 h5 h6 br section article table header footer nav blockquote pre".split())
    HIDDEN = frozenset(("script", "style", "noscript"))

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.titles, self.hidden, self.in_title = [], [], 0, False

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in self.HIDDEN
        self.in_title |= tag == "title"
        if tag in self.BLOCKS:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        self.hidden = max(0, self.hidden - (tag in self.HIDDEN))
        self.in_title &= tag != "title"
        if tag in self.BLOCKS:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            (self.titles if self.in_title else self.parts).append(data)


def parse_html(html: str | None) -> tuple[str, str]:
    """Title and text of a page: hidden elements go, block ends are line ends, white space is single."""
    p = _Html()
    p.feed(html or "")
    p.close()
    lines = (" ".join(x.split()) for x in "".join(p.parts).split("\n"))
    return " ".join("".join(p.titles).split()), "\n".join(x for x in lines if x)


def html_pages(pages: DataFrame, html: str = "html", most_bytes: int | None = None) -> DataFrame:
    """Pages with title and text in place of their markup; pages above ``most_bytes``, if given, are refused with nulls."""

    @F.pandas_udf("title string, text string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([parse_html(t) if not most_bytes or t is None or len(t.encode()) <= most_bytes else (None, None) for t in texts], columns=["title", "text"])

    return pages.select(*(c for c in pages.columns if c != html), run(F.col(html)).alias("p")).select("*", "p.*").drop("p")


Parser = Callable[[bytes], str]
PARSERS: dict[str, Parser] = {"txt": decoded, "md": decoded, "csv": decoded, "html": lambda b: parse_html(decoded(b))[1]}


def xml_text(data: bytes, keep: Sequence[str] = ()) -> str:
    """Text of the elements of an XML document in order, of those named if any are."""
    from xml.etree import ElementTree

    root = ElementTree.fromstring(data)
    found = [e for e in root.iter() if not keep or e.tag.rpartition("}")[2] in keep]
    return "\n".join(t for e in found if (t := " ".join("".join(e.itertext() if keep else [e.text or ""]).split())))


def zipped_xml_text(member: str, keep: Sequence[str]) -> Parser:
    """A parser of office files: the named elements of the members whose names match."""

    def parse(data: bytes) -> str:
        import io
        import zipfile

        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names = sorted((n for n in z.namelist() if re.fullmatch(member, n)), key=lambda n: [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", n)])
            return "\n".join(filter(None, (xml_text(z.read(n), keep) for n in names)))

    return parse


def _members(data: bytes):
    import io
    import zipfile

    return zipfile.ZipFile(io.BytesIO(data))


def _xml(data: bytes):
    from xml.etree import ElementTree

    return ElementTree.fromstring(data)


def _tag(e) -> str:
    return e.tag.rpartition("}")[2]


def _text(e) -> str:
    return " ".join("".join(e.itertext()).split())


def sheet_rows(data: bytes) -> list[tuple[str, int, list[str]]]:
    """(sheet, row, cells) of a workbook: texts, numbers and gaps at their places, sheets in their order."""
    with _members(data) as z:
        names = set(z.namelist())
        shared = [_text(e) for e in _xml(z.read("xl/sharedStrings.xml")) if _tag(e) == "si"] if "xl/sharedStrings.xml" in names else []
        links = {e.get("Id"): e.get("Target").lstrip("/").removeprefix("xl/") for e in _xml(z.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for sheet in (e for e in _xml(z.read("xl/workbook.xml")).iter() if _tag(e) == "sheet"):
            part = links[next(v for k, v in sheet.attrib.items() if k.endswith("}id"))]
            for row in (e for e in _xml(z.read(f"xl/{part}")).iter() if _tag(e) == "row"):
                cells: list[str] = []
                for c in row:
                    letters = re.match("[A-Z]*", c.get("r", ""))[0]
                    at = 0
                    for x in letters:
                        at = at * 26 + ord(x) - 64
                    cells += [""] * (at - 1 - len(cells))
                    value = next((x.text or "" for x in c if _tag(x) == "v"), "")
                    cells.append(shared[int(value)] if c.get("t") == "s" else _text(c) if c.get("t") == "inlineStr" else value)
                if any(cells):
                    out.append((sheet.get("name"), int(row.get("r", len(out) + 1)), cells))
        return out


def document_text(data: bytes) -> str:
    """Paragraphs of a word-processing file in order, the rows of its tables as cells between bars."""

    def parts(e) -> Iterator[str]:
        for x in e:
            if _tag(x) == "p":
                yield _text(x)
            elif _tag(x) == "tbl":
                for row in (r for r in x if _tag(r) == "tr"):
                    yield "| " + " | ".join(" ".join(filter(None, parts(c))) for c in row if _tag(c) == "tc") + " |"
            else:
                yield from parts(x)

    with _members(data) as z:
        return "\n".join(filter(None, parts(_xml(z.read("word/document.xml")))))


def document_comments(data: bytes) -> list[tuple[str, str, str]]:
    """(author, date, text) of the comments in a word-processing file."""
    with _members(data) as z:
        if "word/comments.xml" not in z.namelist():
            return []
        return [tuple(next((v for k, v in e.attrib.items() if k.endswith(n)), "") for n in ("author", "date")) + (_text(e),) for e in _xml(z.read("word/comments.xml")) if _tag(e) == "comment"]


def map_topics(data: bytes) -> list[tuple[int, str, str, list[str]]]:
    """(ord, href, navtitle, path) of a map's topic references, depth first; path holds the titles above and its own."""
    out: list[tuple[int, str, str, list[str]]] = []

    def walk(e, above: list[str]) -> None:
        for x in e:
            if _tag(x) in ("topicref", "chapter", "topichead", "appendix"):
                inner = next((_text(t) for t in x.iter() if _tag(t) == "navtitle"), "")
                title = x.get("navtitle") or inner
                path = above + [title] if title else above
                if x.get("href"):
                    out.append((len(out), x.get("href"), title, path))
                walk(x, path)
            elif _tag(x) not in ("topicmeta", "title"):
                walk(x, above)

    walk(_xml(data), [])
    return out


def exploded_files(files: DataFrame, parse: Callable[[bytes], list[tuple]], schema: str) -> DataFrame:
    """A row for each tuple that ``parse`` makes of a binary file (path, content), beside its path; unreadable files give none."""
    names = [x.strip().split()[0] for x in schema.split(",")]

    def one(data) -> list[dict]:
        try:
            return [dict(zip(names, row, strict=True)) for row in parse(bytes(data))] if data is not None else []
        except Exception:
            return []

    @F.pandas_udf("array<struct<" + ",".join(x.strip().replace(" ", ":", 1) for x in schema.split(",")) + ">>")
    def run(contents: pd.Series) -> pd.Series:
        return contents.map(one)

    return files.select("path", F.inline(run("content")))


def workbook_rows(files: DataFrame) -> DataFrame:
    """(path, sheet, row, cells) of workbooks."""
    return exploded_files(files, sheet_rows, "sheet string, row int, cells array<string>")


def comments(files: DataFrame) -> DataFrame:
    """(path, author, date, text) of the comments in word-processing files."""
    return exploded_files(files, document_comments, "author string, date string, text string")


def topics(files: DataFrame) -> DataFrame:
    """(path, ord, href, navtitle, way) of maps."""
    return exploded_files(files, map_topics, "ord int, href string, navtitle string, way array<string>")


def archive_members(files: DataFrame) -> DataFrame:
    """(path, member, content) of the files in archives."""

    def parse(data: bytes) -> list[tuple[str, bytes]]:
        with _members(data) as z:
            return [(n, z.read(n)) for n in sorted(z.namelist()) if not n.endswith("/")]

    return exploded_files(files, parse, "member string, content binary")


def package_topics(files: DataFrame) -> DataFrame:
    """(path, ord, member, navtitle, way, text) of packages: the topics of an archive's maps in their order, with their texts.

    A reference is read from its map's folder; topics that the archive lacks have a null text.
    """
    members = archive_members(files)
    maps = members.where(F.lower("member").endswith(".ditamap")).select(F.to_json(F.struct("path", "member")).alias("path"), "content")
    at = F.from_json("path", "path string, member string")
    found = topics(maps).withColumn("map", at).withColumn("target", F.concat(F.regexp_extract("map.member", r"^(.*/)?", 0), F.regexp_replace("href", r"#.*$", "")))
    named = members.where(F.lower("member").endswith(".dita")).select(F.concat_ws("\n", "path", "member").alias("path"), "content")
    texts = parse_files(named).select(F.split("path", "\n").alias("of"), "text").select(F.col("of")[0].alias("_path"), F.col("of")[1].alias("_member"), "text")
    rows = found.join(texts, (F.col("map.path") == F.col("_path")) & (F.col("target") == F.col("_member")), "left")
    return rows.select(F.col("map.path").alias("path"), "ord", F.col("target").alias("member"), "navtitle", "way", "text")


def workbook_terms(files: DataFrame) -> DataFrame:
    """(bad, good) of the first two columns of workbooks below their first rows; equal and blank pairs go, the first of a term stays."""
    cell = lambda k: F.trim(F.coalesce(F.get("cells", F.lit(k)), F.lit("")))
    rows = workbook_rows(files).where("row > 1").select("path", "sheet", "row", cell(0).alias("bad"), cell(1).alias("good")).where("bad <> '' and good <> '' and bad <> good")
    return rows.groupBy("bad").agg(F.min_by("good", F.struct("path", "sheet", "row")).alias("good"))


def seed_rules(rows: DataFrame, number: str = "id", prefix: str = "EXT-") -> DataFrame:
    """Rules of an outside list with rule_no, the prefix and their number: what ``sinks.import_plan`` takes as its key."""
    return rows.withColumn("rule_no", F.concat(F.lit(prefix), F.col(number).cast("string"))).where(F.col(number).isNotNull())


HEADING = r"^(?:chapter\s+\d+|appendix\s+[a-z]|\d+(?:\.\d+)*\.?)\s+\p{L}.{0,80}$"


def chapters(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", heading: str = HEADING) -> DataFrame:
    """(doc_id, ord, title, n_lines, content) of the chapters of plain text, by lines that look like headings and are no row of contents."""
    from pyspark.sql import Window

    rows = docs.select(doc_id, F.posexplode(X.lines(F.col(text))).alias("line_no", "line"))
    line = F.trim("line")
    is_heading = F.lower(line).rlike(heading) & ~line.rlike(r"\.{3,}|[.;,]$")
    rows = rows.withColumn("title", F.when(is_heading, line))
    rows = rows.withColumn("ord", F.sum(F.col("title").isNotNull().cast("int")).over(Window.partitionBy(doc_id).orderBy("line_no")))
    body = F.array_sort(F.collect_list(F.when(F.col("title").isNull(), F.struct("line_no", "line"))))
    out = rows.groupBy(doc_id, "ord").agg(F.coalesce(F.max("title"), F.lit("")).alias("title"), F.count("*").alias("n_lines"), F.array_join(F.transform(body, lambda x: x["line"]), "\n").alias("content"))
    return out.withColumns({"ord": F.col("ord").cast("int"), "content": F.trim("content")}).where("ord > 0 or content <> ''")


def pdf_text(data: bytes) -> str:
    """Pages between form feeds, lines from top to bottom; ``operators.layout`` tells columns, tables and chapters apart."""
    from lexmill.sources.pdf import page_spans

    pages: dict[int, dict[int, list[tuple[float, str]]]] = {}
    for page, _, x0, _, y, _, _, text, *_ in page_spans(data):
        pages.setdefault(page, {}).setdefault(round(y / 3), []).append((x0, text.strip()))
    return "\f".join("\n".join(" ".join(t for _, t in sorted(line)) for _, line in sorted(pages.get(k, {}).items())) for k in range(max(pages, default=-1) + 1))


PARSERS |= {
    "docx": document_text,
    "pptx": zipped_xml_text(r"ppt/slides/slide\d+\.xml", ("p",)),
    "xlsx": lambda b: "\n".join("\t".join(cells) for _, _, cells in sheet_rows(b)),
    "idml": zipped_xml_text(r"Stories/.*\.xml", ("Content",)),
    "dita": xml_text,
    "xlf": lambda b: xml_text(b, ("source",)),
    "pdf": pdf_text,
}


def parse_files(files: DataFrame, parsers: dict[str, Parser] | None = None) -> DataFrame:
    """path, type, text and error of binary files (path, content); unknown types are errors, not failures."""
    known = parsers or PARSERS

    def one(kind: str | None, data: bytes) -> tuple[str | None, str | None]:
        if kind not in known:
            return None, "unknown file type"
        try:
            return known[kind](bytes(data)), None
        except Exception as e:
            return None, f"{type(e).__name__}: {e}"

    @F.pandas_udf("text string, error string")
    def run(kinds: pd.Series, contents: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(k, c) for k, c in zip(kinds, contents, strict=True)], columns=["text", "error"])

    rows = files.withColumn("type", file_type(F.col("path")))
    return rows.select("path", "type", run("type", "content").alias("p")).select("path", "type", "p.*")


def markdown_sections(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ord, level, title, content): a section for each heading, one of level 0 before the first."""
    from pyspark.sql import Window

    rows = docs.select(doc_id, F.posexplode(X.lines(F.col(text))).alias("ord", "line"))
    level = F.length(F.regexp_extract("line", r"^(#{1,6})\s+\S", 1))
    rows = rows.withColumn("level", level).withColumn("section", F.sum((F.col("level") > 0).cast("int")).over(Window.partitionBy(doc_id).orderBy("ord")))
    body = F.array_sort(F.collect_list(F.when(F.col("level") == 0, F.struct("ord", "line"))))
    out = rows.groupBy(doc_id, "section").agg(F.max("level").alias("level"), F.max(F.when(F.col("level") > 0, F.trim(F.regexp_replace("line", r"^#+\s+|\s*#*\s*$", "")))).alias("title"), F.array_join(F.transform(body, lambda x: x["line"]), "\n").alias("content"))
    return out.select(doc_id, F.col("section").cast("int").alias("ord"), "level", F.coalesce("title", F.lit("")).alias("title"), F.trim("content").alias("content")).where("level > 0 or content <> ''")


SOURCE_NAMES = ("source", "source_text", "src", "original", "en", "english")
TARGET_NAMES = ("target", "translation", "translated_text", "tgt", "de", "german", "fr", "french", "zh", "chinese")


def memory_entries(table: DataFrame, source: str | None = None, target: str | None = None, order: str | None = None) -> DataFrame:
    """(entry_ord, source_text, translated_text) of a table whose columns are named, or recognised by name or as a language.

    Rows without either text go. entry_ord is the column ``order``; without one, entries are
    numbered as Spark reads them, which is the order of the file only while it is one split.
    """
    lower = {c.lower().strip().replace(" ", "_"): c for c in table.columns}
    spoken = [c for c in table.columns if re.sub(r"[\s_-]+", "", c.lower()) in X.HEADER_LANGUAGES]
    source = source or next((lower[n] for n in SOURCE_NAMES if n in lower), None) or next(iter(spoken), None)
    target = target or next((lower[n] for n in TARGET_NAMES if n in lower and lower[n] != source), None) or next((c for c in spoken if c != source), None)
    if not source or not target:
        raise ValueError(f"no source and target column among {table.columns}")
    number = F.col(order) if order else F.monotonically_increasing_id()
    rows = table.select(number.alias("entry_ord"), F.trim(F.col(source)).alias("source_text"), F.trim(F.col(target)).alias("translated_text"))
    return rows.where("source_text <> '' and translated_text <> ''")


def workbook_entries(files: DataFrame) -> DataFrame:
    """Entries of workbooks whose first rows name a source and a target column, in order of rows, sheet by sheet."""
    from pyspark.sql import Window

    rows = workbook_rows(files)
    w = Window.partitionBy("path", "sheet").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    names = F.transform(F.first("cells").over(w), lambda c: F.lower(F.regexp_replace(F.trim(c), r"[\s_-]+", "")))
    known = lambda xs: F.array(*(F.lit(x.replace("_", "")) for x in xs))
    rows = rows.withColumns({"_n": F.row_number().over(w.rowsBetween(Window.unboundedPreceding, 0)), "_h": names})
    first = lambda xs: F.coalesce(F.array_min(F.filter(F.transform(known(xs), lambda n: F.array_position("_h", n)), lambda p: p > 0)), F.lit(0)).cast("int")
    rows = rows.withColumns({"_s": first(SOURCE_NAMES), "_t": first(TARGET_NAMES)}).where("_n > 1 and _s > 0 and _t > 0")
    out = rows.select("path", "sheet", "row", F.trim(F.try_element_at("cells", F.col("_s"))).alias("source_text"), F.trim(F.try_element_at("cells", F.col("_t"))).alias("translated_text"))
    return out.where("source_text <> '' and translated_text <> ''")


def memory_file(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a CSV, TSV or JSON memory."""
    if path.endswith(".json"):
        return memory_entries(spark.read.option("multiLine", "true").json(path))
    return memory_entries(spark.read.option("header", "true").option("sep", "\t" if path.endswith(".tsv") else ",").option("multiLine", "true").option("escape", '"').csv(path))


def terminology(docs: DataFrame, text: str = "text") -> DataFrame:
    """(bad, good) of two-column pipe tables; header and rule lines and equal pairs go."""
    rows = docs.select(F.posexplode(X.lines(F.col(text))).alias("ord", "line")).where(F.col("line").rlike(r"^\s*\|.*\|.*\|"))
    bad, good = (F.trim(F.regexp_extract("line", r"^\s*\|([^|]*)\|([^|]*)\|", k)) for k in (1, 2))
    rows = rows.select("ord", bad.alias("bad"), good.alias("good")).where("bad <> '' and good <> '' and bad <> good")
    return rows.where(~F.col("bad").rlike(r"^[-: ]+$")).groupBy("bad").agg(F.min_by("good", "ord").alias("good"))


def annotations(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, number, file, page, body) of ``## n. file · page p`` blocks."""
    blocks = F.slice(F.split(F.concat(F.lit("\n"), X.text_of(F.col(text))), r"\n## "), 2, 1_000_000)
    rows = docs.select(doc_id, F.explode(blocks).alias("block"))
    head = r"^(\d+)\.\s*(.+?)\s*·\s*\D*(\d+)"
    out = rows.select(doc_id, *(F.regexp_extract("block", head, k).alias(n) for k, n in ((1, "number"), (2, "file"), (3, "page"))), F.trim(F.regexp_replace("block", r"^[^\n]*\n?", "")).alias("body"))
    return out.where("number <> ''").withColumns({"number": F.col("number").cast("int"), "page": F.col("page").cast("int")})
