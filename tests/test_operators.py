"""Operators on literal rows: cases of the reference's kinds, invariants, readers, sinks and streams."""

import datetime as dt
import io
import itertools
import random
import zipfile
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.functions import text as X
from lexmill.operators import cat, compare, evaluation, grammar, issues, matching, memory, params, proofing, providers, quality, relational, review, segments, stats, templates
from lexmill.sources import readers, sinks
from lexmill.streaming import logs


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    ("text", "function", "want"),
    [
        ("  a \n b ", X.collapsed, "a b"),
        (None, X.collapsed, ""),
        (" A b\tC ", X.compact, "abc"),
        ("Föö-1, b!", X.letters_digits, "föö1b"),
        ("One two, THREE", X.tokens, ["one", "two", "three"]),
        ("Guide v1.2.3 English final", lambda c: X.without_metadata(c, ("english", "final")), "guide"),
        ("don't re-check 中文 a1", X.text_units, 5),
        ("press key k12 version 2.0.1 now", X.translatable_units, 3),
        ("Hi. You there?\nYes", X.sentences, ["Hi.", "You there?", "Yes"]),
        ("abcab", X.char_ngrams, ["ab", "bc", "ca"]),
        ("a", X.char_ngrams, ["a"]),
        ("", X.char_ngrams, []),
        ('{"start": 7}', X.span_start, 7),
        ("12-30", X.span_start, 12),
        ("nonsense", X.span_start, 0),
        ("one. two", X.unit_kind, "sentence"),
        ("one two", X.unit_kind, "term"),
        (None, X.unit_kind, "empty"),
        ("ﬁne Ａ", proofing.nfkc, "fine A"),
        ("Ｈi，there。", proofing.aggressive, "ｈi,there"),
        ("5mm and 3kg", proofing.spaced_units, "5 mm and 3 kg"),
        ("中A1文", proofing.spaced_scripts, "中 A1 文"),
        ("a, b; cc", lambda c: proofing.clauses(c), ["cc"]),
    ],
)
def test_text_functions(spark, text, function, want):
    assert one(spark, text, function) == want


def test_similarities(spark):
    row = spark.createDataFrame([(["a", "b", "c"], ["b", "c", "d", "e"])], "a array<string>, b array<string>").select(X.jaccard(F.col("a"), F.col("b")), X.jaccard(F.col("b"), F.col("a")), X.overlap(F.col("a"), F.col("b"))).first()
    assert row[0] == row[1] == pytest.approx(2 / 5) and row[2] == pytest.approx(2 / 4)
    row = spark.createDataFrame([("kitten", "sitting", "x" * 20)], "a string, b string, c string").select(X.edit_similarity(F.col("a"), F.col("b")), X.edit_similarity(F.col("a"), F.col("c")), matching.lcs_ratio("a", "b"), matching.ratio("a", "b")).first()
    assert row[0] == pytest.approx(1 - 3 / 7) and row[1] == 0 and row[2] == pytest.approx(4 / 7) and row[3] == pytest.approx(2 * 4 / 13)


def test_language_and_json(spark):
    hints, marks = {"en": ("the",), "fr": ("les",)}, {"fr": "[é]"}
    for text, want in (("the les les é", "fr"), ("", "en"), ("한국어 글", "ko"), ("中文字", "zh")):
        assert one(spark, text, lambda c: X.language_by_script(c, hints, marks)) == want
    assert one(spark, '```json\n{"a": 1}\n```', lambda c: X.json_or(c, "a int", F.struct(F.lit(0).alias("a"))))["a"] == 1
    assert one(spark, None, lambda c: X.json_or(c, "a int", F.struct(F.lit(0).alias("a"))))["a"] == 0


@pytest.mark.parametrize("period", stats.PERIODS)
def test_periods_are_whole_and_apart(period):
    a, b, c, d = stats.period_bounds(period, dt.date(2024, 3, 13))
    assert c < d <= a < b and (period == "this_month" and d == a or b - a <= dt.timedelta(days=30))


def test_relational(spark):
    rows = spark.createDataFrame([("s", 1, "user", "q1"), ("s", 2, "user", "q2"), ("s", 3, "bot", "a1"), ("s", 4, "user", "q3"), ("z", 1, "bot", "a")], "s string, t long, r string, x string")
    got = relational.next_event(rows, "s", "t", "r", "user", "bot", ["x"]).orderBy("t").collect()
    assert [(r["x"], r["next_x"]) for r in got] == [("q1", "a1"), ("q2", "a1"), ("q3", None)]
    assert relational.filtered(rows, s="s", r=None, t=[1, 4]).count() == 2
    a, b = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3)], "k string, i long"), spark.createDataFrame([("x", 9)], "k string, i long")
    assert [tuple(r) for r in relational.multiset_match(a, b, "k", "i", "i").collect()] == [("x", 1, 9)]
    status = {r["k"]: r["status"] for r in relational.compare_by_key(a.where("i <> 2"), b.withColumn("i", F.lit(1).cast("long")), ["k"], "i").collect()}
    assert status == {"x": "same", "y": "only_a"}
    tree = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "e"), ("e", "d")], "node string, parent string")
    assert {r["path"] for r in relational.subtree(tree, F.col("node").isin("a", "d")).collect()} == {"a", "a/b", "a/b/c", "d", "d/e"}
    assert relational.unseen(spark.createDataFrame([(None, 1), (1, 1)], "k int, v int"), spark.createDataFrame([(None,)], "k int"), ["k"]).count() == 1


def test_consensus_of_two_models(spark):
    a = spark.createDataFrame([("R1", "Word", 82, "m1")], "rule string, original string, confidence int, model string")
    b = spark.createDataFrame([("r1", "word", 90, "m2"), ("r2", "w", 70, "m2")], a.schema)
    got = {r["rule"]: r for r in relational.merge_by_key(a, b, ["rule", "original"], "confidence").collect()}
    assert got["r1"]["models"] == ["m1", "m2"] and got["r1"]["consensus"] == 98 and got["r2"]["consensus"] == 70


def test_latest_feedback_counts_once(spark):
    rows = spark.createDataFrame([("d1", 1, 1, 4), ("d1", 2, 3, 4), ("d2", 1, 2, 5)], "doc string, at int, accuracy int, processed int")
    last = stats.latest_per_key(rows, "doc", ["at"], ["accuracy", "processed"]).withColumn("g", F.lit(1))
    r = stats.clamped_mean(last, "g", "accuracy", "processed").first()
    assert r["submissions"] == 2 and r["mean_accuracy"] == 57.5


def test_segments(spark):
    docs = spark.createDataFrame([(1, "Head one\nbody\nmore text\nHead two\nend."), (2, "")], "doc_id long, text string")
    assert segments.joined_lines(segments.lines(docs)).orderBy("doc_id").collect()[0]["text"] == docs.first()["text"]
    got = segments.with_running_heading(segments.lines(docs), F.col("content").startswith("Head")).where("doc_id = 1").orderBy("line_number").collect()
    assert [r["chapter"] for r in got] == ["Head one"] * 3 + ["Head two"] * 2
    tree = spark.createDataFrame([(1, k + 1, v) for k, v in enumerate((1, 2, 3, 2, 1, 3))], "doc_id long, ord int, level int")
    assert [r["parent"] for r in segments.nearest_parent(tree).orderBy("ord").collect()] == [None, 1, 2, 1, None, 5]
    pages = spark.createDataFrame([(1, p, n, c) for p in (1, 2, 3) for n, c in enumerate(("Title", f"text {p}", f"more {p}", f"and {p}", "x", f"y{p}", "Foot"))], "doc_id long, page_num int, line_number int, content string")
    assert {r["content"] for r in segments.repeated_edge_lines(pages).collect()} == {"Title", "Foot", "x"}
    cells = spark.createDataFrame([(1, 1, "a"), (1, 2, " "), (1, 3, "b")], "d int, o int, c string")
    assert [r["c"] for r in segments.filled_down(cells, "c", "d", "o").orderBy("o").collect()] == ["a", "a", "b"]


def test_issue_cases(spark):
    schema = "doc_id long, rule string, category string, severity string, source string, original_text string, suggestion string, confidence int, chapter string, nth int"
    rows = [
        (1, "P", "punct", "general", "rule", "！", "!", 95, "c", 0),
        (1, "S", "spelling", "serious", "spellcheck", "teh", "the", 96, "c", 0),
        (1, "S", "spelling", "serious", "spellcheck", "teh", "the", 90, "c", 1),
        (1, "L", "style", "suggestion", "ai", "foo bar", "bar foo", 60, "c", 0),
        (1, "A", "security", "serious", "ai", "default password", "change", 90, "c", 0),
        (1, "B", "security", "serious", "rule", "default password", "change", 90, "c", 1),
    ]
    got = issues.select_issues(spark.createDataFrame(rows, schema), issues.Scoring(), {"credential": "password"}, shadowed=["credential"]).collect()
    assert sorted((r["rule"], r["confidence"]) for r in got) == [("B", 90), ("S", 96)]
    assert all(0 <= r["score"] <= 100 for r in got)
    assert [r["rule"] for r in issues.ordered(spark.createDataFrame(rows, schema).withColumn("score", issues.value_score(issues.Scoring()))).collect()][:2] == ["A", "B"]


def test_spans_keep_offsets(spark):
    docs = spark.createDataFrame([(1, "é aa b aaa"), (2, None)], "doc_id long, text string")
    got = issues.detect_spans(docs, [issues.Rule("r", "a+")]).orderBy("start").collect()
    assert [(r["start"], r["end"], r["original_text"]) for r in got] == [(2, 4, "aa"), (7, 10, "aaa")]
    assert issues.replaced_terms(docs, {"aa": "zz"}).collect()[0]["n"] == 1


def test_every_reason_of_rejection(spark):
    content = "the red pump must be started by the user of thatin use 5 ml of it in the morning click the icon der Hund mark the names of"
    rows = [
        ("", "x", "d", "missing_original_text"),
        ("red pump", "", "", "missing_suggestion_and_description"),
        ("red pump", "x", "no change needed", "explicit_no_change"),
        ("red pump", "x", "as the style guide says", "audit_basis_leak"),
        ("blue pump", "x", "d", "original_text_not_found"),
        ("ed pump", "x", "d", "truncated_word_fragment"),
        ("red pump", "<b>Red</b>, pump!", "d", "noop_suggestion"),
        ("use 5 ml", "use it 5ml", "d", "number_unit_spacing_regression"),
        ("use 5 ml", "use 6 ml", "d", "protected_meaning_changed"),
        ("user of thatin", "user of thitan", "d", "protected_meaning_changed"),
        ("must be started by the user", "will need somebody who begins", "d", "aggressive_rewrite"),
        ("the names of", "the names of all persons", "d", "speculative_completion"),
        ("mark the names of", "mark the names in", "button label", "low_value_ui_bracket_labeling"),
        ("click the icon", "click this icon", "missing icon", "visual_control_ambiguity"),
        ("der hund mark the names", "die hund mark the names", "d", "low_value_cn_term_swap"),
        ("in the morning", "in a morning", "d", "low_value_english_rewrite"),
        ("red pump", "red pumps", "d", "accepted"),
    ]
    table = spark.createDataFrame([(k, *r[:3], content) for k, r in enumerate(rows)], "k int, original_text string, suggestion string, description string, content string").selectExpr("*", "'' rule", "'' category", "'' chapter", "'' audit_basis")
    checks = review.Checks(no_change="no change needed", basis="style guide", protected=(("thatin", "thitan"),), fillers=("in", "a"), dangling=r"\bof$", label_report="button label", label_text="^mark", control_report="missing icon", control_text="^click", swaps=(("der", "die"),))
    got = {r["k"]: r["reason"] for r in review.checked(table, checks).collect()}
    assert [got[k] for k in range(len(rows))] == [r[3] for r in rows]
    assert {r[3] for r in rows} == {*review.REASONS, "accepted"}
    other = review.checked(table.selectExpr("*", "'rule' source"), checks)
    assert other.where("not accepted").count() == 0


def sentences_of(seed, n):
    r = random.Random(seed)
    base = ["".join(r.choice("abcdefgh ") for _ in range(r.randint(5, 30))) for _ in range(n // 2)]
    changed = lambda t: "".join(r.choice("abc") if r.random() < 0.15 else c for c in t)
    return base + [changed(t) for t in base] + ["", "a"]


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        left = 0
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], left + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@pytest.mark.parametrize("lanes", [256, 20])
def test_bounds_of_a_ratio(monkeypatch, lanes):
    monkeypatch.setattr(matching, "LANES", lanes)
    monkeypatch.setattr(matching, "TOGETHER", 50)
    r = random.Random(4)
    text = lambda: "".join(r.choice("abcdeü😀 ") for _ in range(r.choice([0, 1, 5, 63, 64, 65, 129, 200])))
    a, b = [text() for _ in range(20)], [text() for _ in range(25)]
    i, j = (x.ravel() for x in np.indices((20, 25)))
    assert matching.common_in_order(a, b, i, j).tolist() == [plain_lcs(a[p], b[q]) for p, q in zip(i, j, strict=True)]
    letters = [[sum(min(x.count(c), y.count(c)) for c in set(x)) for y in b] for x in a]
    assert matching.common_letters(a, b).tolist() == letters


@pytest.mark.parametrize("seed", range(4))
def test_names_that_may_be_alike(seed):
    r = random.Random(seed)
    name = lambda: "".join(r.choice("aAbBcß ") for _ in range(r.randint(0, 18)))
    a, b = [name() for _ in range(60)], [name() for _ in range(60)]
    want = {(i, j): s for i, x in enumerate(a) for j, y in enumerate(b) if (s := max(params.name_likeness(x, y), SequenceMatcher(None, x, y).ratio())) >= 0.7}
    found = {(i, j): s for i, j, s in matching.near(a, b, 0.7, params.name_likeness, params.name_may)}
    assert found == {k: pytest.approx(v) for k, v in want.items()}
    assert all(max(len(a[i]), len(b[j])) <= params.name_factor(0.7) * min(len(a[i]), len(b[j])) for i, j in want)


@pytest.mark.parametrize("least", [0.5, 0.8])
def test_alike_finds_every_pair(spark, monkeypatch, least):
    monkeypatch.setattr(matching, "CHUNK", 7)
    a, b = sentences_of(1, 30), sentences_of(2, 20) + sentences_of(1, 10)
    table = lambda xs: spark.createDataFrame([(k % 2, k, t) for k, t in enumerate(xs)] + [(5, 0, "only here")], "b int, idx int, text string")
    got = {(r["a_idx"], r["b_idx"]): r["score"] for r in matching.alike(table(a), table(b).where("b < 5"), "b", least).collect()}
    want = {(i, j): SequenceMatcher(None, x, y).ratio() for i, x in enumerate(a) for j, y in enumerate(b) if i % 2 == j % 2}
    assert got == {k: pytest.approx(v) for k, v in want.items() if v >= least}


def plain_greedy(pairs):
    used, out = set(), set()
    for s, i, j in sorted(((-s, i, j) for i, j, s in pairs)):
        if ("a", i) not in used and ("b", j) not in used:
            used |= {("a", i), ("b", j)}
            out.add((i, j))
    return out


@pytest.mark.parametrize("group", [1 << 14, 7])
@pytest.mark.parametrize("digits", [2, 0])
def test_greedy_in_rounds(spark, monkeypatch, group, digits):
    monkeypatch.setattr(matching, "GROUP", group)
    r = random.Random(9)
    pairs = [(i, j, round(r.random(), digits)) for i in range(25) for j in range(25) if r.random() < 0.08]
    rows = spark.createDataFrame([("k", *p) for p in pairs] + [("other", 0, 0, 0.5)], "b string, a_idx long, b_idx long, score double")
    got = {(p["a_idx"], p["b_idx"]) for p in matching.greedy(rows, "b").where("b = 'k'").collect()}
    assert got == plain_greedy(pairs)


def test_chapters_first(spark):
    a, b = sentences_of(3, 20), sentences_of(3, 20)[::-1]
    table = lambda xs, n: spark.createDataFrame([(1, k, t, None if k % n == 0 else f"c{k % n}") for k, t in enumerate(xs)], "p int, idx int, text string, chapter string")
    x, y = table(a, 3), table(b, 4)
    got = {(r["a_idx"], r["b_idx"]) for r in matching.by_chapter(x, y, "p", "chapter", 0.6).collect()}
    exact, left_a, left_b = set(), set(range(len(a))), set(range(len(b)))
    for t in dict.fromkeys(a):
        i, j = [k for k in sorted(left_a) if a[k] == t], [k for k in sorted(left_b) if b[k] == t]
        exact |= set(zip(i, j, strict=False))
    left_a, left_b = left_a - {i for i, _ in exact}, left_b - {j for _, j in exact}
    ratio = lambda i, j: SequenceMatcher(None, a[i], b[j]).ratio()
    chapter = lambda k, n: 0 if k % n == 0 else k % n
    same = set()
    for c in range(4):
        same |= plain_greedy([(i, j, ratio(i, j)) for i in left_a for j in left_b if chapter(i, 3) == c == chapter(j, 4) and ratio(i, j) >= 0.6])
    left_a, left_b = left_a - {i for i, _ in same}, left_b - {j for _, j in same}
    assert got == exact | same | plain_greedy([(i, j, ratio(i, j)) for i in left_a for j in left_b if ratio(i, j) >= 0.6])


def test_likeness_of_names():
    assert params.name_likeness("Rated Power", "rated power") == 1.0
    assert params.name_likeness("voltage", "voltags") == pytest.approx(1 - 1 / 7)
    assert params.name_likeness("working temperature", "working pressure range") == pytest.approx(0.60 + 0.25 * 8 / 22)
    assert params.name_likeness("abc", "xyz") == 0.0


def test_sentence_windows(spark):
    docs = spark.createDataFrame([(1, "if cold, wait, when hot, if dry, add water; stop, if")], "doc_id int, text string")
    got = [r["window"] for r in grammar.sentence_windows(docs, "^(?:if|when)").orderBy("idx").collect()]
    assert got == ["if cold, wait", "when hot, if dry", "add water", "stop", "if"]


def test_ranked_entries(spark):
    rows = [(1, "Open the lid now", 1, "Open the lid", "t1"), (1, "Open the lid now", 2, "Open the lid now!", "t2"), (1, "Open the lid now", 3, "Shut", "t3"), (2, "Turn it off", 4, "Turn it of", "t4")]
    pairs = spark.createDataFrame(rows, "query_id int, text string, entry_ord int, source_text string, translated_text string")
    got = {r["query_id"]: (r["entry_ord"], r["translated"], r["similarity"]) for r in memory.ranked(pairs).collect()}
    assert got[1] == (2, "t2", 1.0) and got[2][:2] == (4, "t4") and 0.9 < got[2][2] < 1


def test_similarity_of_sentences(spark):
    pairs = [("open the lid, then wait", "open the lid, then wait"), ("open the lid", "open the lid and wait for it"), ("abc", "xyz"), ("", "x")]
    rows = spark.createDataFrame(pairs, "a string, b string").withColumns({"l": matching.lcs_ratio("a", "b"), "c": matching.longest_common("a", "b"), "i": matching.indel_ratio("a", "b")})
    got = rows.select(cat.sentence_similarity(F.col("a"), F.col("b"), F.col("l"), F.col("c")).alias("s"), "c", "i").collect()
    assert got[0]["s"] == 1.0 and got[1]["s"] > 0.8 and got[2]["s"] == 0.0 and got[3]["s"] == 0.0
    assert [r["c"] for r in got] == [23, 12, 0, 0] and got[1]["i"] == pytest.approx(2 * 12 / (12 + 28)) and got[2]["i"] == 0.0


def zipped(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in members.items():
            z.writestr(name, body)
    return bytearray(out.getvalue())


def test_workbooks_maps_and_comments(spark):
    book = zipped(
        {
            "xl/workbook.xml": '<w xmlns:r="r"><sheets><sheet name="S1" r:id="i1"/></sheets></w>',
            "xl/_rels/workbook.xml.rels": '<R><Relationship Id="i1" Target="worksheets/sheet1.xml"/></R>',
            "xl/sharedStrings.xml": "<sst><si><t>Source</t></si><si><t>target</t></si><si><t>lid</t></si></sst>",
            "xl/worksheets/sheet1.xml": '<s><d><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="2"><c r="A2" t="s"><v>2</v></c><c r="B2"><v>4.5</v></c><c r="C2" t="inlineStr"><is><t>Deckel</t></is></c></row></d></s>',
        }
    )
    word = zipped({"word/document.xml": "<d><p><t>One</t></p><tbl><tr><tc><p><t>a</t></p></tc><tc><p><t>b</t></p></tc></tr></tbl></d>", "word/comments.xml": '<c xmlns:w="w"><comment w:author="Al" w:date="2024"><p><t>why</t></p></comment></c>'})
    ditamap = bytearray(b'<map><topicref href="a.dita" navtitle="A"><topicref href="b.dita"><topicmeta><navtitle>B</navtitle></topicmeta></topicref></topicref></map>')
    files = spark.createDataFrame([("m.xlsx", book), ("w.docx", word), ("x.ditamap", ditamap), ("bad.xlsx", bytearray(b"no"))], "path string, content binary")
    assert [(r["row"], list(r["cells"])) for r in readers.workbook_rows(files.where("path like '%.xlsx'")).orderBy("row").collect()] == [(1, ["Source", "", "target"]), (2, ["lid", "4.5", "Deckel"])]
    assert [(r["source_text"], r["translated_text"]) for r in readers.workbook_entries(files).collect()] == [("lid", "Deckel")]
    assert [tuple(r) for r in readers.comments(files).collect()] == [("w.docx", "Al", "2024", "why")]
    assert [(r["href"], list(r["way"])) for r in readers.topics(files).orderBy("ord").collect()] == [("a.dita", ["A"]), ("b.dita", ["A", "B"])]
    text = {r["path"]: r["text"] for r in readers.parse_files(files).collect()}
    assert text["w.docx"] == "One\n| a | b |" and text["m.xlsx"] == "Source\t\ttarget\nlid\t4.5\tDeckel"


def test_packages_terms_and_seeds(spark):
    package = zipped({"p/m.ditamap": '<map><topicref href="a.dita" navtitle="A"/><topicref href="sub/b.dita#x" navtitle="B"/><topicref href="none.dita"/></map>', "p/a.dita": "<topic><title>One</title></topic>", "p/sub/b.dita": "<topic><p>Two</p></topic>"})
    files = spark.createDataFrame([("x/k.zip", package), ("bad.zip", bytearray(b"no"))], "path string, content binary")
    got = [tuple(r) for r in readers.package_topics(files).orderBy("ord").collect()]
    assert [(g[0], g[2], g[3], g[5]) for g in got] == [("x/k.zip", "p/a.dita", "A", "One"), ("x/k.zip", "p/sub/b.dita", "B", "Two"), ("x/k.zip", "p/none.dita", "", None)]
    sheet = '<s><d><row r="1"><c r="A1" t="inlineStr"><is><t>bad</t></is></c></row>' + "".join(f'<row r="{k}"><c r="A{k}" t="inlineStr"><is><t>{a}</t></is></c><c r="B{k}" t="inlineStr"><is><t>{b}</t></is></c></row>' for k, (a, b) in enumerate([("colour", "color"), ("colour", "other"), ("same", "same")], 2)) + "</d></s>"
    book = zipped({"xl/workbook.xml": '<w xmlns:r="r"><sheets><sheet name="S" r:id="i"/></sheets></w>', "xl/_rels/workbook.xml.rels": '<R><Relationship Id="i" Target="/xl/worksheets/s.xml"/></R>', "xl/worksheets/s.xml": sheet})
    assert [tuple(r) for r in readers.workbook_terms(spark.createDataFrame([("t.xlsx", book)], "path string, content binary")).collect()] == [("colour", "color")]
    assert [r["rule_no"] for r in readers.seed_rules(spark.createDataFrame([(7,), (None,)], "id int")).collect()] == ["EXT-7"]


def test_archives_of_topic_files(spark, tmp_path):
    sections = spark.createDataFrame([(1, 0, 1, "T <1>", "a\n\nb & c"), (1, 1, 2, "U", "d")], "doc_id int, ord int, level int, title string, content string")
    made = {r["path"]: r["content"] for r in sinks.topic_files(sections, kind="dita").collect()}
    assert made["t1_0.dita"] == '<topic id="t1_0"><title>T &lt;1&gt;</title><body><p>a</p><p>b &amp; c</p></body></topic>'
    assert sinks.topic_files(sections, kind="md").collect()[1]["content"] == "## U\n\nd\n"
    sinks.write_archives(sinks.topic_files(sections).select(F.lit("one").alias("archive"), "*"), f"{tmp_path}/z")
    (row,) = spark.read.parquet(f"{tmp_path}/z").collect()
    assert zipfile.ZipFile(io.BytesIO(bytes(row["content"]))).namelist() == ["t1_0.md", "t1_1.md"]


def test_cache_state_ends(spark, tmp_path):
    rows = [("a", dt.datetime(2024, 1, 1, 0, 0, 0)), ("a", dt.datetime(2024, 1, 1, 0, 0, 8)), ("a", dt.datetime(2024, 1, 1, 0, 0, 30)), ("b", dt.datetime(2024, 1, 1, 0, 0, 31))]
    schema = "key string, ts timestamp"
    got = run_stream(spark, rows, schema, f"{tmp_path}/c", lambda s: logs.cache_hits_stream(s, "ts", "key", 10))
    assert sorted((r["key"], r["ts"].second, r["hit"]) for r in got) == [("a", 0, False), ("a", 8, True), ("a", 30, False), ("b", 31, False)]
    batch = logs.cache_hits(spark.createDataFrame(rows, schema), "ts", "key", "10 SECONDS").orderBy("ts").collect()
    assert [r["hit"] for r in batch] == [False, True, False, False]


@pytest.mark.parametrize("seed", range(40))
def test_assignment_is_optimal(seed):
    r = np.random.default_rng(seed)
    gain = np.round(r.random((r.integers(1, 6), r.integers(1, 6))), 2)
    n, m = gain.shape
    gain[gain < 0.2] = 0  # pairs that are not there; the best sum over all pairs may use them for nothing
    best = max(sum(gain[i, j] for i, j in zip(rows, cols, strict=True)) for rows in itertools.combinations(range(n), min(n, m)) for cols in itertools.permutations(range(m), min(n, m)))
    a, b = np.nonzero(gain)
    chosen = matching.assignment(n, a, b, gain[a, b])
    assert len({a[k] for k in chosen}) == len({b[k] for k in chosen}) == len(chosen)
    assert sum(gain[a[k], b[k]] for k in chosen) == pytest.approx(best)


def dense_best_sum(gain):
    """Shortest augmenting paths over a whole matrix, row by row, as a reference for larger cases."""
    n, m = gain.shape
    if n > m:
        return dense_best_sum(gain.T)
    cost, u, v, mate = -gain, np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        mate[0], j0, least, used, way = i, 0, np.full(m + 1, np.inf), np.zeros(m + 1, bool), np.zeros(m + 1, int)
        while mate[j0]:
            used[j0] = True
            i0, delta, j1 = mate[j0], np.inf, 0
            for j in range(1, m + 1):
                if not used[j]:
                    c = cost[i0 - 1, j - 1] - u[i0] - v[j]
                    if c < least[j]:
                        least[j], way[j] = c, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            u[mate[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
        while j0:
            mate[j0], j0 = mate[way[j0]], way[j0]
    return sum(gain[mate[j] - 1, j - 1] for j in range(1, m + 1) if mate[j])


@pytest.mark.parametrize("seed", range(12))
def test_assignment_of_larger_sparse_graphs(seed):
    r = np.random.default_rng(seed)
    gain = np.round(r.random((r.integers(20, 60), r.integers(20, 60))), 1 + seed % 3) * (r.random() < 0.7)
    gain = np.where(np.random.default_rng(seed + 99).random(gain.shape) < 0.15, gain, 0)
    a, b = np.nonzero(gain)
    chosen = matching.assignment(gain.shape[0], a, b, gain[a, b])
    assert len({a[k] for k in chosen}) == len({b[k] for k in chosen}) == len(chosen)
    assert sum(gain[a[k], b[k]] for k in chosen) == pytest.approx(dense_best_sum(gain))


def test_greedy_and_optimal(spark):
    pairs = spark.createDataFrame([("k", 1, 1, 0.9), ("k", 1, 2, 0.8), ("k", 2, 1, 0.8), ("k", 3, 3, 0.5)], "b string, a_idx long, b_idx long, score double")
    assert sorted((r["a_idx"], r["b_idx"]) for r in matching.greedy(pairs, "b").collect()) == [(1, 1), (3, 3)]
    assert sorted((r["a_idx"], r["b_idx"]) for r in matching.optimal(pairs, "b").collect()) == [(1, 2), (2, 1), (3, 3)]


def test_candidates_lose_no_pair(spark):
    r = random.Random(2)
    texts = ["".join(r.choice("abcde") for _ in range(r.randint(4, 14))) for _ in range(60)]
    texts += [t[:3] + r.choice("abcde") + t[4:] for t in texts[:20]]
    a = spark.createDataFrame([(0, k, t) for k, t in enumerate(texts[:40])], "b int, idx long, text string")
    b = spark.createDataFrame([(0, k, t) for k, t in enumerate(texts[40:])], "b int, idx long, text string")
    grams = lambda t: {t[k : k + 3] for k in range(max(1, len(t) - 2))}
    want = {(i, j) for i, x in enumerate(texts[:40]) for j, y in enumerate(texts[40:]) if min(len(x), len(y)) >= 0.4 * max(len(x), len(y)) and len(grams(x) & grams(y)) >= 0.3 * len(grams(x) | grams(y))}
    assert {(p["a_idx"], p["b_idx"]) for p in matching.candidates(a, b, "b").collect()} == want


def test_memory_cases(spark):
    bank = spark.createDataFrame([(1, "Open the lid", "t1"), (2, "Open the lid slowly", "t2"), (3, "Guide v1.2.0 English", "t3")], "entry_ord long, source_text string, translated_text string")
    asked = spark.createDataFrame([(1, "open  THE lid"), (2, "open-the-lid!"), (3, "Guide"), (4, "Please open the lid slowly now"), (5, "zzz"), (6, "")], "query_id long, text string")
    got = {r["query_id"]: (r["reason"], r["translated"]) for r in memory.exact_tiers(asked, bank).collect()}
    assert got == {1: ("normalized_exact", "t1"), 2: ("compact_exact", "t1"), 3: ("metadata_exact", "t3"), 4: (None, None), 5: (None, None), 6: (None, None)}
    assert {r["query_id"]: r["translated"] for r in memory.contained(asked, bank).collect()}[4] == "t2"
    near = memory.fuzzy_tail(spark.createDataFrame([(9, "Open the lid slowli")], "query_id long, text string"), bank).first()
    assert near["entry_ord"] == 2 and near["score"] > 0.9
    assert memory.with_precedence([bank, bank]).count() == 3


def test_parameters(spark):
    docs = spark.createDataFrame([(1, "Voltage (V): 5\n| Weight | 3 kg |\n|---|---|\nno pair"), (2, None)], "doc_id long, text string")
    rows = params.extract(docs).select(F.lit("k").alias("k"), "ord", "name", "value")
    assert [(r["name"], r["value"]) for r in rows.orderBy("ord").collect()] == [("Voltage (V)", "5"), ("Weight", "3 kg")]
    other = spark.createDataFrame([("k", 1, "voltage", "5"), ("k", 2, "Weights", "4 kg"), ("k", 3, "Colour", "red")], "k string, ord int, name string, value string")
    got = {(r["name_a"], r["name_b"]): r["status"] for r in params.compare(rows, other, "k").collect()}
    assert got == {("Voltage (V)", "voltage"): "same", ("Weight", "Weights"): "different", (None, "Colour"): "only_b"}


def test_comparison_of_documents(spark):
    a = spark.createDataFrame([(1, "The pump is on. Set 5 bar now. Gone here entirely.")], "k long, text string")
    b = spark.createDataFrame([(1, "The pump is on. Set 6 bar now. Wholly other words follow.")], "k long, text string")
    r = compare.compare_documents(a, b, "k").first()
    assert (r["pairs"], r["modified"], r["deleted"], r["added"]) == (2, 1, 1, 1)
    left, right = compare.segments(a, "k"), compare.segments(b, "k")
    kinds = {(d["type"], d["severity"]) for d in compare.differences(left, right, matching.with_exact(left, right, "k", 0.8), "k").collect()}
    assert ("modified", "high") in kinds and {k for k, _ in kinds} == {"modified", "deleted", "added"}
    same = compare.compare_documents(a, a, "k").first()
    assert same["fuzzy"] == 1 and same["verdict"] == "same"


def test_rules_fold_in_order(spark):
    docs = spark.createDataFrame([(1, "a b ("), (2, None)], "doc_id long, text string")
    r = proofing.rewritten(docs, [proofing.Rewrite(1, "b", "c", 1), proofing.Rewrite(2, "a", "b", 5), proofing.Rewrite(3, "(", "[", 0), proofing.Rewrite(4, "c", None, 0)]).orderBy("doc_id").collect()
    assert r[0]["text"] == "c c [" and [(x["rule_id"], x["n"]) for x in r[0]["applied"]] == [(2, 1), (1, 2), (3, 1), (4, 2)] and r[1]["text"] == ""


def test_spelling(spark):
    docs = spark.createDataFrame([(1, "The qick fox Acme acme")], "doc_id long, text string")
    words = lambda *w: spark.createDataFrame([(x,) for x in w], "word string")
    got = proofing.unknown_words(docs, words("the", "quick", "fox"), words("Acme"))
    assert {r["word"] for r in got.collect()} == {"qick", "acme"}
    assert [r["suggestion"] for r in proofing.corrections(got.where("word = 'qick'"), words("quick", "thick", "quiche")).collect()] == ["quick"]
    assert {r["phrase"] for r in proofing.wrong_articles(spark.createDataFrame([(1, "an book, a apple, an hour, a unit")], "doc_id long, text string")).collect()} == {"an book", "a apple"}


def test_quality_and_templates(spark):
    docs = spark.createDataFrame([(1, "Short words here. All is good."), (2, None)], "doc_id long, text string")
    got = quality.readability(docs).orderBy("doc_id").collect()
    assert got[0]["level"] == "excellent" and got[1]["overall"] == 100 and got[1]["sentences"] == 0
    s = spark.createDataFrame([(1, "Click the start button before you open the lid"), (2, "Press 5 keys now")], "idx long, text string")
    t = spark.createDataFrame([(1, "Before you open the lid, click the start button"), (2, "Press 7 keys now"), (3, "Press 5 keys now")], "idx long, text string")
    rows = {(r["sentence_id"], r["template_id"]): r for r in templates.candidates(s, t).collect()}
    assert rows[2, 3]["tier"] == "exact" and rows[2, 2]["reasons"] == ["numbers"] and rows[1, 1]["score"] > 0.5
    sizes = spark.createDataFrame([(1, k, n) for k, n in enumerate((5, 5, 9, 30, 1))], "k int, o int, n int")
    assert [r["bin"] for r in templates.bins(sizes, "k", "o", "n", most_items=2, most_size=12).orderBy("o").collect()] == [0, 0, 1, 2, 3]
    guide = spark.createDataFrame([(1, "# Use\n- Press the green key.\n| Close the lid gently. | short |\ntext")], "doc_id long, text string")
    assert {(r["chapter"], r["text"]) for r in templates.guide_templates(guide).collect()} == {("Use", "Press the green key."), ("Use", "Close the lid gently.")}
    words = spark.createDataFrame([(1, 9, 0, 10, "b"), (1, 0, 1, 10, "a"), (1, 0, 20, 10, "c")], "page int, x int, y int, height int, word string")
    assert [r["text"] for r in templates.image_lines(words).orderBy("line").collect()] == ["a b", "c"]


def test_evaluation(spark):
    gold = spark.createDataFrame([(1, 1, "Wrong Text", "", None), (1, 2, "absent", "", "R9")], "doc_id long, gold_id long, selected string, comment string, rule string")
    found = spark.createDataFrame([(1, "R1", "wrong", "R1 wrong text here")], "doc_id long, rule string, original_text string, blob string")
    assert {r["gold_id"]: r["found"] for r in evaluation.gold_hits(gold, found, "doc_id").collect()} == {1: True, 2: False}
    rows = spark.createDataFrame([("a", True, True), ("a", True, False), ("a", False, True)], "g string, t boolean, p boolean")
    r = evaluation.scores(rows, ["g"], F.col("t"), F.col("p")).first()
    assert (r["tp"], r["fp"], r["fn"], r["hit_precision"], r["f1"]) == (1, 1, 1, 50.0, 50.0)


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("grün".encode())
    (tmp_path / "b.txt").write_bytes("中文".encode("gb18030"))
    got = {r["path"].rpartition("/")[2]: r["text"] for r in readers.text_files(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "grün", "b.txt": "中文"}
    docx = io.BytesIO()
    with zipfile.ZipFile(docx, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="w"><w:p><w:t>Hello</w:t> <w:t>there</w:t></w:p></w:document>')
    files = spark.createDataFrame([("x/a.docx", bytearray(docx.getvalue())), ("b.md", bytearray(b"# T")), ("c.bin", bytearray(b"")), ("d.docx", bytearray(b"broken")), ("e.xlf", bytearray(b"<x><source>s1</source><target>t</target></x>"))], "path string, content binary")
    got = {r["path"]: (r["text"], r["error"]) for r in readers.parse_files(files).collect()}
    assert got["x/a.docx"] == ("Hello there", None) and got["b.md"] == ("# T", None) and got["c.bin"][1] == "unknown file type" and "BadZipFile" in got["d.docx"][1] and got["e.xlf"][0] == "s1"
    md = spark.createDataFrame([(1, "intro\n# A\nx\n## B #\ny\nz")], "doc_id long, text string")
    assert [(r["level"], r["title"], r["content"]) for r in readers.markdown_sections(md).orderBy("ord").collect()] == [(0, "", "intro"), (1, "A", "x"), (2, "B", "y\nz")]
    (tmp_path / "m.csv").write_text('Source,Target\n"a, b",c\n,d\n')
    assert [tuple(r)[1:] for r in readers.memory_file(spark, str(tmp_path / "m.csv")).collect()] == [("a, b", "c")]
    terms = spark.createDataFrame([("| Bad | Good |\n|---|---|\n| e-mail | email |",)], "text string")
    assert ("e-mail", "email") in {tuple(r) for r in readers.terminology(terms).collect()}
    notes = spark.createDataFrame([(1, "x\n## 1. a.pdf · page 12\nbody\n## 2. b.pdf · 第 3 页\n")], "doc_id long, text string")
    assert [(r["number"], r["file"], r["page"], r["body"]) for r in readers.annotations(notes).orderBy("number").collect()] == [(1, "a.pdf", 12, "body"), (2, "b.pdf", 3, "")]
    page = spark.createDataFrame([("u", "<title>T</title><style>p</style><p>A&amp;B<p>c")], "url string, html string")
    assert tuple(readers.html_pages(page).first()) == ("u", "T", "A&B\nc")


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    rows.write.parquet(f"{tmp_path}/t")
    sinks.append_unseen(spark.createDataFrame([(2, "x"), (3, "c"), (3, "c")], rows.schema), f"{tmp_path}/t", ["k"])
    assert sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/t").collect()) == [(1, "a"), (2, "b"), (3, "c")]
    assert sorted(tuple(r) for r in sinks.upserted(rows, spark.createDataFrame([(2, "x")], rows.schema), ["k"]).collect()) == [(1, "a"), (2, "x")]
    plan = {r["k"]: r["action"] for r in sinks.import_plan(rows, spark.createDataFrame([(1, "a"), (2, "x"), (3, "n")], rows.schema), "k", ["v"]).collect()}
    assert plan == {1: "skipped", 2: "updated", 3: "created"}
    listed = rows.withColumn("tags", F.array("v", F.lit("z")))
    sinks.export(listed, f"{tmp_path}/c", "csv")
    sinks.export(listed, f"{tmp_path}/j")
    assert {r["tags"] for r in spark.read.option("header", "true").csv(f"{tmp_path}/c").collect()} == {"a|z", "b|z"}
    assert spark.read.json(f"{tmp_path}/j").count() == 2


def test_providers(spark):
    class Broken:
        name = "broken"

        def answer(self, prompts):
            raise RuntimeError

    rows = spark.createDataFrame([(1, "x\nFirst. Second."), (2, None)], "i int, t string")
    got = {r["i"]: (r["answer"], r["provider"]) for r in providers.answered(rows, F.col("t"), (Broken, providers.Echo)).collect()}
    assert got == {1: ("First", "fallback"), 2: ("", "fallback")}


def run_stream(spark, rows, schema, path, make, mode="append"):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    name = "out_" + str(abs(hash(path)))
    q = make(spark.readStream.schema(schema).parquet(path)).writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


def test_streams(spark, tmp_path):
    t = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    schema = "ts timestamp, user long, kind string, value double"
    rows = [(t(1), 1, "a", 1.0), (t(1, 5), 1, "a", 2.0), (t(1, 30), 2, "b", 5.0), (t(3), 1, "a", 1.0)]
    got = run_stream(spark, rows, schema, f"{tmp_path}/1", lambda s: logs.windowed_usage(s, "ts", "kind", "value", "1 hour"), "complete")
    assert {(r["start"].hour, r["kind"], r["calls"], r["total"]) for r in got} == {(1, "a", 2, 3.0), (1, "b", 1, 5.0), (3, "a", 1, 1.0)}
    got = run_stream(spark, rows, schema, f"{tmp_path}/2", lambda s: logs.first_reports(s, "ts", ["user", "kind"], "5 hours"))
    assert len(got) == 2
    got = run_stream(spark, rows, schema, f"{tmp_path}/3", lambda s: logs.windowed_hits(s, "ts", F.col("value") >= 2, "1 day"), "complete")
    assert [(r["n"], r["hits"], r["hit_rate"]) for r in got] == [(4, 2, 50.0)]
    got = run_stream(spark, rows, schema, f"{tmp_path}/4", lambda s: logs.answered_within(s.where("kind = 'a'"), s.where("kind = 'b'").withColumn("user", F.lit(1).cast("long")), "user", "ts"))
    assert len(got) == 2


@pytest.mark.parametrize("group", [1 << 14, 5])
def test_optimal_by_component_equals_the_whole_matrix(spark, monkeypatch, group):
    monkeypatch.setattr(matching, "GROUP", group)
    r = random.Random(5)
    rows = [("k", i, j, round(r.random(), 3) + 0.01) for i in range(14) for j in range(14) if r.random() < 0.12]
    gain = np.zeros((14, 14))
    for _, i, j, s in rows:
        gain[i, j] = s
    got = matching.optimal(spark.createDataFrame(rows, "b string, a_idx long, b_idx long, score double"), "b").collect()
    assert len({p["a_idx"] for p in got}) == len({p["b_idx"] for p in got}) == len(got)
    assert sum(p["score"] for p in got) == pytest.approx(dense_best_sum(gain))


def test_lines_greedy_compare_takes_every_turn_and_the_next_but_one(spark):
    from lexmill.plans import all_queries

    sf = "/root/testdata/sf0.001"
    turns = spark.read.parquet(f"{sf}/conversations.parquet").where("trim(text) <> ''").select("conv_id", "turn").distinct().collect()
    seen = {(r["conv_id"], r["turn"]) for r in turns}
    got = {(r["conv_id"], r["turn"]) for r in all_queries().QUERIES["lines_greedy_compare"](spark, sf).collect()}
    assert got <= {(c, k) for c, k in seen if (c, k + 2) in seen} and {k for _, k in got} > {0}


def test_gold_assignment_finds_passages_in_documents_of_any_label(spark):
    from lexmill.plans import all_queries
    from lexmill.plans.registry import NTH

    sf = "/root/testdata/sf0.001"
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1").collect()}
    known = {r["doc_id"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r["item_id"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    rows = all_queries().QUERIES["gold_assignment"](spark, sf).collect()
    found = {r["b_idx"] // NTH for r in rows}
    assert found <= known and found - toxic and {r["a_idx"] // NTH for r in rows} <= items
    assert len({r["a_idx"] for r in rows}) == len({r["b_idx"] for r in rows}) == len(rows) > len(items) / 2
