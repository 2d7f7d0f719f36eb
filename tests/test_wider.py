"""Rule tables, checkers by pieces, character diffs, merged boxes, topic maps and table functions."""

import io
import random
import time
import zipfile

import pytest
import regex
from pyspark.sql import functions as F

from lexmill.functions import tables
from lexmill.operators import layout, matching, providers, ruletable, topics
from lexmill.sources import readers, sinks


@pytest.mark.parametrize("seed", range(30))
def test_edit_scripts_are_shortest_and_apply(seed):
    r = random.Random(seed)
    a, b = ("".join(r.choice("abü😀 ") for _ in range(r.randint(0, 30))) for _ in range(2))
    runs = matching.edit_script(a, b)
    assert "".join(t for tag, t in runs if tag != "insert") == a and "".join(t for tag, t in runs if tag != "delete") == b
    row = [0] * (len(b) + 1)
    for x in a:
        left = 0
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], left + 1 if x == y else max(row[j], row[j - 1])
    assert sum(len(t) for tag, t in runs if tag == "equal") == row[-1]
    assert all(t for _, t in runs) and all(x != y for (x, _), (y, _) in zip(runs, runs[1:], strict=False))


def test_edit_script_of_long_texts():
    r = random.Random(1)
    a = "".join(r.choice("abcdefgh ") for _ in range(20_000))
    b = "".join(r.choice("xyz") if r.random() < 0.1 else c for c in a if r.random() > 0.05)
    began = time.process_time()
    runs = matching.edit_script(a, b)
    assert time.process_time() - began < 5
    assert "".join(t for tag, t in runs if tag != "insert") == a and "".join(t for tag, t in runs if tag != "delete") == b


def test_marked_diff(spark):
    rows = spark.createDataFrame([("the pump runs", "a pump ran"), (None, "x"), ("same", "same"), ("", None)], "a string, b string")
    got = [r[0] for r in rows.select(matching.marked(matching.char_diff("a", "b"))).collect()]
    assert got[1:] == ["{+x+}", "same", ""]
    assert got[0].replace("[-", "").replace("-]", "").replace("{+", "").replace("+}", "") != "" and "pump r" in got[0]


PATTERNS = [
    ("lit", r"\bvalve\b", False), ("case", r"\bPump\b", True), ("any", r"[!?]{2,}", False), ("alt", r"(?:red|green) light", False), ("opt", r"colou?r", False), ("rep", r"(?:ab)+c", False), ("look", r"(?<=x)y+", False),
    ("flag", r"(?i)straße", False), ("back", r"\b(\w+) \1\b", False), ("dotted", r"\p{Lu}{3,}", False), ("long s", "mess", True), ("empty", r"z*", False), ("class", r"[0-9]+ (?:mm|cm)", False),
    ("twice", "the the", False), ("over", "abab", False), ("part", "alv", False), ("begins", r"\bval", False), ("ends", r"lve\b", False), ("mark", r"\b!!", False), ("mark end", r"!!\b", False), ("not i", r"(?i)VALVE", False), ("odd", "😀", False), ("a b", r"\bthe the\b", False),
]


def test_rule_table_equals_single_patterns(spark):
    r = random.Random(3)
    words = ["valve", "VALVE", "pump", "PUMP", "red light", "green light", "blue light", "color", "colour", "ababc", "xyy", "Straße", "STRASSE", "the the", "the the the the", "abababab", "x!!x", "!!", "ABCD", "meſſ", "5 mm", "77 cm", "!!", "?!", "zz", "İ", "😀"]
    texts = [None, "", *(" ".join(r.choice(words) for _ in range(r.randint(1, 12))) for _ in range(150))]
    more = [(f"w{k}", rf"\b{w}{k % 90}\b", False) for k in range(5000) for w in ["part"]]
    texts += ["part17 part4 part89 part5000"]
    rules = spark.createDataFrame([(*p, "c" + p[0][0]) for p in PATTERNS + more] + [(None, "x", False, "c"), ("none", None, False, "c"), ("blank", "", False, "c")], "rule string, pattern string, ignore_case boolean, category string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((x["doc_id"], x["rule"], x["start"], x["end"], x["original_text"], x["category"]) for x in ruletable.hits(docs, rules).collect())
    want = sorted((d, n, m.start(), m.end(), m[0], "c" + n[0]) for d, t in enumerate(texts) if t for n, p, i in PATTERNS + more for m in regex.finditer(p, t, regex.IGNORECASE if i else 0) if m[0])
    assert got == want
    assert ruletable.hits(docs, rules.limit(0)).count() == 0


def test_rule_table_in_several_passes(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "alpha beta gamma"), (2, "beta")], "doc_id long, text string")
    rules = ruletable.word_rules(spark.createDataFrame([(w,) for w in ("alpha", "beta", "gamma", "de.lta")], "word string"), "word")
    whole = sorted(map(tuple, ruletable.hits(docs, rules).collect()))
    monkeypatch.setattr(ruletable, "PASS", 10)
    assert sorted(map(tuple, ruletable.hits(docs, rules).collect())) == whole and len(whole) == 4


def test_literals():
    assert ruletable.literal(r"\bpump\b") == ("pump", True, True) and ruletable.literal(r"a\.b") == ("a.b", False, False) and ruletable.literal(r"\bé") == ("é", True, False)
    assert [ruletable.literal(p) for p in (r"(?i)a", "a|b", "a?", r"\b", "^a", r"\B1", "[", "[ab]")] == [None] * 8


def test_needles():
    assert ruletable.needles(r"\bpump\b") == ["pump"]
    assert ruletable.needles(r"(?:red|green) li") == [" li"] or ruletable.needles(r"(?:red|green) li") == ["red", "green"]
    assert ruletable.needles(r"a|") is None and ruletable.needles(r"x*") is None and ruletable.needles(r"\p{Lu}+[") is None
    assert ruletable.needles(r"(?:abc)+d?") == ["abc"]


@pytest.mark.parametrize("size", [15, 60, 2000])
def test_checkers_by_pieces_find_what_the_whole_text_has(spark, size):
    r = random.Random(5)
    sentence = lambda: " ".join(r.choice(["pump", "the the", "valve", "ünder", "😀", "run"]) for _ in range(r.randint(1, 2))) + r.choice([".", "!!", "?!", ".\n"])
    texts = [None, "", "x" * 500, *(" ".join(sentence() for _ in range(r.randint(1, 15))) for _ in range(25))]
    texts += texts[5:8]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pieces = providers.chunked(docs, "text", size, ["doc_id"]).orderBy("doc_id", "chunk").collect()
    for d, t in enumerate(texts):
        own = [p for p in pieces if p["doc_id"] == d]
        assert "".join(p["text"] for p in own) == (t or "") and [p["offset"] for p in own] == [sum(len(q["text"]) for q in own[:k]) for k in range(len(own))]
        assert all(len(p["text"]) <= size or " " not in p["text"].strip() for p in own)
    got = {tuple(x) for x in providers.checked(docs, size=size).collect()}
    marks = {(d, s, e, m, t[s:e]) for d, t in enumerate(texts) if t for s, e, m in providers.Repeats().check([t])[0] if m == "repeated mark"}
    assert {g for g in got if g[3] == "repeated mark"} == marks
    if size == 2000:
        assert got == {(d, s, e, m, t[s:e]) for d, t in enumerate(texts) if t for s, e, m in providers.Repeats().check([t])[0]}


def plain_merge(boxes):
    kept = []
    for b in sorted(boxes, key=lambda b: (-b["confidence"], b["variant"], b["top"], b["left"], b["text"], b["width"], b["height"])):
        same = b["text"].replace(" ", "").lower()

        def clash(k):
            w = min(b["left"] + b["width"], k["left"] + k["width"]) - max(b["left"], k["left"])
            h = min(b["top"] + b["height"], k["top"] + k["height"]) - max(b["top"], k["top"])
            if same and same == k["text"].replace(" ", "").lower():
                return True
            one, other = b["width"] * b["height"], k["width"] * k["height"]
            return w > 0 and h > 0 and (w * h >= 0.55 * (one + other - w * h) or w * h >= 0.7 * min(one, other))

        if not any(clash(k) for k in kept):
            kept.append(b)
    return sorted((b["top"], b["left"], b["text"], b["variant"]) for b in kept)


@pytest.mark.parametrize("seed", range(3))
def test_merged_boxes(spark, seed):
    r = random.Random(seed)
    names = ["image", "variant", "left", "top", "width", "height", "text", "confidence"]
    rows = [("i%d" % r.randrange(3), r.randrange(3), r.randrange(0, 300), r.randrange(0, 200), r.randrange(5, 120), r.randrange(5, 60), r.choice(["", " ", *(f"w{k}" for k in range(40))]), r.randrange(40, 99)) for _ in range(160)]
    got = layout.merged_boxes(spark.createDataFrame(rows, "image string, variant int, left int, top int, width int, height int, text string, confidence int"), ["image"]).collect()
    for image in ("i0", "i1", "i2"):
        want = plain_merge([dict(zip(names, x, strict=True)) for x in rows if x[0] == image])
        assert sorted((g["top"], g["left"], g["text"], g["variant"]) for g in got if g["image"] == image) == want
        own = sorted((g for g in got if g["image"] == image), key=lambda g: g["n"])
        assert [(g["top"], g["left"]) for g in own] == sorted((g["top"], g["left"]) for g in own)


def test_topic_packages_round_trip(spark, tmp_path):
    levels = [0, 1, 2, 3, 2, 4, 1, 3, 3, 2]
    rows = [(d, k, level, f'T{d} <{k}> & "x"', f"text {k}") for d in (1, 2) for k, level in enumerate(levels if d == 1 else [2, 1, 1])]
    sections = spark.createDataFrame(rows, "doc_id long, ord int, level int, title string, content string")
    tree = {(r["doc_id"], r["ord"]): r for r in topics.topic_tree(sections).collect()}
    for d in (1, 2):
        above: list[tuple[int, int]] = []
        for _, k, level, *_ in (x for x in rows if x[0] == d):
            above = [a for a in above if a[0] < level] if level else []
            way = [a[1] for a in above]
            if level:
                above.append((level, k))
            assert tree[d, k]["way"] == way and tree[d, k]["depth"] == len(way) and tree[d, k]["parent"] == (way[-1] if way else None)
    sinks.write_archives(topics.topic_package(sections), str(tmp_path / "a"), "archive")
    files = spark.read.parquet(str(tmp_path / "a")).select(F.concat("archive", F.lit(".zip")).alias("path"), "content")
    got = readers.package_topics(files).collect()
    assert len(got) == len(rows)
    for g in got:
        d, k = (int(x) for x in g["member"][1:].removesuffix(".dita").split("_"))
        titles = [f'T{d} <{w}> & "x"' for w in tree[d, k]["way"]] + [f'T{d} <{k}> & "x"']
        assert g["way"] == titles and g["ord"] == k and f"text {k}" in g["text"]
    with zipfile.ZipFile(io.BytesIO(bytes(files.where("path = '2.zip'").first()["content"]))) as z:
        assert z.read("map.ditamap").decode().count("<topicref") == 3


def test_functions_of_sql(spark):
    tables.register(spark)
    spark.createDataFrame([(1, "a1 b22"), (2, None), (3, "none"), (4, "ü7. Next one. x")], "id long, text string").createOrReplaceTempView("some_texts")
    got = [tuple(r) for r in spark.sql("SELECT id, s.* FROM some_texts, LATERAL text_spans(text, '[0-9]+') s ORDER BY id, nth").collect()]
    assert got == [(1, 0, 1, 2, "1"), (1, 1, 4, 6, "22"), (4, 0, 1, 2, "7")]
    assert [tuple(r) for r in spark.sql("SELECT s.start, s.span FROM some_texts, LATERAL sentence_spans(text, 5) s WHERE id = 4").collect()] == [(4, "Next one.")]
    assert spark.sql("SELECT similarity('abcd', 'bcde')").first()[0] == pytest.approx(0.75)


@pytest.mark.parametrize("seed", range(2))
def test_aligned_in_order(spark, seed):
    from difflib import SequenceMatcher

    r = random.Random(seed)
    text = lambda: "".join(r.choice("abc ") for _ in range(r.randint(1, 9)))
    a, b = [(k % 3, k, text()) for k in range(30)], [(k % 3, k, text()) for k in range(24)]
    got = sorted((x["b"], x["a_idx"], x["b_idx"], round(x["score"], 9), x["label"]) for x in matching.aligned_in_order(spark.createDataFrame(a, "b int, idx int, text string"), spark.createDataFrame(b, "b int, idx int, text string"), "b").collect())
    want, used = [], set()
    for block, i, x in a:
        scores = [(SequenceMatcher(None, x, y).ratio(), -j) for k, j, y in b if k == block and j not in used]
        s, j = max(scores, default=(0, 0))
        if s > 0.5:
            used.add(-j)
            want.append((block, i, -j, round(s, 9), "exact" if s > 0.9 else "fuzzy"))
    assert got == sorted(want)


def test_word_diff_applies(spark):
    r = random.Random(4)
    text = lambda: " ".join(r.choice(["a", "b", "c", "d"]) for _ in range(r.randint(0, 12)))
    rows = [(text(), text()) for _ in range(40)] + [(None, "x y"), ("x", None)]
    for x in spark.createDataFrame(rows, "a string, b string").select("a", "b", matching.word_diff("a", "b").alias("d")).collect():
        assert " ".join(s["a"] for s in x["d"] if s["a"]) == (x["a"] or "") and " ".join(s["b"] for s in x["d"] if s["b"]) == (x["b"] or "")
        assert all((s["tag"] == "equal") == (s["a"] == s["b"]) for s in x["d"])


def test_nearest_entries_and_the_fuzzy_step(spark):
    from difflib import SequenceMatcher

    from lexmill.operators import memory

    r = random.Random(6)
    entries = ["".join(r.choice("abcdef ") for _ in range(r.randint(5, 30))) for _ in range(40)]
    asked = [e[:3] + r.choice("xyz") + e[4:] for e in entries[:15]] + ["".join(r.choice("uvw") for _ in range(12)), "", entries[3]]
    bank = spark.createDataFrame([(k, e, f"t{k}") for k, e in enumerate(entries)], "entry_ord long, source_text string, translated_text string")
    rows = spark.createDataFrame(list(enumerate(asked)), "query_id long, text string")
    got = {x["query_id"]: (x["entry_ord"], x["score"], x["translated"]) for x in memory.nearest(rows, bank, 0.7).collect()}
    want = {}
    for q, t in enumerate(asked):
        best = max((SequenceMatcher(None, t, e).ratio(), -k) for k, e in enumerate(entries))
        if best[0] >= 0.7:
            want[q] = (-best[1], best[0], f"t{-best[1]}")
    assert got == want and len(want) >= 14
    said = {x["query_id"]: (x["attempt"], x["translated"]) for x in memory.translated(rows, bank, fuzzy=memory.nearest(rows, bank, 0.7)).collect()}
    assert said[len(asked) - 1] == ("exact", "t3") and said[0][0] == "fuzzy" and said[0][1] == got[0][2]


def test_scratch_of_two_threads(spark):
    import os
    import threading

    from lexmill.operators import spread

    folder = spread.shared_dir(spark).removeprefix("file://")
    left: dict[int, list] = {}

    def run(k):
        with spread.scratch(spark):
            mine = spread.cut(spark.range(50), f"thread{k}")
            gate.wait()
            left[k] = [mine.count(), mine]
            gate.wait()

    gate = threading.Barrier(2)
    threads = [threading.Thread(target=run, args=(k,)) for k in (1, 2)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert [left[k][0] for k in (1, 2)] == [50, 50]
    assert not [f for f in os.listdir(folder) if "-thread" in f]
    kept = spread.cut(spark.range(3), "three-rows")
    assert [f for f in os.listdir(folder) if "-three-rows-" in f]
    spread.discard(kept, None)
    assert not [f for f in os.listdir(folder) if "-three-rows-" in f]


def test_simple_lookup_by_rounds_equals_all_pairs(spark):
    import random

    from lexmill.operators import memory

    r = random.Random(8)
    letters = ["abcdefgh", "hijklmno", "opqrstuv", "xyz XYZ", "abcdefghijklmnopqrstuvwxyz "]
    text = lambda: "".join(r.choices(r.choice(letters), k=r.randint(1, 60)))
    bank = [(k * 7 - 300, text(), f"t{k}") for k in range(400)] + [(-5000, "x" * 30, "far"), (2501, None, "none"), (None, "y" * 30, "no place")]
    asked = [(k, text()) for k in range(200)] + [(3, text()), (900, "x" * 31), (901, None), (None, text()), (902, f"  {bank[7][1]} "), (903, "q" * 40), (904, "y" * 30)]

    def near(q, s):
        a, b = (q, s) if len(q) < len(s) else (s, q)
        return sum(c in b for c in a) / len(b) > 0.7

    def answer(i):
        texts = [q for k, q in asked if k == i and q is not None]
        known = [e for e in bank if e[0] is not None and e[1] is not None]
        exact = [e for e in bank if e[1] is not None and any(q.strip(" ") == e[1].strip(" ") for q in texts)]
        close = [e for e in known if any(len(q) > 20 and near(q, e[1]) for q in texts)]
        return min(exact, key=lambda e: e[0] if e[0] is not None else 10**9)[2] if any(e[0] is not None for e in exact) else max(close)[2] if close else None

    want = sorted(((i, answer(i)) if i is not None else (None, None) for i, _ in asked), key=str)
    q, m = spark.createDataFrame(asked, "query_id long, text string"), spark.createDataFrame(bank, "entry_ord long, source_text string, translated_text string")
    for latest in (3, 50, 1000):
        assert sorted(map(tuple, memory.simple_lookup(q, m, latest=latest).collect()), key=str) == want
    assert {r["translated"] for r in memory.simple_lookup(q, m.where("false")).collect()} == {None}
