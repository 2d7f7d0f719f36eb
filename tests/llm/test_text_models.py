import itertools
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexmill.llm import ctw, language, toxicity
from lexmill.llm._common import train_remainder
from lexmill.llm.extraction import default_model, extract_pages
from lexmill.llm.html_blocks import blocks
from lexmill.llm.html_labelled import labelled_pages
from tests.llm.helpers import empty_docs, odd_docs, odd_rows, with_clashes

SF = "/root/testdata/sf0.001"


def plain_profile(texts, depth):
    counts = Counter()
    for t in texts:
        counts.update(plain_grams(t))
    return [g for g, _ in sorted(counts.items(), key=lambda kv: (-kv[1], code(kv[0])))[:depth]]


def code(g):
    n = 0
    for c in g:
        n = n << 21 | (1 if c == " " else ord(c))
    return n


def plain_grams(text):
    s = " " + " ".join(re.findall(r"[^\W\d_]+", text.lower())) + " "
    s = "".join(c if c.isalpha() else " " for c in s)
    out = []
    for k, c in enumerate(s):
        if c != " ":
            out.append(c)
        if k + 1 < len(s) and s[k : k + 2].strip():
            out.append(s[k : k + 2])
        if k + 2 < len(s) and s[k + 1] != " ":
            out.append(s[k : k + 3])
    return out


def test_language_equals_the_plain_rule(spark):
    docs = [(1, "the cat and the dog sat there", "en"), (2, "le chat et le chien sont là", "fr"), (3, "the end of the day", "en"), (4, "la fin du jour", "fr"), (5, None, "en"), (6, "no label", None)]
    train = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    depth = 30
    profiles = language.learn(train, depth=depth)
    want = {name: [code(g) for g in plain_profile([t for _, t, x in docs if x == name and t], depth)] for name in ("en", "fr")}
    for k, name in enumerate(profiles.names):
        ranks = profiles.ranks[:-1, k]
        order = profiles.codes[np.argsort(np.where(ranks < 0, 10**9, ranks), kind="stable")][: len(want[name])]
        assert order.tolist() == want[name]
    for text in ("the dog", "le chien", "zzz"):
        mine = [code(g) for g in plain_profile([text], depth)]
        away = {n: sum(abs(want[n].index(g) - k) if g in want[n] else depth for k, g in enumerate(mine)) for n in want}
        best = min(sorted(away), key=lambda n: away[n])
        got = profiles.predict(text)
        assert got[0] == best and got[1] == pytest.approx(max(0, 1 - away[best] / (depth * len(mine))))


def test_language_of_odd_rows(spark):
    docs = with_clashes(odd_docs(spark), "lang_pred", "score", "found")
    got = {r["doc_id"]: r for r in language.identify(docs, language.learn(docs)).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (1, 2, 3, 9))
    assert all(0 <= r["score"] <= 1 for r in got.values())
    nothing = language.learn(empty_docs(spark))
    assert language.identify(empty_docs(spark), nothing).count() == 0
    assert {r["lang_pred"] for r in language.identify(docs, nothing).collect()} == {"und"}


def test_long_texts_are_counted_in_pieces(monkeypatch):
    text = " ".join(t for _, t, *_ in odd_rows() if t and len(t) < 20_000) * 3
    whole = [x.tolist() for x in language.counted([text])]
    monkeypatch.setattr(language, "CHUNK", 100)
    parts = list(language.pieces(text))
    assert len(parts) > 100 and "".join(parts) == text
    assert [x.tolist() for x in language.counted(parts)] == whole
    assert list(language.pieces("a" * 500)) == ["a" * 500] and list(language.pieces("")) == [""]


def test_language_held_out_accuracy(spark):
    from lexmill.llm.queries import op4_language

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = op4_language(spark, SF).join(docs.select("doc_id", "lang"), "doc_id")
    held = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert held[0] > 0.97 and 20 < held[1] < 100
    assert got.where(F.col("held_out") != (train_remainder("doc_id", 4) == 2)).count() == 0


def test_folding():
    assert " idiot " in toxicity.folded("you 1diot i1diot idi0t")
    assert " trash " in toxicity.folded("tr@sh") and " fool " in toxicity.folded("ｆ０ol".replace("０", "o"))
    assert " scum " in toxicity.folded("ѕсum") and " loser " in toxicity.folded("lo​ser")
    assert toxicity.folded(None) == "  " and toxicity.folded("123 $$$") == "  "


def test_lexicon_and_exceptions():
    lexicon = toxicity.Lexicon({" fool": 2.0, " foolish ": 3.0}, [" foolproof ", " april fool "])
    a = lexicon.automaton()
    found = lambda t: sorted(w for _, _, w in toxicity.hits(toxicity.folded(t), a))
    assert found("a fool") == [2.0] and found("foolish fools") == [2.0, 3.0]
    assert found("foolproof") == [] and found("April fool, fool") == [2.0] and found("buffoon") == []
    assert toxicity.hits(" fool ", toxicity.Lexicon({}).automaton()) == []


def plain_hits(text, weights, exceptions):
    """Every entry looked for at every place, every match held against every exception."""
    spared = [(k, k + len(e)) for e in exceptions for k in range(len(text)) if text.startswith(e, k)]
    out = []
    for k in range(len(text)):
        here = [(w, len(e)) for e, w in weights.items() if text.startswith(e, k)]
        if here:
            w = max(x for x, _ in here)
            ends = {k + n for x, n in here if x == w}
            if not any(a <= k and e <= b for a, b in spared for e in ends):
                out.append((k, w))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_matches_against_a_plain_search(seed):
    r = random.Random(seed)
    letters = lambda n: "".join(r.choice("ab") for _ in range(n))
    weights = {f" {letters(r.randint(1, 4))}" + r.choice(["", " "]): round(r.random(), 6) for _ in range(12)}
    exceptions = sorted({f" {letters(r.randint(1, 4))} " + r.choice(["", f"{letters(2)} "]) for _ in range(8)})
    a = toxicity.Lexicon(weights, exceptions).automaton()
    for _ in range(60):
        text = toxicity.folded(" ".join(letters(r.randint(1, 6)) for _ in range(r.randint(0, 30))))
        assert sorted((s, w) for s, _, w in toxicity.hits(text, a)) == plain_hits(text, weights, exceptions if len(weights) else [])


def test_exceptions_that_spare_nothing_more_go():
    weights = {" bad": 1.0, " vile ": 2.0}
    a = toxicity.Lexicon(weights).automaton()
    every = {" badge ", " badge shop ", " old badge ", " bad day ", " vile badge ", " badly ", " badly badge "}
    kept = toxicity.needed(every, a)
    assert kept == [" bad day ", " badge ", " badly ", " vile badge "]
    few, all_ = (toxicity.Lexicon(weights, sorted(x)).automaton() for x in (kept, every))
    r = random.Random(2)
    for _ in range(300):
        text = toxicity.folded(" ".join(r.choice(["badge", "shop", "old", "bad", "day", "vile", "badly", "x"]) for _ in range(12)))
        assert toxicity.hits(text, few) == toxicity.hits(text, all_)


def test_matching_is_linear():
    import time

    a = toxicity.Lexicon({" bad": 1.0}, [" bad day "]).automaton()
    text = " bad day bad" * 200_000 + " "
    began = time.process_time()
    assert len(toxicity.hits(text, a)) == 200_000 and time.process_time() - began < 20


def test_toxicity_learns_words_and_spares_clean_ones(spark):
    r = random.Random(3)
    vocabulary = ["".join(r.choice("abcdeghi") for _ in range(5)) for _ in range(200)]
    docs, labels = [], []
    for k in range(400):
        w = [r.choice(vocabulary) for _ in range(40)]
        toxic = k % 5 == 0
        if toxic:
            w[r.randrange(30)], w[35] = "nastyword", "vile" + r.choice(["er", "st"])
        elif k % 7 == 0:
            w[3] = "nastywordless"
        docs.append((k, " ".join(w)))
        labels.append((k, int(toxic)))
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    lexicon = toxicity.learn(docs.where("doc_id < 300"), labels)
    assert any("nastyw".startswith(e.strip()[:6]) for e in lexicon.weights)
    got = toxicity.score_toxicity(with_clashes(docs, "score", "predicted"), lexicon).join(labels, "doc_id").where("doc_id >= 300").collect()
    assert all(0 <= x["score"] <= 1 for x in got)
    assert sum(x["predicted"] == x["toxic"] for x in got) / len(got) > 0.97
    assert toxicity.matches(docs, lexicon).count() > 0


def test_toxicity_of_odd_rows(spark):
    nothing = toxicity.learn(odd_docs(spark), spark.createDataFrame([(1, 1)], "doc_id long, toxic int"))
    assert nothing.weights == {}
    got = toxicity.score_toxicity(with_clashes(odd_docs(spark), "score"), nothing).collect()
    assert len(got) == len(odd_rows()) and {x["predicted"] for x in got} == {0}
    assert toxicity.score_toxicity(empty_docs(spark), nothing).count() == 0


def test_toxicity_held_out(spark):
    from lexmill.llm.queries import op9_toxicity

    sf = "/root/testdata/sf0.1"
    rows = op9_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    hit = ((rows.toxic == 1) & (rows.predicted == 1)).sum()
    assert hit / (rows.toxic == 1).sum() > 0.85 and hit / (rows.predicted == 1).sum() > 0.9


def test_blocks():
    page = "<title>t</title><nav><a href=x>Home</a></nav><p>a &amp; b<br>c &#233;<p>two<script>var x='</p>'</script><div>d<span> e</span></div><!-- no --> tail<li>x<li>y"
    assert [(b.text, b.tag) for b in blocks(page)] == [("t", "title"), ("Home", "nav"), ("a & b c é", "p"), ("two", "p"), ("d e", "div"), ("tail", ""), ("x", "li"), ("y", "li")]
    assert blocks(None) == blocks("") == []
    assert [b.text for b in blocks("<p>open <b>bold</p></div></b>after")] == ["open bold", "after"]
    assert len(blocks("<div>" * 3000 + "deep")) == 1


BROKEN = {
    "<p>a</p><![foo b</p>c": ["a", "c"], "<p>x</p><![ ": ["x"], "<p>x</p><![3 you": ["x"], "<![CDATA[a>b]]>c": ["b]]>c"], "<!-->a<!--->b": ["ab"], "a<!-- b": ["a"], "a</>b</ c>d": ["abd"], "a<?php x ?>b": ["ab"], "a < b <3 c": ["a < b <3 c"],
    "<p>cut <a href='x": ["cut"], "<p>a</p": ["a"], "x<script>if (a</b) '</p>'": ["x"], "&#00000000065;&#x110000;&#99999999999;&amp;&nosuch;": ["A\ufffd\ufffd&&nosuch;"], "<P CLASS=A>b</P\n>c": ["b", "c"], "<div a=\"x>y\" b='>'>z": ["z"], "<": ["<"], "a<": ["a<"],
}


def test_broken_pages():
    for html, want in BROKEN.items():
        assert [b.text for b in blocks(html)] == want, html


@pytest.mark.parametrize(
    "html",
    ["<a " * 200_000, "<p>x</p>" + "<a " * 200_000 + ">y", "".join(f'<e{k} class="n{k}">t' for k in range(50_000)), "&#" + "9" * 100_000 + ";", "<" * 300_000, "<a b='" * 100_000, "</" * 200_000, "<!--" * 200_000, "<script>" * 100_000, "<p>" * 200_000, "<a " + "/ " * 300_000],
    ids=range(11),
)
def test_strange_pages_take_time_in_proportion(html):
    began = time.process_time()
    default_model().main_text(html)
    assert time.process_time() - began < 20


def plain_main_text(model, html):
    """Blocks by the standard library's parser, labels by trying all of them on short pages."""
    from html.parser import HTMLParser

    from lexmill.llm import html_blocks as H

    reader = H._Reader()

    class Plain(HTMLParser):
        def handle_starttag(self, tag, attrs):
            reader.start(tag, [(k, v) for k, v in attrs])

        handle_startendtag = handle_starttag

        def handle_endtag(self, tag):
            reader.finish(tag)

        def handle_data(self, data):
            if data and not reader.hidden:
                reader.parts.append(data)
                reader.linked += len(data.strip()) if reader.open["a"] or reader.open["button"] else 0

    parser = Plain(convert_charrefs=True)
    parser.feed(html or "")
    parser.close()
    reader.flush()
    page = reader.blocks
    weight = [sum(model.weights.get(f, 0.0) for f in sorted(H.features(page)[k])) for k in range(len(page))]
    best, found = None, ()
    for labels in itertools.product((0, 1), repeat=len(page)):
        score = sum(w for w, y in zip(weight, labels, strict=True) if y) + sum(model.step[a][b] for a, b in itertools.pairwise(labels)) + (model.start[labels[0]] if labels else 0)
        if best is None or score > best:
            best, found = score, labels
    return "\n".join(b.text for b, y in zip(page, found, strict=True) if y)


def test_pages_against_a_plain_version(spark):
    from lexmill.llm.extraction import extract_pages

    short = [h for h in labelled_pages(60, seed=3) if len(blocks(h)) <= 12][:12]
    short += [None, "", "<p>One long paragraph of an article that says a lot, and then more.</p>", "<nav><a href=a>Home</a><a href=b>News</a></nav><article><h1>Title</h1><p>Text of the &lt;article&gt;, long enough to be one.</p></article><footer>© 2020</footer>"]
    bad = list(BROKEN)
    rows = [(k, "u", h) for k, h in enumerate([*short, *bad])]
    got = {r["page_id"]: r for r in extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(rows) and len(short) > 8
    for k, h in enumerate(short):
        assert got[k]["text"] == plain_main_text(default_model(), h) and got[k]["n_chars"] == len(got[k]["text"])


def test_labelled_pages_held_out():
    model = default_model()
    right = total = 0
    for html in labelled_pages(300, seed=77):
        page = blocks(html, marks=True)
        for b, y in zip(page, model.decode(model.scores(page)), strict=True):
            total += 1
            right += y == int(b.mark == "1")
    assert right / total > 0.98


LAYOUTS = {
    "one paragraph": ("<html><body><article><p>{a}</p></article></body></html>", "{a}"),
    "straight under body": ("<html><body><h1>{t}</h1><p>{a}</p><p>{b}</p></body></html>", "{t}\n{a}\n{b}"),
    "no names": ("<body><nav><a href=/>Home</a> <a href=/n>News</a></nav><div><p>{a}</p><p>{b}</p><p>{c}</p></div><footer>&copy; 2020 x</footer></body>", "{a}\n{b}\n{c}"),
    "names only": ("<body><div class='site-header'><div>Site</div></div><div id=content><h2>{t}</h2><p>{a}</p></div><div class='col sidebar'><p>{b}</p></div><div class=copyright>&copy; x</div></body>", "{t}\n{a}"),
    "table": ("<body><table><tr><td><ul><li><a href=/>Home</a></li><li><a href=/b>More</a></li></ul></td><td><p>{a}</p><p>{b}</p></td></tr></table></body>", "{a}\n{b}"),
    "slash in script": ("<body><article><script src=x />var a='<p>no</p>';</script><p>{a}</p><div/><p>{b}</p></article></body>", "{a}\n{b}"),
    "open comment": ("<body><article><p>{a}</p><p>{b}</p></article><!-- <p>{c}</p></body></html>", "{a}\n{b}"),
    "long class": ("<body><article><p>{a}</p></article><div class='" + "p4 m2 flex row wide tall big box item cell unit part grid sidebar comments'" + "><p>{b}</p></div></body>", "{a}"),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts(name):
    html, want = LAYOUTS[name]
    said = {"t": "A day at the river", "a": "The boats came in early. All of them had fish, and the market opened at noon.", "b": "Later the wind turned, and nobody went out again until the next morning.", "c": "That was all for the week, as the harbour master said."}
    assert default_model().main_text(html.format(**said)) == want.format(**said)


def test_slopes_against_differences():
    from lexmill.llm.extraction import Labelled

    seen, rng = Labelled(labelled_pages(6, seed=3)), np.random.default_rng(0)
    at = rng.normal(size=len(seen.names)), rng.normal(size=(2, 2)), rng.normal(size=2)
    _, slopes = seen.slopes(*at, 0.7)
    for v, g in zip(at, slopes, strict=True):
        for k in list(np.ndindex(v.shape))[:40]:
            said = []
            for step in (1e-5, -2e-5):
                v[k] += step
                said.append(seen.slopes(*at, 0.7)[0])
            v[k] += 1e-5
            assert (said[0] - said[1]) / 2e-5 == pytest.approx(g[k], abs=1e-3)


def test_viterbi_against_all_labellings():
    from itertools import product

    model, r = default_model(), random.Random(5)
    for _ in range(60):
        s = [r.gauss(0, 1.5) for _ in range(r.randint(1, 7))]

        def value(y, s=s):
            return model.start[y[0]] + sum(a * b for a, b in zip(s, y, strict=True)) + sum(model.step[a][b] for a, b in zip(y, y[1:], strict=False))

        best = max(product((0, 1), repeat=len(s)), key=value)
        assert value(model.decode(s)) == pytest.approx(value(best))


def test_pages(spark):
    html = "<html><head><title>T</title></head><body><nav><a href=/>Home</a></nav><article><h1>Head</h1><p>First  sentence &amp; more\nof it.</p><p>Second.</p></article><div class=comments><p>me too</p></div><footer>&copy; x</footer>"
    rows = [(1, "u", html), (2, "u", None), (3, None, ""), (None, "v", "<p"), (1, "u", html)]
    pages = with_clashes(spark.createDataFrame(rows, "page_id long, url string, html string"), "text", "n_chars")
    got = sorted(extract_pages(pages).collect(), key=lambda r: str(r["page_id"]))
    assert len(got) == 5 and [r["text"] for r in got if r["page_id"] == 1] == ["Head\nFirst sentence & more of it.\nSecond."] * 2
    assert all(r["n_chars"] == len(r["text"]) for r in got) and got[2]["text"] == ""
    assert extract_pages(pages.limit(0)).count() == 0


def plain_ctw(texts, depth):
    """Counts of every node, and the weighted block probability, by recursion."""
    counts = {}
    for t in texts:
        b = b"\n" * depth + t + b"\n"
        for i in range(depth, len(b)):
            for j in range(8):
                bits, bit = (b[i] >> (8 - j)) | (1 << j), b[i] >> (7 - j) & 1
                for k in range(depth + 1):
                    counts.setdefault((k, bytes(b[i - k : i]), bits), [0, 0])[bit] += 1
    own = lambda n: math.lgamma(n[0] + 0.5) + math.lgamma(n[1] + 0.5) - math.log(math.pi) - math.lgamma(n[0] + n[1] + 1)
    children = {}
    for k, c, bits in counts:
        if k:
            children.setdefault((k - 1, c[1:], bits), []).append((k, c, bits))
    weighted, below = {}, {}
    for node in sorted(counts, key=lambda n: -n[0]):
        e = own(counts[node])
        if node[0] == depth:
            weighted[node] = e
        else:
            below[node] = sum(weighted[c] for c in children[node])
            weighted[node] = np.logaddexp(e, below[node]) - math.log(2)

    def log10_of(text):
        b, total = b"\n" * depth + text + b"\n", 0.0
        for i in range(depth, len(b)):
            for j in range(8):
                bits, bit = (b[i] >> (8 - j)) | (1 << j), b[i] >> (7 - j) & 1
                p, first = 0.5, True
                for k in range(depth, -1, -1):
                    node = (k, bytes(b[i - k : i]), bits)
                    if node in counts:
                        n = counts[node]
                        mine = (n[1] + 0.5) / (sum(n) + 1)
                        trust = 1.0 if first or node not in below else 1 / (1 + math.exp(min(700, below[node] - own(n))))
                        p, first = trust * mine + (1 - trust) * p, False
                total += math.log10(p if bit else 1 - p)
        return total

    return log10_of


def test_context_tree_against_plain_recursion(spark):
    rows = [(i if i is not None else 99, t if t is None or len(t) < 5000 else t[:300]) for i, t, *_ in odd_rows()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    train = docs.where("doc_id % 3 <> 0")
    model, words = ctw.learn(train)
    got = sorted(ctw.score(with_clashes(docs, "score", "row", "n_tokens", "base"), model, words).collect(), key=lambda r: r["doc_id"])
    body = lambda t: b" ".join((t or "").encode().lower().split())
    log10_of = plain_ctw([body(t) for i, t in rows if i % 3], ctw.DEPTH)
    tokens = lambda t: [*body(t).split(b" "), None] if body(t) else [None]
    c = Counter(w for i, t in rows if i % 3 for w in tokens(t))
    n, v = sum(c.values()), len(c)
    for r, (i, t) in zip(got, sorted(rows, key=lambda x: x[0]), strict=True):
        assert r["doc_id"] == i and r["n_tokens"] == len(tokens(t)) and r["train_tokens"] == n
        assert r["n_known"] == sum(c[w] > 0 for w in tokens(t))
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)))
        assert r["score"] == pytest.approx(log10_of(body(t)), rel=1e-6)
        assert r["bits_per_byte"] == pytest.approx(-r["score"] * math.log2(10) / (len(body(t)) + 1))


def test_long_texts_are_scored_in_parts(spark, monkeypatch):
    rows = [(1, "abc abd  abe\taaa " * 9), (2, "xyz abc"), (3, None), (4, " \n" * 40), (5, "abc   " + " " * 70), (6, "q" * 90), (7, "ab " * 30 + "  ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    score = lambda: {r["doc_id"]: tuple(r[1:]) for r in ctw.score(docs, *ctw.learn(docs)).collect()}

    def counted():
        batch = pa.RecordBatch.from_arrays([pa.array([t for _, t in rows])], names=["text"])
        total = Counter()
        for b in ctw._count(iter([batch])):
            for r in b.to_pylist():
                total[r["kind"], r["key"]] += r["n"]
        return total

    whole, counts = score(), counted()
    for chunk in (7, 16, 33):
        monkeypatch.setattr(ctw, "CHUNK", chunk)
        assert {i for i, t in rows if len(list(ctw.parts_of(t))) > 1} >= {1, 7}
        for i, t in rows:
            parts = list(ctw.parts_of(t))
            assert b"".join(b" ".join(w) + after for _, w, after in parts) == b" ".join(ctw.words_of(t)) + b"\n"
        assert counted() == counts
        assert score() == {k: pytest.approx(v) for k, v in whole.items()}


def test_rare_words_meet_their_counts(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a a a b b c"), (2, "c d d e")], "doc_id long, text string")
    whole = {r["doc_id"]: (r["n_known"], r["base_score"]) for r in ctw.score(docs, *ctw.learn(docs)).collect()}
    monkeypatch.setattr(ctw, "FREQUENT", 1)
    few = {r["doc_id"]: (r["n_known"], r["base_score"]) for r in ctw.score(docs, *ctw.learn(docs)).collect()}
    assert few.keys() == whole.keys() and all(few[k][0] == whole[k][0] and few[k][1] == pytest.approx(whole[k][1]) for k in whole)


def test_models_of_empty_tables(spark):
    model, words = ctw.learn(empty_docs(spark))
    assert ctw.score(empty_docs(spark), model, words).count() == 0
    r = ctw.score(spark.createDataFrame([(1, "ab")], "doc_id long, text string"), model, words).first()
    assert r["n_known"] == 0 and r["train_tokens"] == 0 and r["score"] == pytest.approx(24 * math.log10(0.5))


def test_probabilities_of_a_byte_sum_to_one(spark):
    docs = spark.createDataFrame([(1, "abc abd abe aaa"), (2, "xyz abc")], "doc_id long, text string")
    model, _ = ctw.learn(docs)
    for context in (b"c abc"[-5:], b"\n\n\n\n\n", b"qqqqq"):
        codes = np.array([int.from_bytes(context + bytes([b]), "big") for b in range(256)])
        assert (10 ** model.log10_of(codes)).sum() == pytest.approx(1)


def test_rare_grams_meet_their_probabilities(spark, monkeypatch):
    rows = [(i, " ".join(f"{w}{(i * 7 + k) % 13}" for k, w in enumerate("oak elm ash fir yew".split()))) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    train = docs.where("doc_id % 3 > 0")
    log10_of = plain_ctw([t.encode() for i, t in rows if i % 3], ctw.DEPTH)
    for most in (0, 60, 1 << 21):
        monkeypatch.setattr(ctw, "GRAMS", most, raising=False)
        monkeypatch.setattr(ctw, "SLOTS", max(most, 1), raising=False)
        model, words = ctw.learn(train)
        assert len(model.keys) <= max(most, 1)
        got = {r["doc_id"]: r["score"] for r in ctw.score(docs, model, words).collect()}
        assert got == {i: pytest.approx(log10_of(t.encode()), rel=1e-6) for i, t in rows}


def test_very_long_texts(spark):
    """A text of some 400,000 characters beside short ones, through every operator that reads texts."""
    import public_tokenizers

    from lexmill.llm import packing, search, simhash, tokens
    from tests.llm.helpers import words

    long = " ".join(words(k % 50, 400) for k in range(180))
    assert len(long) > 400_000
    docs = spark.createDataFrame([(1, long), (2, "short text"), (3, long)], "doc_id long, text string")
    path = public_tokenizers.path("byte_bpe_50k.json")
    counts = {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(docs, path).collect()}
    assert counts[1] == counts[3] == len(tokens.encoder(path).ids(long)) > 60_000
    assert sum(r["length"] for r in packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")).collect()) == sum(counts.values()) + 3
    assert {r["component_id"] for r in simhash.simhash_classes(docs).where("doc_id <> 2").collect()} == {1}
    named = docs.withColumn("lang", F.lit("en"))
    assert {r["lang_pred"] for r in language.identify(docs, language.learn(named)).collect()} == {"en"}
    lexicon = toxicity.Lexicon({" be": 1.0}, [" bed "])
    assert all(0 <= r["score"] <= 1 for r in toxicity.score_toxicity(docs, lexicon).collect())
    model, counted = ctw.learn(docs)
    scored = {r["doc_id"]: r for r in ctw.score(docs, model, counted).collect()}
    assert scored[1]["n_tokens"] == len(long.split()) + 1 and scored[1]["score"] == pytest.approx(scored[3]["score"])
    hits = search.top_k(docs, docs.select(F.col("doc_id").alias("query_id"), "text"), k=2).where("query_id = 1").collect()
    assert [r["doc_id"] for r in hits] == [1, 3]
