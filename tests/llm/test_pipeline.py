import subprocess
import sys
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from lexmill.llm.queries import bpe_path
from tests.llm.helpers import empty_docs, odd_docs, words
from tests.llm.test_near_duplicates import plain_classes

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["language ID", "toxicity", "SimHash near-dedup", "mixing sources to target weights", "packing"]
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and 0 < out.count() <= 2 * docs.count()


@pytest.mark.parametrize("k", range(5))
def test_stages_take_odd_and_empty_tables(spark, k):
    _, stage = P.STAGES[k]
    stage(spark, odd_docs(spark), SF).collect()
    assert stage(spark, empty_docs(spark), SF).count() == 0


def test_language_stage_rejects_texts_without_letters(spark):
    kept = {r["doc_id"] for r in P.language(spark, odd_docs(spark), SF).collect()}
    assert kept.isdisjoint({1, 2, 3, 9}) and {4, 5, 6, 8} <= kept


#: An article of a public declaration in languages that the tables lack, and text that is none.
FOREIGN = [
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.",
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
    "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью.",
    "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler.",
    "人人生而自由,在尊严和权利上一律平等。他们赋有理性和良心。",
]
JUNK = ["QWxsIGh1bWFuIGJlaW5ncyBhcmUgYm9ybiBmcmVl" * 4, "0x00 0x7f 0xff " * 20, "kqzx vvwq jjxk zzqw xkcd qqqq wvxz " * 5]


def test_language_stage_rejects_other_languages_and_junk(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    planted = spark.createDataFrame([(-1 - k, t, None, "planted", 0) for k, t in enumerate(FOREIGN + JUNK)], docs.schema)
    kept = {r["doc_id"] for r in P.language(spark, docs.unionByName(planted), SF).collect()}
    assert min(kept) >= 0 and len(kept) == docs.select("doc_id").distinct().count()
    french = {r["doc_id"] for r in P.language(spark, docs, SF, wanted=["fr"]).collect()}
    assert french and french < kept


def test_one_document_of_each_group_stays(spark):
    rows = [(k, words(k // 3, 60) + " " + words(0, 1)) for k in range(60)] + [(5, words(1, 60) + " " + words(0, 1))]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], odd_docs(spark).schema)
    kept = Counter(r["doc_id"] for r in P.near_duplicates(spark, docs, SF).collect())
    groups = {c for _, _, c in plain_classes(rows)}
    assert kept == Counter(groups)


def test_documents_of_one_id_are_told_apart(spark):
    rows = [(5, words(1, 60)), (5, words(2, 60)), (6, words(1, 60)), (None, words(2, 60)), (None, words(3, 60))]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], odd_docs(spark).schema)
    kept = sorted(r["text"] for r in P.near_duplicates(spark, docs, SF).collect())
    assert kept == sorted(words(k, 60) for k in (1, 2, 3))


def test_run_packs_whole_documents(spark):
    out = P.run(spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    tok = Tokenizer.from_file(bpe_path())
    ids = {i: [*tok.encode(texts[i], add_special_tokens=False).ids, 1] for i in {r["doc_id"] for r in out}}
    seen = Counter()
    for r in out:
        piece = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
        assert piece == ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        seen[r["doc_id"]] += len(piece)
    assert all(n % len(ids[i]) == 0 and 1 <= n // len(ids[i]) <= 2 for i, n in seen.items())


def test_the_entry_works_without_this_subpackage(tmp_path):
    code = f"""
import sys, shutil, os
shutil.copytree({P.__file__.rsplit("/", 1)[0]!r} + "/lexmill", {str(tmp_path)!r} + "/lexmill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
shutil.copy({P.__file__.rsplit("/", 1)[0]!r} + "/__spark_entry__.py", {str(tmp_path)!r})
os.chdir({str(tmp_path)!r})
sys.path[:] = [{str(tmp_path)!r}] + [p for p in sys.path if p not in ("", {P.__file__.rsplit("/", 1)[0]!r})]
import __spark_entry__ as e
names = e.queries()
assert "pipeline" not in names and not any(n.startswith("op") and n[2].isdigit() for n in names) and len(names) > 50
assert set(e.oracle_sql()) <= set(names)
"""
    env = {"PATH": "/usr/bin:/bin", "PYTHONPATH": ""}
    assert subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True).stderr == ""
