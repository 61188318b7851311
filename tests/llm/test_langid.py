"""Accuracy on documents that nothing was learnt from, and what is never an input."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from cdcflow.llm import langid

SCHEMA = "doc_id long, text string, lang string, source string, score string"
SYLLABLES = {
    "aa": "tha the ing er on and st wh".split(), "ab": "the thi ing ed an und sch".split(),
    "ba": "que la ción os ñe el ra".split(), "bb": "que le é eau ment ou ra".split(), "cc": "ка ри ло на ст по".split(),
}


def some_rows(n=600, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        lang = r.choice(list(SYLLABLES))
        words = ["".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 3))) for _ in range(r.choice((4, 40, 200)))]
        rows.append((i, " ".join(words).capitalize() + ".", lang, "s", "x"))
    return rows


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_held_out_documents_are_told_apart(spark):
    rows = some_rows()
    found = langid.identified(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(found) == len(rows)
    out = [r for r in found if held(r["doc_id"])]
    assert all(r["held_out"] == held(r["doc_id"]) for r in found) and all(0 <= r["score"] <= 1 for r in found)
    assert sum(r["lang_pred"] == rows[r["doc_id"]][2] for r in out) / len(out) > 0.95


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    both = langid.identified(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert both.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_languages_of_held_out_documents_and_ids_are_no_input(spark):
    rows = some_rows(300, 2)
    changed = [(i, t, "zz" if held(i) else lang, "other", "") for i, t, lang, *_ in rows]
    runs = [
        {r["doc_id"]: tuple(r) for r in langid.identified(spark.createDataFrame(x, SCHEMA).repartition(p)).collect()}
        for x, p in ((rows, 1), (changed, 4))
    ]
    assert runs[0] == runs[1]


def test_related_languages_are_one_family():
    rows = some_rows(300, 3)
    x = np.stack([langid.profile(langid.letters(t)) for _, t, *_ in rows])
    model = langid.fit(x, [r[2] for r in rows])
    assert sorted(map(tuple, model.families)) == [("aa", "ab"), ("ba", "bb"), ("cc",)]
    assert len(model.between) == 3 and [len(w) for w in model.within] == [len(f) * (len(f) - 1) // 2 for f in model.families]


def test_margins_are_those_of_single_texts(monkeypatch):
    rows = some_rows(40, 4)
    texts = [langid.letters(t) for _, t, *_ in rows] + [b" a ", b" " + b"ab " * 5000]
    model = langid.fit(np.stack([langid.profile(t) for t in texts[:40]]), [r[2] for r in rows])
    together = langid.margins(texts, model)
    monkeypatch.setattr(langid, "CHUNK", 64)
    for i, t in enumerate(texts):
        wanted = langid.profile(t).astype(float) @ model.weights + model.bias
        assert np.allclose(langid.margins([t], model)[0], wanted, atol=1e-3), i
        assert np.allclose(together[i], wanted, atol=1e-3), i


def test_rows_of_all_kinds(spark):
    odd = [(1000, None, "aa", None, ""), (1001, "", None, "", ""), (1002, "123 !? \n", "aa", "", ""), (None, "the thing", "aa", "", ""),
           (1003, "the thing " * 20_000, None, "", ""), (1003, "the thing " * 20_000, None, "", "")]
    found = langid.identified(spark.createDataFrame(some_rows(200) + odd, SCHEMA)).collect()
    by = {}
    for r in found:
        by.setdefault(r["doc_id"], []).append(r)
    assert [(by[i][0]["lang_pred"], by[i][0]["score"]) for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert by[None][0]["lang_pred"] == "aa" and by[None][0]["held_out"] is False
    assert len(by[1003]) == 2 and by[1003][0] == by[1003][1]


def test_nothing_to_learn_from(spark):
    frame = spark.createDataFrame([(1, "abc", None, "", ""), (2, None, "aa", "", "")], SCHEMA)
    assert [r["lang_pred"] for r in langid.identified(frame).collect()] == ["und", "und"]
    one = spark.createDataFrame([(1, "the thing", "aa", "", ""), (3, "ing the", "aa", "", "")], SCHEMA)
    assert {r["lang_pred"] for r in langid.identified(one).collect()} == {"aa"}
    assert langid.identified(spark.createDataFrame([], SCHEMA)).count() == 0
