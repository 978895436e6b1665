import zlib

import numpy as np

from lodestream.llm import language as la
from lodestream.llm.sampling import sample_by
from lodestream.session import table


def test_subwords_depend_on_the_word_alone():
    words = [b"the", b"x", b"caf\xc3\xa9", b"the"]
    at, owner = la.subwords(words)
    each = [sorted(at[owner == k].tolist()) for k in range(4)]
    assert each[0] == each[3] != each[2]
    for k, w in enumerate(words):
        assert each[k] == sorted(la.subwords([w])[0].tolist())
    assert len(la.subwords([])[0]) == 0


def test_held_out_accuracy(spark, sf):
    docs = table(spark, sf.replace("0.001", "0.01"), "documents")
    model = la.learn(docs)
    lang = {r.doc_id: r.lang for r in docs.collect()}
    got = [r for r in la.predict(docs, model).collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(got) > 100 and np.mean([r.lang_pred == lang[r.doc_id] for r in got]) >= 0.97
    assert all(0 <= r.score <= 1 for r in got)
    again = la.predict(docs, model).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, la.predict(docs, model).collect()))


def test_odd_rows(spark, sf):
    docs = table(spark, sf, "documents")
    rows = [(1, None, "x"), (2, "", "x"), (3, "12 ## \n", "x"), (None, "the of and", None), (4, "É", None), (5, "the with " * 20000, "z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang_pred string")
    got = {r.doc_id: r for r in la.predict(df, la.learn(docs)).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and got[5].lang_pred == "en" and got[4].lang_pred != "und"
    none = la.learn(spark.createDataFrame([(1, "abc", None)], "doc_id bigint, text string, lang string"))
    assert {r.lang_pred for r in la.predict(df, none).collect()} == {"und"}
    assert la.predict(df.limit(0), la.learn(docs)).count() == 0


def test_scores_against_the_model_alone(spark, sf):
    """Every score of a table from the definition: the mean of all subwords' logits, one text at a time; repeated rows agree."""

    def check(docs, got):
        model, want = la.learn(docs), {}
        for r in docs.collect():
            if not any(c.isalpha() for c in r.text or ""):
                want[r.doc_id] = ("und", 0.0)
                continue
            z = (model.logits[la.subwords(la.words_of(r.text))[0]].astype(float).mean(0) + model.bias) / model.temperature
            p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
            want[r.doc_id] = (model.languages[int(p.argmax())], p.max())
        for r in got(model):
            assert r.lang_pred == want[r.doc_id][0] and abs(r.score - want[r.doc_id][1]) < 1e-4, r

    docs = table(spark, sf, "documents")
    check(docs, lambda model: la.op5_language(spark, sf).collect())
    twice = docs.unionByName(docs.where("doc_id % 5 = 0"))
    check(twice, lambda model: la.predict(twice, model).collect())


def test_most_frequent_values(spark):
    rows = [(i, "abcde"[min(i % 9, 4)]) for i in range(900)] + [(1000, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, lang string")
    got = {r.lang: r["count"] for r in sample_by(df, "lang", 60, 3).groupBy("lang").count().collect()}
    assert set(got) == {"a", "b", "e"} and all(30 < n < 95 for n in got.values())
