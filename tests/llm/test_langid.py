import zlib

import numpy as np

from tessera.llm import langid
from tessera.llm.common import table


def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = langid.report(docs).collect()
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) > 0.97 * len(held)


def test_counts_match_plain_naive_bayes(spark):
    texts = [("abc ab", "x"), ("Zzy, zy!", "y"), ("abba 77", "x")]
    model = langid.train(spark.createDataFrame(texts, "text string, lang string"), buckets=1 << 12)
    letters = langid.letter_table()
    want = np.zeros((1 << 12, 2))
    for text, lang in texts:
        for h in langid.grams(text, letters, 1 << 12, 3):
            for x in h:
                want[x, "xy".index(lang)] += 1
    want = np.log((want + 0.5) / (want.sum(0) + 0.5 * (1 << 12)))
    assert model.langs == ["x", "y"] and np.allclose(model.log_prob, want, atol=1e-5)
    one = sum(len(h) for h in langid.grams("abc ab", letters, 1 << 12, 3))
    assert one == 8 + 7 + 6  # " abc ab " in n-grams of 1 to 3
    assert not list(langid.grams("12 ?", letters, 1 << 12, 3))


def test_chunks_cover_long_texts(monkeypatch):
    letters, text = langid.letter_table(), "ab cdé " * 50
    whole = np.sort(np.concatenate(list(langid.grams(text, letters, 1 << 12, 3))))
    monkeypatch.setattr(langid, "_CHUNK", 7)
    assert (np.sort(np.concatenate(list(langid.grams(text, letters, 1 << 12, 3)))) == whole).all()


def test_chunks_are_summed_one_by_one(spark, monkeypatch):
    model = langid.train(spark.createDataFrame([("the cat sat", "en"), ("der hund und", "de")], "text string, lang string"), buckets=1 << 10)
    letters, texts = langid.letter_table(), ["the hund sat " * 500, None, "12", "und der", ""]
    langs, scores = langid.score(texts, model, letters)
    want = [sum((model.log_prob[h].sum(axis=0, dtype=float) for h in langid.grams(t, letters, 1 << 10, 3)), model.prior) for t in (texts[0], texts[3])]
    assert langs == [model.langs[want[0].argmax()], "und", "und", "de", "und"] and scores[1] == scores[2] == scores[4] == 0
    monkeypatch.setattr(langid, "_CHUNK", 50)
    again = langid.score(texts, model, letters)
    assert again[0] == langs and np.allclose(again[1], scores)
    held = []
    monkeypatch.setattr(langid, "_summed", lambda h, m, f=langid._summed: held.append(len(h)) or f(h, m))
    langid.score(texts, model, letters)
    assert max(held) <= 50


def test_small_cases(spark):
    rows = [(1, "the cat sat on the mat", "en"), (2, "der hund und die katze", "de"), (4, None, "en"), (5, "", None),
            (6, "123 ??", "de"), (7, "the dog " * 30000, None), (None, "und die katze", "de"), (8, "the cat", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS score", "2 AS n")
    got = {r.doc_id: r for r in langid.report(docs).collect()}
    assert len(got) == len(rows)
    assert (got[4].lang_pred, got[5].lang_pred, got[6].lang_pred) == ("und",) * 3 and got[7].lang_pred == "en"
    untrained = langid.report(docs.withColumn("lang", docs.lang.substr(9, 1)).selectExpr(
        "doc_id", "text", "nullif(lang, lang) AS lang")).collect()
    assert {r.lang_pred for r in untrained} == {"und"}
    assert langid.report(docs.limit(0)).count() == 0
