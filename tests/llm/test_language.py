"""Language identification: held-out accuracy, no leak from held-out rows, defined edge cases."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import functions as F

from tidebook.llm import language as L

DOCS = "doc_id long, text string, lang string"


def test_held_out_accuracy(spark, middle):
    truth = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet(f"{middle}/documents.parquet").collect()}
    rows = L.op6_language(spark, middle).collect()
    assert len(rows) == len(truth)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
        text = truth[r.doc_id][1]
        assert (r.lang_pred == "und") == (not text or not any(map(str.isalpha, text)))
    held = [r.lang_pred == truth[r.doc_id][0] for r in rows if r.held_out and r.lang_pred != "und" and truth[r.doc_id][0] is not None]
    assert np.mean(held) > 0.95
    sure = [r.lang_pred == truth[r.doc_id][0] for r in rows if r.held_out and not r.rejected and truth[r.doc_id][0] is not None]
    assert np.mean(sure) >= np.mean(held) - 1e-9


def test_held_out_languages_are_never_learned(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    lied = docs.withColumn("lang", F.when(L.remainder("doc_id", 3) == 1, F.lit("xx")).otherwise(F.col("lang")))
    one, two = L.train(docs), L.train(lied)
    assert one.languages == two.languages and np.array_equal(one.weights, two.weights)


def test_subwords_of_long_texts_are_counted_piece_by_piece(monkeypatch):
    raw = "Größe und Maß, l'été à Noël. ".encode() * 50
    whole = L.subwords(raw)
    monkeypatch.setattr(L, "_STEP", 64)
    assert np.array_equal(L.subwords(raw), whole)
    folded = b" " + b" ".join(raw.translate(L._FOLD).split()) + b" "
    grams = [folded[i : i + n] for n in L.GRAMS for i in range(len(folded) - n + 1)]
    assert whole.sum() == sum(b" " not in g[1:-1] for g in grams)


def test_edge_cases(spark):
    texts = [(2, "hello there my friend", "en"), (3, "bonjour mon ami cher", "fr"), (6, "hello my friend there", "en"), (8, "cher ami bonjour", "fr"), (9, None, "en"), (10, "", "fr"), (11, "123 !!", "en"), (12, "hello friend", None), (None, "bonjour", "fr"), (2, "hello there my friend", "en"), (13, "мир " * 100_000, None)]
    docs = spark.createDataFrame([(*t, 1, "c") for t in texts], f"{DOCS}, t int, r string")
    model = L.train(docs)
    rows = L.annotate(docs, model).collect()
    assert len(rows) == len(texts)
    for r in rows:
        wordless = not r.text or not any(map(str.isalpha, r.text))
        assert (r.language.lang == "und") == wordless
        assert r.language.rejected or not wordless
        assert (r.t, r.r) == (1, "c")
    blank = L.train(docs.where("lang IS NULL"))
    assert {r.language.lang for r in L.annotate(docs, blank).collect()} == {"und"}
    assert L.annotate(spark.createDataFrame([], DOCS), model).count() == 0


def test_copies_of_a_sampled_document_are_learned_once(spark, monkeypatch):
    rows = [(i, f"ein kleines Haus am See mit Garten {i}", "de") for i in range(40)] + [(100 + i, f"une petite maison avec jardin {i}", "fr") for i in range(40)]
    docs = spark.createDataFrame(rows + rows[:1] * 3000 + rows[40:41] * 3000, "doc_id long, text string, lang string")
    seen = []
    monkeypatch.setattr(L, "fit", lambda x, y: seen.append(len(y)))
    L.train(docs, train_docs=10_000)
    assert 30 < seen[0] <= 80
