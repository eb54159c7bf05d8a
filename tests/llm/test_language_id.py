"""Language ID: held-out accuracy, rejection, odd rows."""

import random

import numpy as np

from tidewire.llm import language_id
from tidewire.llm.queries import held_out, op7_language_id


def test_held_out_accuracy(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "lang")
    found = op7_language_id(spark, small)
    assert found.count() == docs.count()
    rows = found.join(docs, "doc_id").where("held_out").collect()
    assert len(rows) > 20 and np.mean([r.lang_pred == r.lang for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows) and not any(r.rejected for r in rows)


def test_rejects_what_is_far(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = language_id.fit(docs.where(~held_out()))
    r = random.Random(1)
    noise = " ".join("".join(r.choice("qxzjkwvQXZJ") for _ in range(9)) for _ in range(80))
    names, score, rejected = model.predict([noise, None, "", "123 !!", "жизнь и судьба " * 30, docs.first().text])
    assert names[1:4] == ["und"] * 3 and not score[1:4].any()
    assert rejected.tolist() == [True, True, True, True, True, False] and names[0] in model.languages


def test_counting_in_stretches(monkeypatch):
    text = "Straße и мир 日本 x" * 40
    whole = language_id.counts(text)
    monkeypatch.setattr(language_id, "STRETCH", 37)
    assert (language_id.counts(text) == whole).all() and whole.sum() > 0


def test_clusters_separate():
    rng = np.random.default_rng(0)
    centres = np.eye(4, 12)
    x = np.repeat(centres, 10, axis=0) + rng.normal(scale=0.02, size=(40, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found = language_id.cluster(x, 4)
    assert len(set((x @ found.T).argmax(axis=1).reshape(4, 10)[:, 0])) == 4


def test_odd_documents(odd, empty):
    model = language_id.fit(odd)
    found = {(r.doc_id, r.lang_pred, r.rejected) for r in language_id.predict(odd, model).collect()}
    assert {(3, "und", True), (4, "und", True), (5, "und", True), (10, "und", True), (1, "en", False)} <= found
    kept = language_id.keep_identified(odd, model)
    assert kept.columns == odd.columns and 3 not in {r.doc_id for r in kept.collect()}
    none = language_id.fit(empty)
    assert {r.lang_pred for r in language_id.predict(odd, none).collect()} == {"und"}
    assert language_id.predict(empty, model).count() == 0
