"""Learned embeddings against a dense truncated SVD, and search by the words of a query."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.operators import search, semantics

FEATURES = 512


def dense(spark, texts):
    """The weights of all texts as a matrix, made without the module's own sparse steps."""
    rows = texts.select("id", semantics.features_of(F.col("document"), FEATURES).alias("f")).orderBy("id").collect()
    counts = np.zeros((len(rows), FEATURES))
    for i, r in enumerate(rows):
        for f in r.f:
            counts[i, f] += 1
    seen = counts.any(axis=1).sum()
    idf = np.where(counts.any(axis=0), np.log((seen + 1) / ((counts > 0).sum(axis=0) + 1)), 0)
    a = np.log1p(counts) * idf
    norm = np.linalg.norm(a, axis=1, keepdims=True)
    return a / np.where(norm > 0, norm, 1)


@pytest.fixture(scope="module")
def topics(spark):
    """Texts of six subjects, each with words of its own, and common ones."""
    r = np.random.default_rng(7)
    words = [[f"s{s}w{i}" for i in range(12)] for s in range(6)]
    rows = [(i, " ".join([*r.choice(words[i % 6], 9), *r.choice(["the", "of", "and", "one"], 4)])) for i in range(240)]
    return spark.createDataFrame([*rows, (240, None), (241, ""), (242, "...")], "id long, document string").repartition(5)


def test_same_space_as_dense_svd(spark, topics):
    model = semantics.fit(topics, dims=6, features=FEATURES, rounds=3)
    a = dense(spark, topics)
    _, size, right = np.linalg.svd(a, full_matrices=False)
    cosines = np.linalg.svd(right[:6] @ model.vectors.astype(float), compute_uv=False)
    assert cosines.min() > 0.999
    assert np.allclose(np.linalg.norm(a @ model.vectors, axis=0), size[:6], rtol=1e-3)


def test_embeddings(spark, topics):
    model = semantics.fit(topics, dims=6, features=FEATURES)
    got = {r.id: np.array(r.embedding) for r in model.embed(topics).collect()}
    want = dense(spark, topics) @ model.vectors
    for i in range(240):
        assert np.allclose(got[i], want[i] / np.linalg.norm(want[i]), atol=1e-5)
    assert all(not got[i].any() and len(got[i]) == 6 for i in (240, 241, 242))


def test_synonyms_are_near(spark):
    """Two words that never stand together but in the same company: a search for one finds the other's texts."""
    company = ["engine", "wheel", "road", "driver", "fuel", "brake"]
    other = ["flour", "oven", "butter", "sugar", "dough", "yeast"]
    r = np.random.default_rng(2)
    texts = [(i, f"{('car', 'automobile')[i % 2]} " + " ".join(r.choice(company, 4))) for i in range(60)] + [(i, "cake " + " ".join(r.choice(other, 4))) for i in range(60, 120)]
    docs = spark.createDataFrame(texts, "id long, document string")
    model = semantics.fit(docs, dims=4, features=4096)
    index = model.embed(docs).withColumn("metadata", F.struct(F.lit(1).alias("n")))
    asked = spark.createDataFrame([(1, "automobile"), (2, "oven dough"), (3, "never seen"), (4, "of")], "query_id long, query string")
    found = search.semantic_search(index, asked, k=40, threshold=0.5, model=model).collect()
    cars = [r.id for r in found if r.query_id == 1]
    assert len(cars) == 40 and all(i < 60 for i in cars) and sum(i % 2 == 0 for i in cars) >= 10  # texts without the word
    assert all(r.id >= 60 for r in found if r.query_id == 2) and sum(r.query_id == 2 for r in found) == 40
    assert not [r for r in found if r.query_id in (3, 4)]


def test_a_model_is_kept(spark, topics, tmp_path):
    model = semantics.fit(topics, dims=6, features=FEATURES)
    model.save(spark, f"{tmp_path}/model")
    back = semantics.Semantics.load(spark, f"{tmp_path}/model")
    assert np.array_equal(back.vectors, model.vectors) and np.allclose(back.idf, model.idf)


def test_few_and_no_texts(spark):
    none = spark.createDataFrame([], "id long, document string")
    model = semantics.fit(none, dims=3, features=64)
    assert not model.vectors.any() and model.embed(none).collect() == []
    two = spark.createDataFrame([(1, "one text"), (2, "another word")], "id long, document string")
    assert semantics.fit(two, dims=8, features=64).embed(two).select(F.size("embedding")).distinct().first()[0] == 8
    with pytest.raises(ValueError, match="beyond"):
        semantics.fit(two, dims=4096, features=1 << 20)
    with pytest.raises(ValueError, match="embedding"):
        search.semantic_search(two, spark.createDataFrame([(1, "abc")], "query_id long, query string"))


def test_one_pass_a_round(spark, topics):
    """Both products of a round come from one pass over features that were counted once."""
    rows = semantics.counted(topics, "document", FEATURES)
    assert all(r.f == sorted(set(r.f)) and len(r.f) == len(r.n) and min(r.n) >= 1 for r in rows.collect())
    a, g = dense(spark, topics), np.random.default_rng(1).standard_normal((FEATURES, 9))
    n, seen = a.any(axis=1).sum(), (a > 0).sum(axis=0)
    idf = np.where(seen > 0, np.log((n + 1) / (seen + 1)), 0)
    square, z = semantics._sketched(rows, idf, spark.sparkContext.broadcast(g), 9)
    y = a @ g
    assert np.allclose(square, y.T @ y) and np.allclose(z, a.T @ y)


def test_features_are_made_once(spark):
    """Texts without features are left out, and that takes no second look at all words."""
    texts = spark.createDataFrame([(1, None), (2, "a b a"), (3, " .,"), (4, ""), (5, "c")], "id long, document string")
    found = semantics.counted(texts, "document", FEATURES)
    assert sorted(sum(r.n) for r in found.collect()) == [1, 3]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
