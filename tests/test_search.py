"""Search: guards, filters, thresholds, ranks, exactness."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewire.operators import cells, search

QUERY = "query_id long, query string, embedding array<float>"


def test_query_guard(spark):
    rows = [(0, "", [1.0]), (1, "hi", [1.0]), (2, "a" * 101, [1.0]), (3, "  hi  ", [1.0]), (4, "good", [1.0]), (5, None, [1.0])]
    assert [r.query_id for r in search.valid_queries(spark.createDataFrame(rows, QUERY)).collect()] == [4]


def test_where(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "score int, label string")
    ids = lambda c: [r.score for r in df.where(search.where(c)).orderBy("score").collect()]
    assert ids({"score": 2}) == [2] and ids({"score": {"$gt": 1, "$lte": 3}}) == [2, 3]
    assert ids({"$or": [{"score": 1}, {"label": {"$in": ["c"]}}]}) == [1, 3]
    assert ids({"$and": [{"score": {"$ne": 1}}, {"label": {"$nin": ["c"]}}]}) == [2] and ids({}) == [1, 2, 3]
    with pytest.raises(ValueError):
        search.where({"score": {"$near": 1}})


def vectors(n, seed):
    return np.random.default_rng(seed).normal(size=(n, 8)).astype(np.float32)


@pytest.mark.parametrize("metric", ["cosine", "l2sq", "ip"])
def test_nearest_is_exact(spark, metric):
    docs, asked = vectors(300, 1), vectors(7, 2)
    docs[5] = docs[9] = docs[100]
    index = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(docs)] + [(999, None)], "id long, embedding array<float>").repartition(5)
    queries = spark.createDataFrame([(i, "q" * 5, v.tolist()) for i, v in enumerate(asked)], QUERY)
    found = search.nearest(index, queries, 10, metric).collect()
    a, q = docs.astype(float), asked.astype(float)
    dist = {"ip": 1 - a @ q.T, "l2sq": ((a[:, None] - q[None]) ** 2).sum(2), "cosine": 1 - (a @ q.T) / np.linalg.norm(a, axis=1)[:, None] / np.linalg.norm(q, axis=1)}[metric]
    for k in range(len(asked)):
        want = sorted(range(300), key=lambda i: (round(dist[i, k], 9), i))[:10]
        assert [r.id for r in sorted(found, key=lambda r: r.position) if r.query_id == k] == want


@settings(max_examples=3, deadline=None)
@given(st.floats(0.0, 0.9))
def test_threshold_only_drops(spark, threshold):
    docs = vectors(60, 3)
    index = spark.createDataFrame([(str(i), f"d{i}", v.tolist(), i) for i, v in enumerate(docs)], "id string, document string, embedding array<float>, metadata int")
    queries = spark.createDataFrame([(0, "query", docs[0].tolist())], QUERY)
    every = search.semantic_search(index, queries, threshold=None).orderBy("rank").collect()
    some = search.semantic_search(index, queries, threshold=threshold).orderBy("rank").collect()
    assert [r.rank for r in every] == list(range(1, 11)) and [r.distance for r in every] == sorted(r.distance for r in every)
    assert [r.id for r in some] == [r.id for r in every][: len(some)] and [r.rank for r in some] == list(range(1, len(some) + 1))


def test_no_queries_or_documents(spark):
    index = spark.createDataFrame([], "id string, document string, embedding array<float>, metadata int")
    queries = spark.createDataFrame([(0, "query", [1.0])], QUERY)
    assert search.semantic_search(index, queries).count() == 0
    assert search.semantic_search(index, queries.limit(0)).count() == 0


def test_near_pairs_are_all_pairs(spark):
    x = vectors(90, 4).astype(float)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    old, cells.SLICE = cells.SLICE, 16
    try:
        found = search.near_pairs(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>"), 0.5).collect()
    finally:
        cells.SLICE = old
    want = {(i, j) for i in range(90) for j in range(i + 1, 90) if round(x[i] @ x[j], 9) >= 0.5}
    assert {(r.a, r.b) for r in found} == want and len(found) == len(want)


def test_user_encoder(spark):
    def load():
        return lambda texts: [np.array([len(t), 1.0]) for t in texts]

    df = spark.createDataFrame([(1, "abc"), (2, None)], "id long, document string")
    assert {r.id: r.embedding for r in search.embed_with(df, load).collect()} == {1: [3.0, 1.0], 2: [0.0, 1.0]}


def test_index_ids_and_metadata(spark):
    df = spark.createDataFrame([(1, "b", 5, [1.0]), (2, "a", 9, [1.0])], "id long, title string, score int, embedding array<float>")
    rows = search.build_index(df, ("score",)).orderBy("metadata.index").collect()
    assert [(r.document, r.metadata.score, r.metadata["index"]) for r in rows] == [("a", 9, 0), ("b", 5, 1)]
    assert rows[0].id == "story_0_0cc175b9c0"
    assert {r.metadata.text for r in search.build_index(df).collect()} == {"a", "b"}
    assert search.duplicate_ids(spark.createDataFrame([("x",), ("x",), ("y",)], "id string")).collect() == [("x", 2)]


def test_a_block_is_compared_in_small_parts(monkeypatch):
    """However many documents a batch has, a task's matrix has no more than a fixed number of entries."""
    import numpy as np
    import pyarrow as pa

    from tidewire.operators import search

    seen, whole = [], search._distances
    monkeypatch.setattr(search, "_distances", lambda docs, queries, metric: seen.append(len(docs) * len(queries)) or whole(docs, queries, metric))
    x = np.random.default_rng(1).normal(size=(5000, 4))
    batch = pa.RecordBatch.from_pydict({"id": np.arange(5000), "embedding": pa.array(x.tolist(), pa.list_(pa.float64()))})
    (found,) = search._finder([7], x[:1], 3, "cosine", None)(iter([batch]))
    assert max(seen) <= 1024 * search.QUERY_BLOCK and len(seen) == 5
    assert found.column("id").to_pylist() == np.argsort(np.round(search._distances(x, x[:1], "cosine")[:, 0], 9), kind="stable")[:3].tolist()
