"""The cell index against all comparisons."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewire.operators import cells, graph, search


def clustered(n=900, dims=8, groups=30, seed=3):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(groups, dims))
    x = centres[r.integers(0, groups, n)] + 0.08 * r.normal(size=(n, dims))
    x[5:9] = x[4]  # equal vectors
    x[20] = x[21] = 0
    return x


def frame(spark, x, parts=4):
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(10_000, None)]
    return spark.createDataFrame(rows, "id long, embedding array<double>").repartition(parts)


@pytest.fixture(scope="module")
def data(spark):
    x = clustered()
    vectors = frame(spark, x)
    return x, vectors, cells.build(vectors)


def test_nearest_is_exact(spark, data, monkeypatch):
    x, vectors, index = data
    asked = vectors.where("id % 9 = 0 or id in (5, 20)").select(F.col("id").alias("query_id"), "embedding")
    found, read = cells.search(index, asked, k=7)
    want = {(r.query_id, r.id, r.distance, r.position) for r in search.nearest(vectors, asked, k=7).collect()}
    assert {tuple(r) for r in found.select("query_id", "id", "distance", "position").collect()} == want
    size = dict(zip(index.known.numbers.tolist(), index.known.sizes.tolist(), strict=True))
    seen = {}
    for r in read.where("query_id <> 20").collect():
        seen[r.query_id] = seen.get(r.query_id, 0) + size[r.cell]
    assert max(seen.values()) < len(x) / 2 and np.mean(list(seen.values())) < len(x) / 5


def test_few_cells_miss_little(spark, data):
    _, vectors, index = data
    asked = vectors.where("id % 9 = 0").select(F.col("id").alias("query_id"), "embedding")
    right = {(r.query_id, r.id) for r in search.nearest(vectors, asked, k=5).collect()}
    found, read = cells.search(index, asked, k=5, most_cells=3)
    assert read.groupBy("query_id").count().agg(F.max("count")).first()[0] == 3
    assert len(right & {(r.query_id, r.id) for r in found.collect()}) >= 0.9 * len(right)


def test_slices_and_parts(spark, data, monkeypatch):
    x, vectors, _ = data
    monkeypatch.setattr(cells, "SLICE", 7)
    monkeypatch.setattr(cells, "QUERIES", 5)
    index = cells.build(vectors, cells=4)
    asked = vectors.where("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding")
    want = {tuple(r) for r in search.nearest(vectors, asked, k=6).select("query_id", "id", "position").collect()}
    assert {tuple(r) for r in cells.nearest(index, asked, k=6).select("query_id", "id", "position").collect()} == want


@pytest.mark.parametrize("threshold", [0.97, 0.6, -0.2])
def test_near_pairs(spark, threshold):
    x = clustered(300)
    index = cells.build(frame(spark, x), cells=12)
    cosine = 1 - cells.cosine_distances(x, x)
    want = {(a, b) for a in range(300) for b in range(a + 1, 300) if round(cosine[a, b], 9) >= threshold}
    rows = cells.near_pairs(index, threshold).collect()
    assert len(rows) == len({(r.a, r.b) for r in rows}) and {(r.a, r.b) for r in rows} == want
    assert all(abs(r.similarity - cosine[r.a, r.b]) < 1e-8 for r in rows)
    forest = cells.near_pairs(index, threshold, forest=True)
    assert {(r.a, r.b) for r in forest.collect()} <= want
    of = lambda edges: {r.node: r.component for r in graph.components(edges.select("a", "b")).collect()}
    assert of(forest) == of(spark.createDataFrame(sorted(want), "a long, b long"))


def test_pairs_compared_are_few(spark, data):
    _, _, index = data
    far = float(cells.reach(0.03))
    rows = index.table.select(F.col("id").alias("query_id"), "embedding", F.col("cell").alias("more"))
    known = index.known
    asked = cells.probes(known, rows, lambda bounds, own: (bounds <= far) & (known.numbers >= own[:, None]))
    size = cells.by_cell(known.numbers, known.sizes, "size", spark)
    assert asked.join(size, "cell").agg(F.sum("size")).first()[0] < 900 * 900 / 8


def test_equal_vectors_give_few_links(spark):
    index = cells.build(frame(spark, np.tile([[1.0, 2.0, 3.0]], (400, 1))))
    assert cells.near_pairs(index, 0.9).count() == 400 * 399 // 2
    links = cells.near_pairs(index, 0.9, forest=True)
    assert links.count() < 2 * 400
    assert graph.components(links.select("a", "b")).select("component").distinct().count() == 1


def test_saved_and_empty(spark, data, tmp_path):
    _, vectors, index = data
    index.save(f"{tmp_path}/i")
    back = cells.Cells.load(spark, f"{tmp_path}/i")
    asked = vectors.where("id < 3").select(F.col("id").alias("query_id"), "embedding")
    pick = lambda i: {tuple(r) for r in cells.nearest(i, asked).collect()}
    assert pick(back) == pick(index)
    none = cells.build(frame(spark, np.zeros((0, 3))))
    assert cells.nearest(none, asked).collect() == [] and cells.near_pairs(none, 0.5).collect() == []
    assert cells.nearest(index, asked.where("false")).collect() == []


def test_vectors_are_sent_by_blocks(spark, monkeypatch):
    """A query that reads all cells is one row and is sent once for each block, however many cells there are."""
    monkeypatch.setattr(cells, "SLICE", 40)
    x = clustered(1600)
    index = cells.build(frame(spark, x), cells=200)
    known = index.known
    assert len(known.numbers) > 60 and known.block_size == 100
    first = known.first_blocks()
    number = int((first + known.slices).max())
    assert number <= 2 * cells.SHARES + 1
    inside = {r.block: r.n for r in cells.in_blocks(index).groupBy("block").agg(F.count("*").alias("n")).collect()}
    assert sum(inside.values()) == 1600 and max(inside.values()) <= 2 * 100
    rows = index.table.select(F.col("id").alias("query_id"), "embedding", F.lit(0.0).alias("more"))
    visits = cells.visits(known, rows, lambda bounds, _: bounds >= 0).collect()
    assert len(visits) == 1600 and {len(v.places) for v in visits} == {number}


@pytest.mark.parametrize("batch", [7, 300])
def test_forest_over_passing_vectors(batch):
    """Links kept over several batches are few, and connect what all links connect."""
    x = clustered(300, groups=6)
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    lists = lambda v: pa.array(v.tolist(), pa.list_(pa.float64()))
    queries = pa.table({"block": np.zeros(300, int), "query_id": np.arange(300), "more": np.zeros(300), "embedding": lists(x)})
    pairs = {}
    for forest in (False, True):
        meeting = cells._Pairs(queries, 0.1, forest)
        found = [b for at in range(0, 300, batch) for b in meeting.take(pa.RecordBatch.from_pydict({"id": np.arange(300)[at : at + batch], "embedding": lists(x[at : at + batch])}))]
        pairs[forest] = {p for b in found for p in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True)}
    assert pairs[False] == {(a, b) for a in range(300) for b in range(a + 1, 300) if round(1 - unit[a] @ unit[b], 9) <= 0.1}
    assert pairs[True] <= pairs[False] and len(pairs[True]) < 600 < len(pairs[False])

    def groups(edges):
        at = list(range(300))
        for _ in range(300):
            for a, b in edges:
                at[a] = at[b] = min(at[a], at[b])
        return at

    assert groups(pairs[True]) == groups(pairs[False])


@pytest.mark.parametrize("batch", [13, 300])
def test_best_of_passing_vectors(batch):
    """The nearest of all vectors, some equal and some of zeros, held as k rows a query at most."""
    x = clustered(300, groups=6)
    lists = lambda v: pa.array(v.tolist(), pa.list_(pa.float64()))
    ids = np.array([f"{i:03}" for i in range(300)])
    meeting = cells._Best(pa.table({"block": np.zeros(300, int), "query_id": np.arange(300), "more": np.full(300, np.nan), "embedding": lists(x)}), 7)
    for at in range(0, 300, batch):
        assert list(meeting.take(pa.RecordBatch.from_pydict({"id": ids[at : at + batch], "embedding": lists(x[at : at + batch])}))) == []
        assert meeting.found.num_rows == 300 * min(7, at + batch)
    distance = cells.cosine_distances(x, x)
    want = {(q, ids[i], distance[q, i]) for q in range(300) for i in np.lexsort((np.arange(300), distance[q]))[:7]}
    (found,) = meeting.end()
    assert set(zip(*(c.to_pylist() for c in found.columns), strict=True)) == want


def most_held(meeting, vectors: int, dims: int = 16) -> tuple[int, int]:
    """The most bytes that a part of the queries holds while so many vectors pass by, and the rows it gives."""
    rows, draw = 0, np.random.default_rng(5)
    tracemalloc.start()
    try:
        at_work = meeting()
        for at in range(0, vectors, 500):
            flat = pa.array(draw.normal(size=500 * dims))
            piece = pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + 500)), pa.FixedSizeListArray.from_arrays(flat, dims).cast(pa.list_(pa.float64()))], ["id", "embedding"])
            rows += sum(b.num_rows for b in at_work.take(piece))
        return tracemalloc.get_traced_memory()[1], rows + sum(b.num_rows for b in at_work.end())
    finally:
        tracemalloc.stop()


def part_of_queries(n: int = 400, dims: int = 16) -> pa.Table:
    x = np.random.default_rng(6).normal(size=(n, dims))
    return pa.table({"block": np.zeros(n, int), "query_id": np.arange(n), "more": np.full(n, np.nan), "embedding": pa.array(x.tolist(), pa.list_(pa.float64()))})


def test_best_holds_no_more_for_more_vectors():
    """Neighbours of density clusters: what a task holds doesn't grow with the vectors."""
    queries = part_of_queries()
    few, many = (most_held(lambda: cells._Best(queries, 11), n) for n in (1500, 24_000))
    assert many[0] < 1.2 * few[0]
    assert few[1] == many[1] == 400 * 11


def test_forest_holds_no_more_for_more_vectors():
    """Topics: what a task holds doesn't grow with the vectors, and it gives at most a link for each query and each vector."""
    queries = part_of_queries()
    queries = queries.set_column(2, "more", pa.array(np.ones(400)))
    few, many = (most_held(lambda: cells._Pairs(queries, 0.6, True), n) for n in (1500, 24_000))
    assert many[0] < 1.2 * few[0]
    assert 1500 < few[1] <= 1900 and 24_000 < many[1] <= 24_400
