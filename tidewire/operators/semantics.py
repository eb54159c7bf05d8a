"""Embeddings learned from the corpus, shared by documents and queries.

Words are put into a fixed number of features by a hash. A text is its
features' weights, ``ln(1 + count) * ln((n + 1) / (documents with it + 1))``,
brought to length one. The embedding is the truncated singular value
decomposition of all texts' weights A (texts by features), so features of
words that keep the same company point the same way. It is found by a
randomized sketch: Y = A G with a random G of a few more columns than
dimensions; in the same pass Y'Y and Z = A'Y, summed by Spark. A factor R with R'R = Y'Y
comes from the small square matrix, without directions too weak for it (``WEAK``); then
Z R^-1 is the transpose of A within the basis of Y, and its singular
vectors come from its columns' inner products, a small square matrix. With
``rounds``, Z R^-1 takes G's place first, which sharpens the basis. So a round is one pass
over the texts' distinct features, which are counted once before. The
driver sees square matrices of the sketch's width and the model itself,
features by dimensions, whose size is a parameter.

A new text, such as a query, is folded in: its weights times the features'
vectors, brought to length one.

Defined cases: null texts and texts without words of the corpus have the
embedding of zeros. Without texts, all embeddings are zeros. Fewer texts or
features than dimensions leave the last dimensions at zero.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.workspace import scratch, written

DIMS, FEATURES = 64, 1 << 14
#: Columns of the sketch beyond the dimensions, and rounds that sharpen it.
MORE, ROUNDS = 16, 1
#: Texts that a task of a round sums at least, where there are more tasks than cores.
TEXTS = 1 << 16
#: Bytes of a model at most, as it is sent to all tasks.
MOST_BYTES = 256 << 20
#: Directions of a sketch that are weaker than its strongest by this are left out.
WEAK = 1e-6
WORD = r"[^\p{L}0-9]+"


def features_of(text: Column, features: int) -> Column:
    """The features of a text's words, once for each occurrence."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), WORD), "")
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(features)).cast("int"))


def _counted(column: pa.Array, features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, distinct features and their counts of a column of feature lists."""
    lists = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(column)), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    keys, counts = np.unique(row * features + lists, return_counts=True)
    return keys // features, keys % features, counts


def _weighted(row: np.ndarray, feature: np.ndarray, counts: np.ndarray, idf: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, features and weights, each of the ``n`` rows of length one."""
    weight = np.log1p(counts) * idf[feature]
    norm = np.sqrt(np.bincount(row, weight * weight, n))
    return row, feature, weight / np.where(norm > 0, norm, 1)[row]


def _sparse(column: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, features and weights of a column of feature lists, each row of length one."""
    return _weighted(*_counted(column, len(idf)), idf, len(column))


def _dense(row: np.ndarray, feature: np.ndarray, weight: np.ndarray, n: int, features: int) -> tuple[np.ndarray, np.ndarray]:
    """The sparse rows as a matrix of the features that occur in them, and those features: a product
    of matrices takes a small part of the time of one entry by entry."""
    seen = np.zeros(features, bool)
    seen[feature] = True
    out = np.zeros((n, np.count_nonzero(seen)))
    out[row, (np.cumsum(seen) - 1)[feature]] = weight
    return out, np.flatnonzero(seen)


def _times(row: np.ndarray, feature: np.ndarray, weight: np.ndarray, matrix: np.ndarray, n: int) -> np.ndarray:
    """The sparse rows times a matrix."""
    some, seen = _dense(row, feature, weight, n, len(matrix))
    return some @ matrix[seen]


def _parts(batch: pa.RecordBatch, most: int = 256) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, most):
        yield batch.slice(at, most)


class Semantics:
    """A fitted embedding: inverse document frequencies and a vector of each feature."""

    def __init__(self, idf: np.ndarray, vectors: np.ndarray):
        self.idf, self.vectors = idf, vectors

    @property
    def dims(self) -> int:
        return self.vectors.shape[1]

    def embed(self, texts: DataFrame, text_col: str = "document") -> DataFrame:
        """``texts`` with an ``embedding``."""
        spark, idf, dims, features = texts.sparkSession, self.idf, self.dims, len(self.idf)
        sent = spark.sparkContext.broadcast(self.vectors)  # of a checked size
        kept = texts.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vectors = sent.value
            for batch in batches:
                for part in _parts(batch):
                    x = _times(*_sparse(part.column("_features"), idf), vectors, part.num_rows)
                    norm = np.linalg.norm(x, axis=1, keepdims=True)
                    x = (x / np.where(norm > 1e-9, norm, np.inf)).astype(np.float32)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, dims, dtype=np.int32)), pa.array(x.ravel()))
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), lists], [*kept, "embedding"])

        schema = T.StructType([*texts.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])
        return texts.withColumn("_features", features_of(F.col(text_col), features)).mapInArrow(run, schema)

    def save(self, spark: SparkSession, path: str) -> None:
        rows = zip(range(len(self.idf)), self.idf.tolist(), self.vectors.tolist(), strict=True)
        spark.createDataFrame(list(rows), "feature int, idf double, vector array<float>").write.parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Semantics:
        """A saved model; its rows are as many as it has features."""
        rows = spark.read.parquet(path).orderBy("feature").collect()
        return cls(np.array([r.idf for r in rows]), np.array([r.vector for r in rows], np.float32))


def counted(texts: DataFrame, text_col: str, features: int) -> DataFrame:
    """``(f, n)``: the distinct features of each text that has any, in order, and how often they occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                row, feature, counts = _counted(part.column("f"), features)
                own = np.bincount(row, minlength=part.num_rows)
                ends = pa.array(np.concatenate([[0], np.cumsum(own[own > 0])]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (feature, counts)], ["f", "n"])

    # Texts without features are left out above: a condition on ``f`` would make them twice.
    rows = texts.select(features_of(F.col(text_col), features).alias("f"))
    return rows.mapInArrow(run, "f array<int>, n array<int>")


def _sketched(rows: DataFrame, idf: np.ndarray, sent, width: int) -> tuple[np.ndarray, np.ndarray]:
    """``Y'Y`` and ``A'Y`` of ``Y = A G``, in one pass: sums of each task, a row for each feature that
    occurs in it and then one for each column of G, added up by Spark."""
    columns, features = [f"z{i}" for i in range(width)], len(idf)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, z, seen = sent.value, np.zeros((features + width, width)), np.zeros(features + width, bool)
        for batch in batches:
            for part in _parts(batch):
                lengths = part.column("f").value_lengths().to_numpy()
                one = lambda c, part=part: part.column(c).flatten().to_numpy()
                sparse = _weighted(np.repeat(np.arange(part.num_rows), lengths), one("f"), one("n"), idf, part.num_rows)
                some, at = _dense(*sparse, part.num_rows, features)
                y = some @ g[at]
                z[at] += some.T @ y
                z[features:] += y.T @ y
                seen[at], seen[features:] = True, True
        at = np.flatnonzero(seen)
        for some in np.array_split(at, max(1, len(at) // 4096)):
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(pa.array(z[some, i]) for i in range(width))], ["feature", *columns])

    summed = rows.mapInArrow(partial, ", ".join(["feature int", *(f"{c} double" for c in columns)])).groupBy("feature").agg(*(F.sum(c).alias(c) for c in columns))
    found, out = summed.toArrow(), np.zeros((features + width, width))  # a row for each feature and column at most
    out[found.column("feature").to_numpy()] = np.column_stack([found.column(c).to_numpy() for c in columns]) if found.num_rows else 0
    return out[features:], out[:features]


def fit(texts: DataFrame, text_col: str = "document", dims: int = DIMS, features: int = FEATURES, rounds: int = ROUNDS, seed: int = 1) -> Semantics:
    """An embedding of ``dims`` dimensions, learned from all ``texts``."""
    width = dims + MORE
    if features * width * 8 > MOST_BYTES:
        raise ValueError(f"a model of {features} features and {dims} dimensions is beyond {MOST_BYTES} bytes")
    spark = texts.sparkSession
    with scratch(spark):
        rows = written(counted(texts, text_col, features), "features")
        n = rows.count()
        # A task's sums are as large as the model, however few texts it has: tasks go by texts, not by files.
        rows = rows.coalesce(max(spark.sparkContext.defaultParallelism, n // TEXTS))
        idf = np.zeros(features)
        for r in rows.select(F.explode("f").alias("f")).groupBy("f").count().collect():  # a row for each feature at most
            idf[r.f] = np.log((n + 1) / (r["count"] + 1))
        vectors = np.zeros((features, dims))
        g = np.random.default_rng(seed).standard_normal((features, width))
        for left in range(rounds, -1, -1):
            sent = spark.sparkContext.broadcast(g)
            square, z = _sketched(rows, idf, sent, width)
            sent.unpersist()
            # What is left of R where the sketch has fewer directions than columns.
            size, turn = np.linalg.eigh(square)
            size = np.sqrt(np.maximum(size, 0))
            real = size > WEAK * size.max(initial=0)
            inside = z @ (turn[:, real] / size[real])
            if left:
                g, _ = np.linalg.qr(np.pad(inside, ((0, 0), (0, width - inside.shape[1]))))
                continue
            value, side = np.linalg.eigh(inside.T @ inside)
            keep = np.flatnonzero(value > 1e-20 * value.max(initial=0))[::-1][:dims]
            vectors[:, : len(keep)] = inside @ side[:, keep] / np.sqrt(value[keep])
    return Semantics(idf, vectors.astype(np.float32))
