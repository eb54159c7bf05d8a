"""Search: embeddings, index tables, nearest documents of many queries.

Distances are computed per Arrow batch as one matrix product of the batch
with a block of queries; each task keeps the k best of each query, and a
window merges them. The queries are a stated set, sent along in blocks of
a bounded size; the documents are read once a block and never collected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.feature import IDF, HashingTF, Normalizer, Tokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.labels import document_id, explanation, similarity
from ..functions.rows import with_index
from ..schemas import require
from . import cells
from .semantics import Semantics

QUERY_LEAST, QUERY_MOST = 3, 100
RESULTS, THRESHOLD = 10, 0.7
#: Queries sent along with one pass over the documents.
QUERY_BLOCK = 1024
#: Documents compared with a block at a time.
ROWS = 1024
#: Distances are rounded to so many places before they are ordered.
PLACES = 9


def valid_queries(queries: DataFrame) -> DataFrame:
    """Queries of at least 3 characters without surrounding space and at most 100 with it."""
    return queries.where((F.length(F.trim("query")) >= QUERY_LEAST) & (F.length("query") <= QUERY_MOST))


def where(condition: dict, of: Callable[[str], Column] = F.col) -> Column:
    """A filter document as a predicate: ``{"score": {"$gte": 10}}``.

    Equality, ``$eq $ne $gt $gte $lt $lte $in $nin``, and ``$and``/``$or`` of lists.
    """
    compare = {
        "$eq": lambda c, v: c == v,
        "$ne": lambda c, v: c != v,
        "$gt": lambda c, v: c > v,
        "$gte": lambda c, v: c >= v,
        "$lt": lambda c, v: c < v,
        "$lte": lambda c, v: c <= v,
        "$in": lambda c, v: c.isin(list(v)),
        "$nin": lambda c, v: ~c.isin(list(v)),
    }
    out = F.lit(True)
    for key, value in condition.items():
        if key in ("$and", "$or"):
            parts = [where(v, of) for v in value]
            joined = parts[0]
            for p in parts[1:]:
                joined = joined & p if key == "$and" else joined | p
            out = out & joined
            continue
        tests = value if isinstance(value, dict) else {"$eq": value}
        for op, v in tests.items():
            if op not in compare:
                raise ValueError(f"unknown operator {op}")
            out = out & compare[op](of(key), v)
    return out


def embed(texts: DataFrame, text_col: str = "document", dims: int = 256, model=None) -> DataFrame:
    """``texts`` with an ``embedding`` of TF-IDF weights, hashed and normalised.
    ``model``: a fitted pipeline of an earlier call, to embed queries alike."""
    clean = texts.withColumn("_text", F.coalesce(F.col(text_col), F.lit("")))
    fitted = model or fit_embedding(texts, text_col, dims)
    out = fitted.transform(clean)
    return out.withColumn("embedding", vector_to_array("_unit", "float32")).drop("_text", "_words", "_tf", "_idf", "_unit")


def fit_embedding(texts: DataFrame, text_col: str = "document", dims: int = 256):
    stages = [Tokenizer(inputCol="_text", outputCol="_words"), HashingTF(inputCol="_words", outputCol="_tf", numFeatures=dims), IDF(inputCol="_tf", outputCol="_idf"), Normalizer(inputCol="_idf", outputCol="_unit")]
    return Pipeline(stages=stages).fit(texts.withColumn("_text", F.coalesce(F.col(text_col), F.lit(""))))


def embed_with(texts: DataFrame, load: Callable[[], Callable[[list[str]], Iterable[np.ndarray]]], text_col: str = "document", batch: int = 32) -> DataFrame:
    """``texts`` with an ``embedding`` by a user's encoder, loaded once a task
    and called with batches of texts (null as empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load()
        for rows in batches:
            for at in range(0, rows.num_rows, batch):
                part = rows.slice(at, batch)
                vectors = [np.asarray(v, np.float32).tolist() for v in encode([t or "" for t in part.column(text_col).to_pylist()])]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(vectors, pa.list_(pa.float32()))], [*part.schema.names, "embedding"])

    schema = T.StructType([*texts.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])
    return texts.mapInArrow(run, schema)


def build_index(stories: DataFrame, metadata: tuple[str, ...] | None = None) -> DataFrame:
    """``(id, document, embedding, metadata)`` of stories with an ``embedding``.

    Ids follow the score order. Without metadata columns, the metadata is
    the first hundred characters of the text.
    """
    require(stories, "id", "title", "score", "embedding")
    return index_rows(by_place(stories), metadata)


def by_place(stories: DataFrame) -> DataFrame:
    """``stories`` with their place by score as ``_index``. They are dealt by it and written, so where texts or
    vectors can be joined by id afterwards, rows are placed without them."""
    return with_index(stories, F.desc("score"), F.col("id"), name="_index")


def index_rows(placed: DataFrame, metadata: tuple[str, ...] | None = None) -> DataFrame:
    """The rows of ``build_index`` of stories that have their place already."""
    if metadata is None:
        extra = F.struct(F.substring("title", 1, 100).alias("text"))
    else:
        extra = F.struct(*[F.col(c) for c in metadata if c in placed.columns], F.col("_index").cast("int").alias("index"))
    return placed.select(document_id(F.col("_index"), F.col("title")).alias("id"), F.col("title").alias("document"), "embedding", extra.alias("metadata"), F.col("id").alias("story_id"))


def duplicate_ids(index: DataFrame) -> DataFrame:
    return index.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


def _distances(docs: np.ndarray, queries: np.ndarray, metric: str) -> np.ndarray:
    product = docs @ queries.T
    if metric == "ip":
        return 1 - product
    a, b = (docs * docs).sum(axis=1)[:, None], (queries * queries).sum(axis=1)[None, :]
    if metric == "l2sq":
        return a + b - 2 * product
    if metric != "cosine":
        raise ValueError(f"unknown metric {metric}")
    with np.errstate(invalid="ignore", divide="ignore"):
        return 1 - np.where((a > 0) & (b > 0), product / np.sqrt(a * b), 0)


def nearest(index: DataFrame, queries: DataFrame, k: int = RESULTS, metric: str = "cosine", condition: Column | None = None) -> DataFrame:
    """``(query_id, id, distance, position)``: the k nearest documents of each query.

    ``condition`` filters the documents before. Null embeddings are left
    out; ties go to the smaller id.
    """
    docs = (index if condition is None else index.where(condition)).select("id", "embedding").where("embedding is not null")
    asked = queries.select("query_id", "embedding").where("embedding is not null")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    out = None
    for b in range(blocks):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        rows = part.collect()  # one block of the stated query set
        if not rows:
            continue
        found = docs.mapInArrow(_finder([r.query_id for r in rows], np.array([r.embedding for r in rows], np.float64), k, metric, docs), f"query_id long, id {docs.schema['id'].dataType.simpleString()}, distance double")
        out = found if out is None else out.union(found)
    if out is None:
        return docs.sparkSession.createDataFrame([], f"query_id long, id {docs.schema['id'].dataType.simpleString()}, distance double, position int")
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return out.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k)


def _finder(query_ids: list[int], vectors: np.ndarray, k: int, metric: str, docs: DataFrame):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in query_ids]
        id_type = None
        for batch in batches:
            id_type = batch.column("id").type
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                ids = part.column("id").to_pylist()
                distance = np.round(_distances(cells._matrix(part.column("embedding")), vectors, metric), PLACES)
                for q in range(len(query_ids)):
                    column = distance[:, q]
                    limit = np.partition(column, min(k, len(column)) - 1)[min(k, len(column)) - 1]
                    best[q] = sorted([*best[q], *((float(column[i]), ids[i]) for i in np.flatnonzero(column <= limit))])[:k]
        rows = [(q, i, d) for q, found in zip(query_ids, best, strict=True) for d, i in found]
        if rows:
            qs, ids, ds = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(qs, pa.int64()), pa.array(ids, id_type), pa.array(ds, pa.float64())], ["query_id", "id", "distance"])

    return run


def semantic_search(index: DataFrame, queries: DataFrame, k: int = RESULTS, threshold: float | None = THRESHOLD, metric: str = "cosine", condition: Column | None = None, model: Semantics | None = None, of_cells: cells.Cells | None = None) -> DataFrame:
    """Ranked results of valid queries: the k nearest, those under the
    threshold then dropped, so that fewer than k may be left. The words of
    queries are embedded by ``model``, with which the index was made, unless
    the queries bring an ``embedding``.

    ``(query_id, rank, id, document, metadata, similarity_score, distance, explanation)``
    """
    asked = valid_queries(queries)
    if "embedding" not in queries.columns:
        if model is None:
            raise ValueError("queries without an embedding need the model of the index")
        asked = model.embed(asked.select("query_id", "query"), "query")
    if of_cells is not None:
        if metric != "cosine" or condition is not None:
            raise ValueError("an index by cells is for cosines without a condition")
        hits = cells.nearest(of_cells, asked, k)
    else:
        hits = nearest(index, asked, k, metric, condition)
    if threshold is not None:
        hits = hits.where(1 - F.col("distance") >= threshold)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    score = similarity(F.col("distance"))
    return hits.withColumn("rank", rank).join(index.drop("embedding"), "id").select(
        "query_id", "rank", "id", "document", "metadata", score.alias("similarity_score"), F.bround("distance", 3).alias("distance"), explanation(score).alias("explanation")
    )


def near_pairs(vectors: DataFrame, threshold: float, id_col: str = "id", forest: bool = False) -> DataFrame:
    """``(a, b, similarity)`` for all pairs a < b of cosine at least ``threshold``,
    or with ``forest`` as many as connect the same vectors, through an index by cells."""
    return cells.near_pairs(cells.build(vectors, id_col=id_col), threshold, forest)
