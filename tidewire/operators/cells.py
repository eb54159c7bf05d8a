"""An index of vectors by cells, for exact nearest neighbours and near pairs.

Vectors are dealt to the nearest of some centres, which come from a sample;
the sample decides how much is read and never what is found. Every cell
keeps how many vectors it has and the largest distance from its centre, its
radius. Distances are those between vectors of length one, for which a cosine
distance c is the straight distance sqrt(2 c); by the triangle inequality no
vector of a cell is nearer to a query than the query's distance from the
centre less the radius. A search reads a query's nearest cells until they
hold k vectors, and then those cells only whose bound doesn't pass the k-th
distance found. Near pairs are searches of all vectors with a fixed reach, each
pair of cells once.

Near cells are packed into blocks of a sixteenth of all vectors, ``SLICE`` at least and ``MOST_SLICE`` at
most, and a cell of more is cut into several; the queries that read a block are cut into parts likewise.
So a query is sent once for each block and not for each cell, and the rows sent grow with the vectors as
long as blocks do. A task holds the queries of one part while the block's
vectors pass by, so its memory doesn't depend on either number, and no cell, however many equal vectors it
holds, is in one task. Products are made in single precision, and those that could count
are computed anew in double precision.
Centres, sizes and radii, at most ``MOST_CELLS`` rows, and the sample are all that the driver sees.

Defined cases: null vectors are left out. Vectors of zeros have the cosine
distance 1 from all, and a cell of their own, number -1. Ties go to the
smaller id. Without vectors or queries there are no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.workspace import scratch, written

#: Vectors of a block and queries of a part, at least and at most; between, so many of each.
SLICE, QUERIES = 4096, 1024
MOST_SLICE, MOST_QUERIES = 1 << 16, 1 << 14
SHARES = 16
#: Entries of a matrix that a task makes at a time.
ENTRIES = 1 << 22
MOST_CELLS = 4096
#: Vectors of the sample for each cell, and rounds in which its centres are moved.
SAMPLED, MOVES = 32, 4
#: Distances are rounded to so many places before they are ordered; bounds leave room for that.
PLACES, SLACK = 9, 1e-4
ZEROS = -1
APART = np.sqrt(2.0)


def _matrix(column: pa.Array) -> np.ndarray:
    if not len(column):
        return np.zeros((0, 1))
    lengths = pc.min_max(column.value_lengths()).as_py()
    if column.null_count or lengths["min"] != lengths["max"]:
        return np.array(column.to_pylist(), np.float64)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _steps(n: int, width: int) -> Iterator[slice]:
    """Stretches of ``n`` rows of so many columns, each of a bounded size."""
    step = max(1, ENTRIES // max(1, width))
    return (slice(at, min(n, at + step)) for at in range(0, n, step))


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def cosine_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rounded cosine distances of the rows; 1 where either is zero."""
    size = np.sqrt((a * a).sum(axis=1)[:, None] * (b * b).sum(axis=1)[None, :])
    return np.round(1 - np.where(size > 0, a @ b.T / np.where(size > 0, size, 1), 0), PLACES)


def reach(distance: np.ndarray | float) -> np.ndarray | float:
    """The straight distance of a cosine distance, with room for rounding."""
    return np.sqrt(np.maximum(2 * np.asarray(distance, np.float64), 0)) + SLACK


class Known(NamedTuple):
    """What is known of cells: a row for each in every array."""

    numbers: np.ndarray
    sizes: np.ndarray
    radii: np.ndarray
    centres: np.ndarray

    @property
    def slices(self) -> np.ndarray:
        """Blocks that hold a part of each cell."""
        return -(-self.sizes // self.block_size)

    @property
    def block_size(self) -> int:
        return max(SLICE, min(MOST_SLICE, int(self.sizes.sum()) // SHARES))

    def first_blocks(self) -> np.ndarray:
        """The first block of each cell: near cells share one, and one of several slices has its own."""
        slices, size = self.slices, self.block_size
        heads = centres_of(self.centres, max(1, int(self.sizes.sum()) // size))
        order = np.argsort(nearest_centres(self.centres, heads)[0], kind="stable")
        first, block, room = np.zeros(len(self.numbers), int), -1, 0
        for cell in order:  # at most MOST_CELLS and one
            if slices[cell] > 1 or self.sizes[cell] > room:
                first[cell], block = block + 1, block + slices[cell]
                room = size if slices[cell] == 1 else 0
            else:
                first[cell] = block
            room = max(0, room - self.sizes[cell])
        return first

    def bounds(self, x: np.ndarray) -> np.ndarray:
        """The least distance that any vector of each cell can have from the rows of ``x``."""
        u = unit(x)
        apart = np.sqrt(np.maximum((u * u).sum(axis=1)[:, None] - 2 * u @ self.centres.T + (self.centres * self.centres).sum(axis=1), 0))
        out = np.maximum(apart - self.radii, 0)
        out[:, self.numbers == ZEROS] = APART
        out[~u.any(axis=1)] = APART
        return out


class Cells:
    """An index: ``table(cell, slice, id, embedding)`` and what is known of its cells."""

    def __init__(self, table: DataFrame, known: Known):
        self.table, self.known = table, known

    def save(self, path: str) -> None:
        """Vectors in folders by cell, and a row for each cell."""
        self.table.repartition("cell", "slice").write.partitionBy("cell").parquet(f"{path}/vectors")
        rows = [(int(n), int(s), float(r), c.tolist()) for n, s, r, c in zip(*self.known, strict=True)]
        self.table.sparkSession.createDataFrame(rows, "cell int, size long, radius double, centre array<double>").coalesce(1).write.parquet(f"{path}/cells")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Cells:
        rows = spark.read.parquet(f"{path}/cells").collect()  # at most MOST_CELLS and one
        known = Known(np.array([r.cell for r in rows], int), np.array([r["size"] for r in rows], int), np.array([r.radius for r in rows]), np.array([r.centre for r in rows]))
        return cls(spark.read.parquet(f"{path}/vectors").select("cell", "slice", "id", "embedding"), known)


def nearest_centres(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the nearest centre and the distance from it."""
    at, away, square = np.zeros(len(x), int), np.zeros(len(x)), (centres * centres).sum(axis=1)
    for s in _steps(len(x), len(centres)):
        apart = (x[s] * x[s]).sum(axis=1)[:, None] - 2 * x[s] @ centres.T + square
        at[s] = np.argmin(apart, axis=1)
        away[s] = np.sqrt(np.maximum(apart[np.arange(len(apart)), at[s]], 0))
    return at, away


def centres_of(sample: np.ndarray, count: int) -> np.ndarray:
    """Centres of a sample by some rounds of k-means, from evenly spaced rows of it."""
    centres = sample[:: max(1, len(sample) // count)][:count].copy()
    for _ in range(MOVES):
        at = nearest_centres(sample, centres)[0]
        sums = np.zeros_like(centres)
        np.add.at(sums, at, sample)
        n = np.bincount(at, minlength=len(centres))
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def build(vectors: DataFrame, cells: int | None = None, id_col: str = "id", vector_col: str = "embedding") -> Cells:
    """An index of all vectors; ``cells`` is the square root of their number, unless it is given."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("embedding")).where("embedding is not null")
    n = rows.count()
    count = max(1, min(cells or int(np.sqrt(n)), MOST_CELLS))
    # The smallest hashes, looked for among twice as many, so that one task doesn't sort all.
    low = min((1 << 63) - 1, int(2 * SAMPLED * count / max(n, 1) * 2.0**64) + 1000 - (1 << 63))
    sampled = rows.where(F.xxhash64("id") <= low).orderBy(F.xxhash64("id"), "id").limit(SAMPLED * count).select("embedding").toArrow()
    sample = unit(_matrix(sampled.column("embedding").combine_chunks()))
    sample = sample[sample.any(axis=1)]
    centres = centres_of(sample, count) if len(sample) else np.zeros((1, sample.shape[1] or 1))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u = unit(_matrix(batch.column("embedding")))
            at, away = nearest_centres(u, centres)
            at = np.where(u.any(axis=1), at, ZEROS)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(away), *batch.columns], ["cell", "away", *batch.schema.names])

    with scratch(spark):
        id_type = rows.schema["id"].dataType.simpleString()
        placed = written(rows.mapInArrow(place, f"cell int, away double, id {id_type}, embedding array<double>"), "placed", keep=True)
        found = placed.groupBy("cell").agg(F.count("*").alias("size"), F.max("away").alias("radius")).orderBy("cell").collect()
    numbers, sizes, radii = (np.array([r[c] for r in found], t) for c, t in (("cell", int), ("size", int), ("radius", float)))
    own = np.array([centres[c] if c != ZEROS else np.zeros(centres.shape[1]) for c in numbers]).reshape(len(numbers), centres.shape[1])
    known = Known(numbers, sizes, radii + 1e-9, own)
    slices = by_cell(numbers, known.slices, "slices", spark)
    table = placed.join(F.broadcast(slices), "cell").select("cell", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int").alias("slice"), "id", "embedding")
    return Cells(table, known)


def by_cell(numbers: np.ndarray, values: np.ndarray, name: str, spark: SparkSession) -> DataFrame:
    """A small table of a number for each cell."""
    return spark.createDataFrame(list(zip(map(int, numbers), map(int, values), strict=True)), f"cell int, {name} long")


def visits(known: Known, queries: DataFrame, choose: Callable[[np.ndarray, np.ndarray], np.ndarray], blocks: bool = True) -> DataFrame:
    """``(query_id, embedding, more, places)``: the blocks, or else cells, that each query reads. ``choose`` takes
    the bounds of some queries and their column ``more`` and says which cells as a matrix of truth."""
    first, slices = (known.first_blocks(), known.slices) if blocks else (None, None)
    number = int((first + slices).max()) if blocks else 0

    def of(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not blocks:
            at, cell = np.nonzero(chosen)
            return at, known.numbers[cell]
        holds = np.zeros((len(first), number), np.float32)
        for cell in range(len(first)):
            holds[cell, first[cell] : first[cell] + slices[cell]] = 1
        return np.nonzero(chosen.astype(np.float32) @ holds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in _steps(batch.num_rows, 4 * len(known.numbers)):
                part = batch.slice(s.start, s.stop - s.start)
                at, place = of(choose(known.bounds(_matrix(part.column("embedding"))), part.column("more").to_numpy(zero_copy_only=False)))
                ends = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=part.num_rows))])
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(place.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], [*part.schema.names, "places"])

    rows = queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding"), F.col("more").cast("double").alias("more"))
    return rows.mapInArrow(run, f"query_id {queries.schema['query_id'].dataType.simpleString()}, embedding array<double>, more double, places array<int>")


def probes(known: Known, queries: DataFrame, choose: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """``(query_id, embedding, more, cell)``: the cells that each query reads, as of ``visits``."""
    return visits(known, queries, choose, blocks=False).select("query_id", "embedding", "more", F.explode("places").alias("cell"))


def in_blocks(index: Cells) -> DataFrame:
    """``(block, id, embedding)`` of all vectors."""
    spark, known = index.table.sparkSession, index.known
    first = by_cell(known.numbers, known.first_blocks(), "first", spark)
    slices = by_cell(known.numbers, known.slices, "slices", spark)
    rows = index.table.join(F.broadcast(first), "cell").join(F.broadcast(slices), "cell")
    return rows.select((F.col("first") + F.pmod(F.xxhash64("id"), F.col("slices"))).cast("int").alias("block"), "id", "embedding")


def compare(index: Cells, asked: DataFrame, meet, schema: str) -> DataFrame:
    """What ``meet(queries)`` makes of the vectors of a block, for each part of the queries
    ``asked(query_id, embedding, more, places)`` that read it. It has ``take(vectors)``, called with some
    vectors after the others, and ``end()``; both give batches."""
    spark = asked.sparkSession
    n = F.count("*")
    most = F.greatest(F.lit(QUERIES), F.least(F.lit(MOST_QUERIES), n / SHARES))
    parts = asked.select(F.explode("places").alias("block")).groupBy("block").agg(F.ceil(n / most).cast("int").alias("parts"))  # a row for each block
    kinds = {"query_id": asked.schema["query_id"].dataType, "id": index.table.schema["id"].dataType, "more": "double"}
    nothing = lambda c: F.lit(None).cast(kinds[c]).alias(c)
    key = ["block", "part"]
    left = asked.withColumn("block", F.explode("places")).join(F.broadcast(parts), "block").withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int"))
    right = in_blocks(index).join(F.broadcast(parts), "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    both = left.select(*key, F.lit(0).alias("side"), "query_id", nothing("id"), "more", "embedding").union(right.select(*key, F.lit(1).alias("side"), nothing("query_id"), "id", nothing("more"), "embedding"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, at_work = None, [], None
        for batch in batches:
            marks = np.array([batch.column(c).to_numpy() for c in (*key, "side")])
            ends = [*(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1), batch.num_rows]
            for start, end in zip([0, *ends[:-1]], ends, strict=True):
                if start == end:
                    continue
                block, part, side = marks[:, start]
                if (block, part) != now:
                    if at_work:
                        yield from at_work.end()
                    now, held, at_work = (block, part), [], None
                piece = batch.slice(start, end - start)
                if side == 0:
                    held.append(piece)
                elif held:
                    at_work = at_work or meet(pa.Table.from_batches(held).combine_chunks())
                    yield from at_work.take(piece)
        if at_work:
            yield from at_work.end()

    return both.repartition(tasks, *key).sortWithinPartitions(*key, "side").mapInArrow(run, schema)


class _Meeting:
    """Queries of one part, and which of some vectors could be near enough to them."""

    def __init__(self, queries: pa.Table):
        one = lambda c: queries.column(c).combine_chunks()
        self.query_id, self.more = one("query_id"), one("more").to_numpy(zero_copy_only=False).astype(np.float64)
        self.block = int(queries.column("block")[0].as_py())
        self.x = _matrix(one("embedding"))
        self.u = self.single(self.x)
        # More than products of unit vectors in single precision are off.
        self.off = (self.x.shape[1] + 8) * 1.2e-7

    @staticmethod
    def single(x: np.ndarray) -> np.ndarray:
        return np.where(np.isfinite(x).all(axis=1, keepdims=True), unit(x), 0).astype(np.float32)

    def exact(self, v: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
        """Rounded cosine distances of the given queries and vectors."""
        out = np.empty(len(at))
        a, b = (self.x * self.x).sum(axis=1), (v * v).sum(axis=1)
        for s in _steps(len(at), v.shape[1]):
            size = np.sqrt(a[at[s]] * b[to[s]])
            product = np.einsum("ij,ij->i", self.x[at[s]], v[to[s]])
            out[s] = np.round(1 - np.where(size > 0, product / np.where(size > 0, size, 1), np.where(size == 0, 0, size)), PLACES)
        return out


class _Best(_Meeting):
    """The k nearest vectors of each query, among those no farther than ``more``."""

    def __init__(self, queries: pa.Table, k: int):
        super().__init__(queries)
        self.k, self.limit, self.found = k, np.where(np.isnan(self.more), np.inf, self.more), None

    def take(self, vectors: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        v = _matrix(vectors.column("embedding"))
        w = self.single(v)
        for s in _steps(len(self.u), len(w)):
            product = self.u[s] @ w.T
            least = 1 - self.limit[s] - self.off
            if len(first := np.flatnonzero(np.isinf(least))) and len(w) > self.k:
                least[first] = np.partition(product[first], len(w) - self.k, axis=1)[:, len(w) - self.k] - 2 * self.off
            at, to = np.nonzero(product >= least[:, None].astype(np.float32))
            if len(at):
                self.add(at + s.start, self.exact(v, at + s.start, to), vectors.column("id").take(pa.array(to)))
        return iter(())

    def add(self, row: np.ndarray, distance: np.ndarray, ids: pa.Array) -> None:
        table = pa.table({"row": row, "distance": distance, "id": ids})
        if self.found is not None:
            known = np.zeros(len(self.u), bool)
            known[row] = True
            again = pa.array(known[self.found.column("row").to_numpy()])
            kept, table = self.found.filter(pc.invert(again)), pa.concat_tables([self.found.filter(again), table])
        table = table.take(pc.sort_indices(table, [("row", "ascending"), ("distance", "ascending"), ("id", "ascending")]))
        row = table.column("row").to_numpy()
        begins = np.flatnonzero(np.diff(row, prepend=-1))
        place = np.arange(len(row)) - np.repeat(begins, np.diff([*begins, len(row)]))
        last = place == self.k - 1
        self.limit[row[last]] = np.fmin(self.limit[row[last]], table.column("distance").to_numpy()[last])
        table = table.filter(pa.array(place < self.k))
        self.found = table if self.found is None else pa.concat_tables([kept, table]).combine_chunks()

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.found is not None:
            found = self.found.combine_chunks()
            one = lambda c: found.column(c).combine_chunks()
            yield pa.RecordBatch.from_arrays([self.query_id.take(one("row")), one("id"), one("distance")], ["query_id", "id", "distance"])


def nearest(index: Cells, queries: DataFrame, k: int = 10, most_cells: int | None = None) -> DataFrame:
    """``(query_id, id, distance, position)``: the k nearest vectors of each query
    by cosine. With ``most_cells`` a query reads its nearest cells only, so
    that some neighbours may be missed."""
    return search(index, queries, k, most_cells)[0]


def search(index: Cells, queries: DataFrame, k: int = 10, most_cells: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows of ``nearest``, and what was read: ``(query_id, cell)``."""
    spark = queries.sparkSession
    asked = queries.where("embedding is not null").select("query_id", "embedding")
    kinds = f"query_id {asked.schema['query_id'].dataType.simpleString()}, id {index.table.schema['id'].dataType.simpleString()}, distance double"
    if not len(index.known.numbers):
        return spark.createDataFrame([], f"{kinds}, position int"), spark.createDataFrame([], "query_id long, cell int")
    sizes = index.known.sizes

    def nearest_cells(bounds: np.ndarray) -> np.ndarray:
        """The cells of least bounds that hold k vectors together, or the given number of cells."""
        order = np.argsort(bounds, axis=1, kind="stable")
        before = np.cumsum(sizes[order], axis=1) - sizes[order]
        take = before < k if most_cells is None else np.arange(len(sizes)) < np.full((len(bounds), 1), most_cells)
        out = np.zeros(bounds.shape, bool)
        np.put_along_axis(out, order, take, axis=1)
        return out

    order = Window.partitionBy("query_id").orderBy("distance", "id")
    best = lambda queries: _Best(queries, k)
    first, near = asked.withColumn("more", F.lit(None).cast("double")), lambda bounds, _: nearest_cells(bounds)
    hits = compare(index, written(visits(index.known, first, near), "visits"), best, kinds).withColumn("position", F.row_number().over(order))
    read = probes(index.known, first, near).select("query_id", "cell")
    if most_cells is None:
        # The k-th distance so far, within which all cells are read; without k vectors that is all cells.
        last = hits.where(F.col("position") == k).select("query_id", F.col("distance").alias("more"))
        rest, within = asked.join(last, "query_id", "left"), lambda bounds, limit: ~(bounds > reach(limit)[:, None])
        hits = compare(index, written(visits(index.known, rest, within), "visits"), best, kinds).withColumn("position", F.row_number().over(order))
        read = read.union(probes(index.known, rest, within).select("query_id", "cell")).distinct()
    return hits.where(F.col("position") <= k), read


class _Pairs(_Meeting):
    """Pairs of queries and vectors within a distance; with ``forest`` those only that connect what wasn't connected yet."""

    def __init__(self, queries: pa.Table, limit: float, forest: bool):
        super().__init__(queries)
        self.limit, self.forest = limit, forest
        self.a, self.own = self.query_id.to_numpy(), self.more == self.block
        self.group = np.arange(len(self.a))

    def take(self, vectors: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        v, b = _matrix(vectors.column("embedding")), vectors.column("id").to_numpy()
        w, least = self.single(v), np.float32(1 - self.limit - self.off)
        head = np.full(len(w), -1)  # the query to which each vector is tied
        for s in _steps(len(self.u), len(w)):
            at, to = np.nonzero(self.u[s] @ w.T >= least)
            at += s.start
            # Within a block each pair is met from both sides and taken from one.
            kept = np.where(self.own[at], self.a[at] < b[to], self.a[at] != b[to])
            at, to = at[kept], to[kept]
            distance = self.exact(v, at, to)
            kept = distance <= self.limit
            at, to, distance = at[kept], to[kept], distance[kept]
            if self.forest:
                kept = self.joins(at, to, head)
                at, to, distance = at[kept], to[kept], distance[kept]
            if len(at):
                ends = [np.minimum(self.a[at], b[to]), np.maximum(self.a[at], b[to])]
                yield pa.RecordBatch.from_arrays([*(pa.array(e.astype(np.int64)) for e in ends), pa.array(np.round(1 - distance, PLACES))], ["a", "b", "similarity"])

    def joins(self, at: np.ndarray, to: np.ndarray, head: np.ndarray) -> np.ndarray:
        """Which links are needed: the first one of each vector, and others that join groups of queries."""
        new, first = np.unique(to, return_index=True)
        new, first = new[head[new] < 0], first[head[new] < 0]
        needed = np.zeros(len(at), bool)
        needed[first] = True
        head[new] = at[first]
        head, root = head[to], self.group

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for i in np.flatnonzero(root[at] != root[head]):
            x, y = top(at[i]), top(head[i])
            if x != y:
                root[max(x, y)] = min(x, y)
                needed[i] = True
        while (root[root] != root).any():
            root[:] = root[root]
        return needed

    def end(self) -> Iterator[pa.RecordBatch]:
        return iter(())


def near_pairs(index: Cells, threshold: float, forest: bool = False) -> DataFrame:
    """``(a, b, similarity)`` for all pairs a < b of integer ids of cosine at least
    ``threshold``. With ``forest``, only so many of them that the same vectors are connected:
    at most one row for each query and each vector of a part and a block."""
    if not len(index.known.numbers):
        return index.table.sparkSession.createDataFrame([], "a long, b long, similarity double")
    limit = round(1 - threshold, PLACES)
    far = float(reach(limit))
    # A vector reads its own block and those after it.
    rows = in_blocks(index).select(F.col("id").cast("long").alias("query_id"), "embedding", F.col("block").alias("more"))
    own = F.col("more").cast("int")
    asked = visits(index.known, rows, lambda bounds, _: bounds <= far).withColumn("places", F.filter(F.array_union("places", F.array(own)), lambda b: b >= own))
    return compare(index, written(asked, "visits"), lambda queries: _Pairs(queries, limit, forest), "a long, b long, similarity double")
