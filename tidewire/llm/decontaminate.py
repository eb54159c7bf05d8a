"""Benchmark decontamination: SimHash windows, Hamming multi-index, exact check.

Each benchmark item is compared with the windows of a document that have
as many words as the item. Items and windows are multisets of five-word
shingles. A window's SimHash has 128 bits; an index of 8 blocks of 16 bits
finds every item within ``RADIUS`` = 39 bits of it, since of 39 different
bits at most four can fall into each block unless some block has fewer. Of
unlike pairs about 27 % share a block so far. A block is probed with all 2,517
values within four bits of the window's, or, where the items have fewer
values, with those. Found pairs are verified by exact weighted Jaccard
similarity (sum of minima over sum of maxima of the counts). At a
similarity of 0.8 and equal sizes the expected distance is 19 bits with a
deviation of 4; of several thousand measured pairs at 0.8 or more none was
beyond 30.

A window is fingerprinted only if enough of its shingles occur in the
benchmark at all; with fewer it can't reach the threshold. Texts are
fingerprinted in stretches and windows are probed in batches, so neither a
long document nor one full of passages needs much memory at a time.

The benchmark is a stated query set. It is written in blocks of a bounded
size to the shared folder; each block is a pass over all documents, whose
tasks read it there and index it once a worker. No item goes to the driver.

Defined cases: items without words (null text included) match nothing. An
item of under five words is one shingle, its whole sequence, and matches
where it occurs. A document of fewer words than an item is one window. A
null document text has no window. Of several windows the most similar
counts, then the first. Repeated documents or items are reported each, but
rows with equal ids once. Empty tables give no match. Only the named
columns are read, so other columns can't clash.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import trimmed, written_at
from .shingles import WORDS, _PLACE, text_batches, words_of
from .syncmers import mix

THRESHOLD = 0.8
BITS, BLOCKS, RADIUS = 128, 8, 39
#: Largest distance within some block for fingerprints within RADIUS.
PER_BLOCK = RADIUS // BLOCKS
#: Bytes of benchmark text in one block.
BLOCK_BYTES = 4 << 20
#: Pairs of windows and items that are probed at a time, at most.
PAIRS = 1 << 20
#: Shingles that are fingerprinted at a time.
STRETCH = 1 << 14

_SECOND = np.uint64(0x5851F42D4C957F2D)
_ONES = np.bitwise_count(np.arange(1 << 16, dtype=np.uint16))
#: All 16-bit values with so few bits.
_NEAR = np.flatnonzero(_ONES <= PER_BLOCK).astype(np.uint16)


def grams(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` words, up to five."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, size, np.uint64)
    for i in range(size):
        total += words[i : i + n] * _PLACE[i]
    return mix(total)


def sign_sums(shingles: np.ndarray) -> np.ndarray:
    """Prefix sums of the shingles' bits as +1 and -1, a row for each place."""
    both = np.stack([shingles, mix(shingles ^ _SECOND)], axis=1)
    bits = np.unpackbits(np.ascontiguousarray(both).view(np.uint8), axis=1).astype(np.int32)
    return np.concatenate([np.zeros((1, BITS), np.int32), np.cumsum(2 * bits - 1, axis=0, dtype=np.int32)])


def fingerprints(sums: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHashes, 16 bytes each, of the windows of ``size`` shingles."""
    return np.packbits(sums[starts + size] - sums[starts] > 0, axis=1)


def fingerprint(shingles: np.ndarray) -> np.ndarray:
    """The SimHash of all shingles as one row."""
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(shingles), STRETCH):
        total += sign_sums(shingles[at : at + STRETCH])[-1]
    return np.packbits(total > 0)[None, :]


class HammingIndex:
    """Fingerprints by the values of their blocks."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        self.values, self.start, self.members = [], [], []
        for b in range(BLOCKS):
            block = prints.view(np.uint16)[:, b]
            values, size = np.unique(block, return_counts=True)
            self.values.append(values)
            self.start.append(np.r_[0, np.cumsum(size)])
            self.members.append(np.argsort(block, kind="stable"))

    def _block(self, b: int, windows: np.ndarray) -> np.ndarray:
        """Pairs of window and item, as window * items + item, whose blocks are near."""
        values = self.values[b]
        block = windows.view(np.uint16)[:, b]
        if len(values) <= len(_NEAR):
            w, v = np.nonzero(_ONES[block[:, None] ^ values] <= PER_BLOCK)
        else:
            probes = block[:, None] ^ _NEAR
            v = np.minimum(np.searchsorted(values, probes), len(values) - 1)
            w, at = np.nonzero(values[v] == probes)
            v = v[w, at]
        low = self.start[b][v]
        n = self.start[b][v + 1] - low
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        return np.repeat(w, n) * len(self.prints) + self.members[b][at]

    def candidates(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (window, item) with a block within ``PER_BLOCK`` bits."""
        pairs = np.unique(np.concatenate([self._block(b, windows) for b in range(BLOCKS)]))
        return pairs // len(self.prints), pairs % len(self.prints)

    def within(self, windows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs (window, item) within RADIUS, in batches of windows."""
        step = max(1, PAIRS // max(len(self.prints), len(_NEAR)))
        for at in range(0, len(windows), step):
            part = windows[at : at + step]
            w, i = self.candidates(part)
            close = _ONES[part.view(np.uint16)[w] ^ self.prints.view(np.uint16)[i]].sum(axis=1, dtype=np.int64) <= RADIUS
            yield w[close] + at, i[close]


def weighted_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two multisets of shingles."""
    values, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = np.bincount(where[: len(a)], minlength=len(values)), np.bincount(where[len(a) :], minlength=len(values))
    return float(np.minimum(x, y).sum() / np.maximum(x, y).sum())


class Benchmark:
    """A block of items, indexed by length."""

    def __init__(self, items: list[tuple[int, str | None]], threshold: float):
        self.threshold = threshold
        words = words_of([(t or "").encode() for _, t in items])
        self.by_length: dict[int, list[tuple[int, np.ndarray]]] = defaultdict(list)
        for (item_id, _), w in zip(items, words, strict=True):
            if len(w):
                self.by_length[len(w)].append((item_id, grams(w, min(WORDS, len(w)))))
        self.index = {n: HammingIndex(np.concatenate([fingerprint(s) for _, s in found])) for n, found in self.by_length.items()}
        self.known = {g: np.unique(np.concatenate([s for n, f in self.by_length.items() for _, s in f if min(n, WORDS) == g])) for g in {min(n, WORDS) for n in self.by_length}}
        # A bit for each value of the low 20 bits, to skip the search for most shingles.
        self.maybe = {g: np.isin(np.arange(1 << 20), (k & np.uint64((1 << 20) - 1)).astype(np.int64)) for g, k in self.known.items()}

    def _hits(self, shingles: np.ndarray, g: int) -> np.ndarray:
        hit = self.maybe[g][(shingles & np.uint64((1 << 20) - 1)).astype(np.int64)]
        at = np.flatnonzero(hit)
        known = self.known[g]
        place = np.minimum(np.searchsorted(known, shingles[at]), len(known) - 1)
        hit[at] = known[place] == shingles[at]
        return hit

    def matches(self, words: np.ndarray) -> list[tuple[int, float, int, int]]:
        """(item, similarity, first word, words) of the best window for each item found."""
        best: dict[int, tuple[float, int, int]] = {}
        for g in self.known:
            shingles = grams(words, g)
            hit = self._hits(shingles, g)
            hits = np.r_[0, np.cumsum(hit)]
            windows = []
            for n in self.by_length:
                size, need = min(n - g + 1, len(shingles)), math.ceil(self.threshold * (n - g + 1) - 1e-9)
                if min(n, WORDS) == g and hits[-1] >= need and size >= need and len(starts := np.flatnonzero(hits[size:] - hits[:-size] >= need)):
                    windows.append((n, size, starts))
            reach = max((size for _, size, _ in windows), default=0)
            for low in range(0, len(shingles), STRETCH) if windows else ():
                sums = None
                for n, size, starts in windows:
                    a, b = np.searchsorted(starts, [low, low + STRETCH])
                    if a < b:
                        sums = sign_sums(shingles[low : low + STRETCH + reach]) if sums is None else sums
                        self._match(best, n, shingles, starts[a:b], size, fingerprints(sums, starts[a:b] - low, size), len(words))
        return [(item_id, *found) for item_id, found in best.items()]

    def _match(self, best: dict, n: int, shingles: np.ndarray, starts: np.ndarray, size: int, prints: np.ndarray, words: int) -> None:
        """Better windows of the items of ``n`` words, put into ``best``."""
        found = self.by_length[n]
        for ws, items in self.index[n].within(prints):
            for at, i in zip(starts[ws].tolist(), items.tolist(), strict=True):
                item_id, own = found[i]
                score = weighted_similarity(own, shingles[at : at + size])
                if score >= self.threshold and (item_id not in best or (-score, at) < (-best[item_id][0], best[item_id][1])):
                    best[item_id] = (score, at, min(n, words))


def item_blocks(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> list[tuple[str, int]]:
    """The benchmark as written in blocks of about ``BLOCK_BYTES`` of text each: their folders and numbers of items."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    n = max(1, math.ceil(size / BLOCK_BYTES))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).cast("int")
    path = written_at(items.withColumn("block", block).repartition(n, "block"), "benchmark", by="block", keep=True)
    rows = {r.block: r["count"] for r in items.sparkSession.read.parquet(path).groupBy("block").count().collect()} if not items.isEmpty() else {}  # a row for each block
    return [(f"{path}/block={b}", rows.get(b, 0)) for b in range(n)]


@lru_cache(maxsize=2)
def load_block(path: str, n: int, threshold: float) -> Benchmark:
    """A worker's index of a block of ``n`` items; one that isn't there whole raises."""
    store, at = pafs.FileSystem.from_uri(path)
    files = store.get_file_info(pafs.FileSelector(at, allow_not_found=True))
    items: list[tuple[int, str | None]] = []
    for f in sorted(f.path for f in files if f.path.endswith(".parquet")):
        rows = pq.read_table(store.open_input_file(f), columns=["item_id", "text"])
        items += zip(rows["item_id"].to_pylist(), rows["text"].to_pylist(), strict=True)
    if len(items) != n:
        raise FileNotFoundError(f"{path} has {len(items)} of {n} benchmark items")
    return Benchmark(items, threshold)


MATCHES = "doc_id long, item_id long, similarity double, first_word long, n_words long"


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``(doc_id, item_id, similarity, first_word, n_words)``: every document with
    a window at least ``threshold`` similar to an item, and the best such window."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def finder(path: str, n: int):
        @trimmed
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = load_block(path, n, threshold)
            for ids, texts in text_batches(batches):
                found = [(i, *m) for i, w in zip(ids, words_of(texts), strict=True) for m in index.matches(w)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "item_id", "similarity", "first_word", "n_words"])

        return run

    out = None
    for path, n in item_blocks(benchmark, item_col, item_text_col):
        part = rows.mapInArrow(finder(path, n), MATCHES)
        out = part if out is None else out.union(part)
    best = F.min(F.struct((-F.col("similarity")).alias("s"), "first_word", "n_words")).alias("b")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", (-F.col("b.s")).alias("similarity"), "b.first_word", "b.n_words")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a benchmark item, all columns as they
    are. Rows are judged where they stand; nothing is shuffled."""

    def dropper(path: str, n: int):
        @trimmed
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = load_block(path, n, threshold)
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    texts = [(t or "").encode() for t in part.column(text_col).to_pylist()]
                    yield part.filter(pa.array([not index.matches(w) for w in words_of(texts)], pa.bool_()))

        return run

    out = docs
    for path, n in item_blocks(benchmark):
        out = out.mapInArrow(dropper(path, n), docs.schema)
    return out
