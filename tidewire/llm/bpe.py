"""Byte-level BPE: encode and decode with public rank files, in numpy.

Texts are cut by the tokenizer's pattern. The distinct pieces that a worker
has not met are put into buckets by length, each a padded matrix of token
ids with a piece per row. In each round every row merges its leftmost pair
of minimum rank: ranks of adjacent pairs come from a hash table over pairs
of ids, the merged id is written over the pair's left end and the row is
compacted. A piece that is a token itself is taken whole, as the public
library does.

Pieces over ``LONG`` bytes would need as many rounds as they have merges,
each over the whole row. They are merged one by one, by the same order: their
tokens form a linked list, and a heap gives the leftmost pair of minimum
rank, so the work grows with n log n.

Defined cases: a null text is encoded as the empty text: no ids, empty
bytes. Repeated rows are encoded each. Only the id and text columns are
read, so other columns can't clash.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import trimmed

#: Pieces beyond so many bytes are merged through a heap.
LONG = 512
#: Matrices hold so many cells at most.
CELLS = 1 << 20
#: A worker keeps the ids of so many stretches of text, and so many characters of text and bytes
#: of ids with them, then starts anew.
CACHE, CACHE_SIZE = 300_000, 32 << 20
NONE = np.int32(np.iinfo(np.int32).max)

_BREAK = re.compile(r"\s[ \n]")
_CUT = re.compile(r"(?<=\S)(?=[ \n])")


def stretches(text: str) -> list[str]:
    """``text`` cut before each space or line feed that follows a character
    that is not white space. No piece of the pattern crosses such a place."""
    if "\0" in text or _BREAK.search(text):
        return _CUT.split(text) if text else []
    return text.replace("\n", "\0\n").replace(" ", "\0 ").split("\0") if text else []


class PairTable:
    """Open-addressed hash table from a pair of ids to the merged id."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(left)) * 4))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        keys = self._key(left, right)
        slot, todo = self._slot(keys), np.arange(len(keys))
        self.probes = 0
        while len(todo):
            self.probes += 1
            free = self.keys[slot[todo]] < 0
            at = todo[free]
            first = at[np.unique(slot[at], return_index=True)[1]]
            self.keys[slot[first]], self.values[slot[first]] = keys[first], merged[first]
            todo = todo[self.keys[slot[todo]] != keys[todo]]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return left.astype(np.int64) << 32 | right.astype(np.int64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids, which are the ranks; ``NONE`` where a pair doesn't merge."""
        out = np.full(left.shape, NONE, np.int32)
        ok = (left >= 0) & (right >= 0)
        keys = self._key(left[ok], right[ok])
        slot, found = self._slot(keys), np.full(len(keys), NONE, np.int32)
        todo = np.arange(len(keys))
        while len(todo):
            here = self.keys[slot[todo]]
            hit = here == keys[todo]
            found[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (here >= 0)]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
        out[ok] = found
        return out


class ByteBPE:
    """A byte-level BPE by ranks: ``encode`` and ``decode``."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.token = {i: t for t, i in ranks.items()}
        self.byte_id = np.full(256, -1, np.int32)
        for b in range(256):
            self.byte_id[b] = ranks.get(bytes([b]), -1)
        found = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        left, right, merged = np.array(found, np.int32).reshape(-1, 3).T
        self.pairs = PairTable(left, right, merged)
        self.cache: dict[str, bytes] = {}
        self.cached = 0

    @cached_property
    def merges(self) -> dict[int, int]:
        """The pairs as a plain table, for ``merge_long`` alone."""
        used = self.pairs.keys >= 0
        return dict(zip(self.pairs.keys[used].tolist(), self.pairs.values[used].tolist(), strict=True))

    def merge_rows(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces of similar length, one row of a padded matrix each."""
        width = max(map(len, pieces))
        raw = np.frombuffer(b"".join([p.ljust(width, b"\0") for p in pieces]), np.uint8).reshape(len(pieces), width)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids = np.where(np.arange(width) < lengths[:, None], self.byte_id[raw], np.int32(-1))
        rank = np.full(ids.shape, NONE, np.int32)
        rank[:, :-1] = self.pairs.get(ids[:, :-1], ids[:, 1:])
        out = np.full(ids.shape, -1, "<i4")
        rows = np.arange(len(pieces))
        while len(rows):
            at = rank.argmin(axis=1)
            best = rank[np.arange(len(rows)), at]
            keep = best != NONE
            if not keep.all():
                out[rows[~keep], : ids.shape[1]] = ids[~keep]
                rows, ids, rank, lengths, at, best = rows[keep], ids[keep], rank[keep], lengths[keep], at[keep], best[keep]
                if not len(rows):
                    break
            width = int(lengths.max())
            n, cols = np.arange(len(rows)), np.arange(width - 1)
            source = cols + (cols > at[:, None])
            ids = np.take_along_axis(ids, source, 1)
            ids[n, at] = best
            rank = np.take_along_axis(rank, source, 1)
            lengths = lengths - 1
            ids[cols >= lengths[:, None]] = -1
            rank[cols >= (lengths - 1)[:, None]] = NONE
            for shift in (-1, 0):  # only the pairs on either side of a merge are new
                p = at + shift
                ok = (p >= 0) & (p + 1 < lengths)
                rank[n[ok], p[ok]] = self.pairs.get(ids[n[ok], p[ok]], ids[n[ok], p[ok] + 1])
        used = out >= 0
        flat, ends = out[used].tobytes(), (4 * np.cumsum(used.sum(axis=1))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def merge_long(self, piece: bytes) -> np.ndarray:
        """Ids of a long piece: a linked list of tokens and a heap of pairs by rank and place."""
        ids = self.byte_id[np.frombuffer(piece, np.uint8)].tolist()
        n, merges = len(ids), self.merges.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # An entry holds rank and place of the left token in one number; it is out
        # of date if the pair at that place has another rank by now.
        rank = [merges(a << 32 | b, -1) for a, b in zip(ids, ids[1:])] + [-1]
        heap = [r * n + i for i, r in enumerate(rank) if r >= 0]
        heapq.heapify(heap)
        while heap:
            best, i = divmod(heapq.heappop(heap), n)
            if rank[i] != best:
                continue
            ids[i], gone = best, after[i]
            rank[gone] = -1
            after[i] = right = after[gone]
            if right < n:
                before[right] = i
                rank[i] = r = merges(best << 32 | ids[right], -1)
                if r >= 0:
                    heapq.heappush(heap, r * n + i)
            else:
                rank[i] = -1
            if (left := before[i]) >= 0:
                rank[left] = r = merges(ids[left] << 32 | best, -1)
                if r >= 0:
                    heapq.heappush(heap, r * n + left)
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return np.array(out, np.int32)

    def encode_pieces(self, pieces: Iterable[str]) -> dict[str, bytes]:
        """Ids, as little-endian unsigned 32-bit integers, of each distinct piece."""
        out: dict[str, bytes] = {}
        buckets: dict[int, list[str]] = {}
        whole = self.ranks.get
        for piece in set(pieces):
            raw = piece.encode()
            if (rank := whole(raw)) is not None:
                out[piece] = rank.to_bytes(4, "little")
            elif len(raw) > LONG:
                out[piece] = self.merge_long(raw).astype("<u4").tobytes()
            else:
                buckets.setdefault((len(raw) + 1).bit_length(), []).append(piece)
        for size, members in buckets.items():
            rows = max(1, CELLS >> size)
            for i in range(0, len(members), rows):
                part = members[i : i + rows]
                out.update(zip(part, self.merge_rows([p.encode() for p in part]), strict=True))
        return out

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, as little-endian unsigned 32-bit integers."""
        cut = [stretches(t) for t in texts]
        if len(self.cache) > CACHE or self.cached > CACHE_SIZE:
            self.cache.clear()
            self.cached = 0
        cache = self.cache
        new = list(set().union(*cut).difference(cache))
        pieces = list(map(self.pattern.findall, new))
        ids = self.encode_pieces(chain.from_iterable(pieces))
        found = [ids[p[0]] if len(p) == 1 else b"".join([ids[x] for x in p]) for p in pieces]
        cache.update(zip(new, found, strict=True))
        self.cached += sum(map(len, new)) + sum(map(len, found))
        return [b"".join(map(cache.__getitem__, c)) for c in cut]

    def decode(self, ids: bytes) -> bytes:
        token = self.token
        return b"".join([token[i] for i in np.frombuffer(ids, "<u4").tolist()])


@lru_cache(maxsize=4)
def load(path: str, pattern: str) -> ByteBPE:
    """A worker's encoder for a rank file: lines of base64 bytes and a rank."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return ByteBPE(ranks, pattern)


def text_groups(column: pa.Array, limit: int = 1 << 20) -> Iterator[list[str]]:
    """The texts of an Arrow column, nulls empty, in groups of about ``limit`` characters."""
    group, size = [], 0
    for value in column:
        group.append(value.as_py() or "")
        size += len(group[-1])
        if size >= limit:
            yield group
            group, size = [], 0
    if group:
        yield group


ENCODED = "doc_id long, ids binary"


def encode(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids)``: ids of every whole text as little-endian unsigned 32-bit integers.

    ``rank_file`` is opened on the executors, where the tokenizer is installed.
    """

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(rank_file, pattern)
        for batch in batches:
            at = 0
            for texts in text_groups(batch.column("text")):
                ids = pa.array(bpe.encode_batch(texts), pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(texts)), ids], ["doc_id", "ids"])
                at += len(texts)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, ENCODED)


def decode(encoded: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """``(doc_id, decoded)``: the bytes of ``encoded(doc_id, ids)``."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(rank_file, pattern)
        for batch in batches:
            out = pa.array([bpe.decode(ids.as_py() or b"") for ids in batch.column("ids")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), out], ["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


ROUNDTRIP = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def roundtrip(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of the ids of every whole text and of the bytes decoded from them.

    One pass: ids and decoded bytes stay in the task and only digests leave it.
    """

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(rank_file, pattern)
        for batch in batches:
            at = 0
            for texts in text_groups(batch.column("text")):
                encoded = bpe.encode_batch(texts)
                out = [
                    batch.column("doc_id").slice(at, len(texts)),
                    pa.array([len(ids) // 4 for ids in encoded], pa.int64()),
                    pa.array([hashlib.sha256(ids).hexdigest() for ids in encoded]),
                    pa.array([hashlib.sha256(bpe.decode(ids)).hexdigest() for ids in encoded]),
                ]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                at += len(texts)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, ROUNDTRIP)
