"""Alignment of two tokenizers' tokens on the same bytes.

Every text is encoded by a byte-level BPE tokenizer (A, with a space before the
text) and by a piece model (B, which adds that space itself). Byte offsets where tokens
of both end cut them into groups. A token of A and one of B are linked where their
bytes overlap; each stretch between two neighbouring ends of either is one link. How many
documents hold a pair of ids linked is counted over all documents.

Most groups are one token of A and the one of B with the same bytes. Which id of B that is
is known beforehand for each id of A (the identity map), so these links are counted in a
vector as long as A's vocabulary, of one entry for each id. Only pairs out of other groups
are put into a table and shuffled; such a pair that is in the identity map too goes into
the vector, so that a document counts once.

Texts are encoded once, in blocks. A block's rows keep, for each document, its identity
ids and numbers into the list of the block's other pairs. Those lists are counted together by
pair, so that a pair of nearly all documents is one row a block, and their counts come
back to the block. The vector, of a fixed size, goes to all tasks.

Defined cases: a text that is null or empty, or whose tokens don't give its bytes back
(such as one with the piece model's own sign for a space), has no tokens, zeros and an
empty digest. Every input row gives one row, also rows of equal or null ids; equal texts
count once each. Special tokens' strings inside texts are plain text. An empty table gives
no rows. Only the id and text columns are read. A very long text is a block of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, scratch, trimmed, written, written_at
from .token_shards import Encoder

#: Bytes of text in a block, and rows of an Arrow batch.
BLOCK_BYTES, BATCH_ROWS = 2 << 20, 500
#: An encoder's kept stretches come from so many characters of text at most.
CACHED_TEXT = 48 << 20
SPACE = "▁"


def byte_of_sign() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for: printable
    Latin-1 for itself, the others in order from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class PlainEncoder(Encoder):
    """The cached encoder, with special tokens' strings as plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.tokenizer.encode_special_tokens = True
        self.read = 0

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        self.read += sum(map(len, texts))
        if self.read > CACHED_TEXT:
            self._start_anew()
            self.read = 0
        return super().encode(texts)


class Pair:
    """Both tokenizers, their tokens' bytes and the identity map."""

    def __init__(self, path_a: str, path_b: str):
        self.a = PlainEncoder(path_a)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte = byte_of_sign()
        self.size_a, self.size_b = self.a.tokenizer.get_vocab_size(), self.b.get_piece_size()
        self.bytes_a = [bytes(byte[c] for c in self.a.tokenizer.id_to_token(i)) if all(c in byte for c in self.a.tokenizer.id_to_token(i)) else b"" for i in range(self.size_a)]
        piece = self.b.id_to_piece
        self.bytes_b = [bytes([int(piece(i)[3:5], 16)]) if self.b.is_byte(i) else piece(i).replace(SPACE, " ").encode() for i in range(self.size_b)]
        self.length_a, self.length_b = (np.array(list(map(len, t)), np.int64) for t in (self.bytes_a, self.bytes_b))
        same = {self.bytes_b[i]: i for i in sorted(range(self.size_b), key=lambda i: (not self.b.is_byte(i), -i))}  # pieces before bytes, first ids before others
        self.identity = np.array([same.get(t, -1) for t in self.bytes_a], np.int64)
        # Decimal digits of each number and one sign after them: a table for each sign.
        digits = [f"{i}{sign}".encode() for sign in ",|;" for i in range(max(self.size_a, self.size_b))]
        self.wide = max(map(len, digits))
        self.digits = np.frombuffer(b"".join(d.ljust(self.wide) for d in digits), np.uint8).reshape(-1, self.wide)
        self.digit_length = np.array(list(map(len, digits)), np.int64)

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Both id sequences of each text, or None for one without tokens."""
        full = [t for t in texts if t]
        found = iter(zip(full, self.a.encode([" " + t for t in full]), self.b.encode(full, num_threads=1), strict=True))
        out = []
        for t in texts:
            if not t:
                out.append(None)
                continue
            _, a, b = next(found)
            whole = b" " + t.encode()
            fits = b"".join(map(self.bytes_a.__getitem__, a.tolist())) == whole == b"".join(map(self.bytes_b.__getitem__, b))
            out.append((a.astype(np.int64), np.array(b, np.int64)) if fits else None)
        return out


@lru_cache(maxsize=1)
def pair(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


def _cut(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A column of lists, of a flat array and where each list ends."""
    return pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(values.astype(np.int32)))


def align_block(both: Pair, texts: list[str]) -> tuple[dict, np.ndarray, dict]:
    """Columns for the documents of a block, the identity ids of each document
    one after the other, and the block's other pairs ``a, b, docs``."""
    found = both.encode(texts)
    held = [i for i, f in enumerate(found) if f is not None]
    a, b = (np.concatenate([found[i][s] for i in held]) if held else np.zeros(0, np.int64) for s in (0, 1))
    n_a, n_b = (np.array([len(f[s]) if f else 0 for f in found], np.int64) for s in (0, 1))
    end_a, end_b = np.cumsum(both.length_a[a]), np.cumsum(both.length_b[b])
    ends = np.sort(np.concatenate([end_a, end_b]), kind="stable")
    ends = ends[np.diff(ends, prepend=0) > 0]
    of_a, of_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
    common = (end_a[of_a] == ends) & (end_b[of_b] == ends)
    # Where each document ends among the links; texts without tokens end where the one before does.
    links = np.searchsorted(ends, np.r_[0, end_a][np.cumsum(n_a)], side="right")
    groups = np.r_[0, np.cumsum(common)][links]
    doc = np.repeat(np.arange(len(texts)), np.diff(links, prepend=0))

    left, right = a[of_a], b[of_b]
    known = both.identity[left] == right
    ids, id_n = np.unique(doc[known] * both.size_a + left[known], return_counts=True)
    others, other_n = np.unique((doc[~known] * both.size_a + left[~known]) * both.size_b + right[~known], return_counts=True)
    every = both.size_a * both.size_b
    pairs, at, docs = np.unique(others % every, return_inverse=True, return_counts=True)
    id_doc, other_doc, last = ids // both.size_a, others // every, np.arange(len(texts))
    id_ends, other_ends = np.searchsorted(id_doc, last, side="right"), np.searchsorted(other_doc, last, side="right")

    # The groups as text: tokens of both in one row, group by group, A's first, each with the sign after it.
    cuts = ends[common]
    group_a, group_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
    place_a = np.arange(len(a)) + np.r_[0, np.searchsorted(end_b, cuts, side="right")][group_a]
    place_b = np.arange(len(b)) + np.searchsorted(end_a, cuts, side="right")[group_b]
    row = np.empty(len(a) + len(b), np.int64)
    numbers = len(both.digits) // 3
    row[place_a] = a + numbers * (cuts[group_a] == end_a)
    row[place_b] = b + 2 * numbers * (cuts[group_b] == end_b)
    size = both.digit_length[row]
    text = both.digits[row][np.arange(both.wide) < size[:, None]]
    stop = np.r_[0, np.cumsum(size)][np.cumsum(n_a + n_b)]
    begin = np.r_[0, stop[:-1]]
    digest = [hashlib.sha256(text[i : j - 1]).hexdigest() if j > i else "" for i, j in zip(begin.tolist(), stop.tolist(), strict=True)]

    per_doc = {
        "n_a": pa.array(n_a),
        "n_b": pa.array(n_b),
        "n_groups": pa.array(np.diff(groups, prepend=0)),
        "n_links": pa.array(np.diff(links, prepend=0)),
        "groups_sha256": pa.array(digest),
        "ids": _cut(ids % both.size_a, id_ends),
        "id_n": _cut(id_n, id_ends),
        "pairs": _cut(at, other_ends),
        "pair_n": _cut(other_n, other_ends),
    }
    return per_doc, ids % both.size_a, {"a": pairs // both.size_b, "b": pairs % both.size_b, "docs": docs}


COUNTS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
LISTS = "ids array<int>, id_n array<int>, pairs array<int>, pair_n array<int>"


def _encoded(rows: DataFrame, path_a: str, path_b: str) -> str:
    """Where the blocks have been written, in folders by kind: documents (0), the
    other pairs of each block (1) and the identity counts of each task (2)."""
    id_type = rows.schema["doc_id"].dataType.simpleString()
    schema = f"kind int, block long, doc_id {id_type}, {COUNTS}, {LISTS}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        both, block, counts = pair(path_a, path_b), TaskContext.get().partitionId() << 32, None
        ints = lambda v: pa.array([v], pa.list_(pa.int32()))
        names = [c.split()[0] for c in schema.split(", ")]
        kinds = None

        def out(kind: int, n: int, columns: dict) -> pa.RecordBatch:
            all_columns = {"kind": pa.array(np.full(n, kind, np.int32)), "block": pa.array(np.full(n, block))} | columns
            return pa.RecordBatch.from_arrays([all_columns[c] if c in all_columns else pa.nulls(n, kinds[c]) for c in names], names)

        for batch in batches:
            if kinds is None:
                lists = pa.list_(pa.int32())
                kinds = {"doc_id": batch.column("doc_id").type, "groups_sha256": pa.string()} | dict.fromkeys(("n_a", "n_b", "n_groups", "n_links"), pa.int64()) | dict.fromkeys(("ids", "id_n", "pairs", "pair_n"), lists)
            texts = batch.column("text").to_pylist()
            size = np.cumsum([len(t or "") for t in texts])
            cut = np.flatnonzero(np.diff(size // BLOCK_BYTES, prepend=0)).tolist()  # before each row that passes a bound
            for start, end in zip([0, *cut], [*cut, len(texts)], strict=True):
                if start == end:
                    continue
                per_doc, ids, others = align_block(both, texts[start:end])
                counts = np.zeros(both.size_a, np.int64) if counts is None else counts
                counts += np.bincount(ids, minlength=both.size_a)
                yield out(0, end - start, {"doc_id": batch.column("doc_id").slice(start, end - start)} | per_doc)
                if len(others["a"]):
                    yield out(1, 1, {"ids": ints(others["a"]), "pairs": ints(others["b"]), "pair_n": ints(others["docs"])})
                block += 1
        if counts is not None:
            some = np.flatnonzero(counts)
            yield out(2, 1, {"ids": ints(some), "id_n": ints(counts[some])})

    with arrow_rows(rows.sparkSession, BATCH_ROWS):
        return written_at(rows.mapInArrow(trimmed(run), schema), "aligned", by="kind")


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    ``n_best`` counts the links whose pair is in as many documents as any pair
    of its A id, ``count_sum`` adds up the documents of the pair of each link.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    with scratch(spark):
        path = _encoded(rows, path_a, path_b)
        table = spark.read.schema(f"block long, doc_id {id_type}, {COUNTS}, {LISTS}, kind int").parquet(path)
        lists = table.where("kind = 1").select("block", F.posexplode(F.arrays_zip("ids", "pairs", "pair_n")).alias("at", "p"))
        pairs = lists.select("block", "at", F.col("p.ids").alias("a"), F.col("p.pairs").alias("b"), F.col("p.pair_n").cast("long").alias("docs"))
        counts = written(pairs.groupBy("a", "b").agg(F.sum("docs").alias("count")), "pair-counts")
        zipped = table.where("kind = 2").select(F.explode(F.arrays_zip("ids", "id_n")).alias("p"))
        same = zipped.select(F.col("p.ids").alias("a"), F.col("p.id_n").cast("long").alias("count"))
        # One row for each id of A.
        vector = same.groupBy("a").agg(F.sum("count").alias("same")).join(counts.groupBy("a").agg(F.max("count").alias("other")), "a", "full").collect()
        size = max((r.a for r in vector), default=-1) + 1
        held, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for r in vector:
            held[r.a], best[r.a] = r.same or 0, max(r.same or 0, r.other or 0)

        def identity(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists, n = batch.column("ids"), batch.column("id_n").flatten().to_numpy().astype(np.int64)
                ids, ends = lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())
                sums = [np.diff(np.r_[0, np.cumsum(v)][ends], prepend=0) for v in (n * (held[ids] == best[ids]), n * held[ids])]
                kept = [c for c in batch.schema.names if c not in ("ids", "id_n")]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *map(pa.array, sums)], [*kept, "n_best", "count_sum"])

        rest = "pairs array<int>, pair_n array<int>"
        mine = table.where("kind = 0").drop("kind").mapInArrow(trimmed(identity), f"block long, doc_id {id_type}, {COUNTS}, {rest}, n_best long, count_sum long")
        told = pairs.join(counts, ["a", "b"]).select("block", "at", "a", "count")
        result = f"doc_id {id_type}, {COUNTS}, n_best long, count_sum long"
        names = [c.split()[0] for c in result.split(", ")]

        def finish(documents: pa.Table, counted: pa.Table) -> pa.Table:
            documents, order = documents.combine_chunks(), np.argsort(counted.column("at").to_numpy())
            count = counted.column("count").to_numpy()[order]
            of_best = count == best[counted.column("a").to_numpy()[order]]
            lists = documents.column("pairs").combine_chunks()
            at, ends = lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())
            n = documents.column("pair_n").combine_chunks().flatten().to_numpy().astype(np.int64)
            sums = {c: np.diff(np.r_[0, np.cumsum(v)][ends], prepend=0) for c, v in (("n_best", n * of_best[at]), ("count_sum", n * count[at]))}
            return pa.table({c: pa.array(documents.column(c).to_numpy() + sums[c]) if c in sums else documents.column(c) for c in names})

        out = mine.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(lambda d, c: finish(d, c), result)
        return written(out, "alignment", keep=True).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
