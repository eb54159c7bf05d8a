"""Token-ID output: a compressed wavelet matrix per shard.

Documents are written in ascending id order. A shard holds the ids of a run
of documents as a wavelet matrix: its ids are numbered by how often they
occur, and there is one bit-plane for each bit of those numbers, in which
they are stably parted by that bit. Frequent ids have small numbers, so high
planes are mostly zeros, and a shard of natural text needs fewer planes than
its vocabulary would. Each plane is compressed on its own. From one file,
``access`` gives the token at a place, ``count`` how often a token occurs,
``select`` where it occurs for the n-th time and ``tokens`` all of them.
Ranks are counts of set bits before every ``RANK_EVERY`` bits, made when a
plane is read; ``select`` goes back up through the planes by the place of the
n-th set or clear bit of each.

File format: a header of eight little-endian unsigned 64-bit numbers
(``MAGIC``, documents, tokens, planes, distinct ids, and three zeros), the
document ids as signed 64-bit numbers with a byte each that is 1 for a null
id, the end of each document in tokens, the distinct ids (unsigned 32-bit) by
their numbers, and for each plane, highest bit first, the number of zeros, the
bytes of its Zstandard frame and that frame of its bits (first bit highest).

Defined cases: a null text is encoded as the empty text, so its document is
the end id alone. Rows with equal ids are ordered by their text; null ids
come first. An empty table writes no shard. Only the id and text columns
are read, so other columns can't clash.
"""

from __future__ import annotations

import json
import os
import re
import string
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import CharDelimiterSplit

from .common import get, new_folder, put, written

MAGIC = 0x0002_5852_544D_5657
RANK_EVERY = 512
#: Tokens of a plane that are parted together.
PART = 1 << 15
#: Compression of a plane.
LEVEL = 1
#: Tokens held before a shard is written.
SHARD_TOKENS = 4_000_000
#: Characters of text that are encoded together.
GROUP = 4 << 20
#: A worker keeps the ids of so many stretches of text, and so many characters of text and bytes
#: of ids with them, then starts anew.
CACHE, CACHE_SIZE = 1_200_000, 64 << 20


class WaveletMatrix:
    """Bit-planes over a sequence of unsigned integers, numbered by how often they occur."""

    def __init__(self, n: int, ids: np.ndarray, zeros: list[int], bits: list[np.ndarray]):
        self.n, self.ids, self.zeros, self.bits = n, ids, zeros, bits
        self.number = {v: i for i, v in enumerate(ids.tolist())}
        self._ranks: dict[int, np.ndarray] = {}

    @classmethod
    def build(cls, values: np.ndarray) -> WaveletMatrix:
        n = len(values)
        often = np.bincount(values) if n else np.zeros(0, np.int64)
        ids = np.flatnonzero(often)
        ids = ids[np.argsort(-often[ids], kind="stable")]
        planes = max(1, int(len(ids) - 1).bit_length())
        number = np.zeros(len(often), np.uint16 if planes <= 16 else np.uint32)
        number[ids] = np.arange(len(ids))
        now = number[values]
        zeros, bits = [], []
        for level in range(planes - 1, -1, -1):
            one = (now >> level & 1).astype(bool)
            packed = np.packbits(one)
            ones = int(np.count_nonzero(one))
            zeros.append(n - ones)
            bits.append(packed)
            after, low, high = np.empty_like(now), 0, n - ones
            for at in range(0, n, PART):  # parts that stay in the processor's cache
                part, own = now[at : at + PART], one[at : at + PART]
                set_at, clear_at = np.flatnonzero(own), np.flatnonzero(~own)
                part.take(set_at, out=after[high : high + len(set_at)], mode="clip")
                part.take(clear_at, out=after[low : low + len(clear_at)], mode="clip")
                low, high = low + len(clear_at), high + len(set_at)
            now = after
        return cls(n, ids.astype(np.uint32), zeros, bits)

    def tokens(self) -> np.ndarray:
        """The whole sequence, from the lowest plane up."""
        planes = len(self.bits)
        now = np.zeros(self.n, np.uint16 if planes <= 16 else np.uint32)
        for p in range(planes - 1, -1, -1):
            now[self.zeros[p] :] |= now.dtype.type(1 << (planes - 1 - p))
            before, low, high = np.empty_like(now), 0, self.zeros[p]
            for at in range(0, self.n, PART):  # parts that stay in the processor's cache
                part = before[at : at + PART]
                own = np.unpackbits(self.bits[p][at >> 3 : (at + PART) >> 3], count=len(part)).view(bool)
                set_at, clear_at = np.flatnonzero(own), np.flatnonzero(~own)
                part[set_at] = now[high : high + len(set_at)]
                part[clear_at] = now[low : low + len(clear_at)]
                low, high = low + len(clear_at), high + len(set_at)
            now = before
        return self.ids[now] if self.n else np.zeros(0, np.uint32)

    def _bit(self, p: int, i: int) -> int:
        return int(self.bits[p][i >> 3]) >> (7 - (i & 7)) & 1

    def _counts(self, p: int) -> np.ndarray:
        """Set bits of a plane before each block of ``RANK_EVERY`` bits."""
        if p not in self._ranks:
            each = np.bitwise_count(self.bits[p]).astype(np.int64)
            blocks = np.add.reduceat(each, np.arange(0, len(each), RANK_EVERY // 8)) if len(each) else each
            self._ranks[p] = np.r_[0, np.cumsum(blocks)]
        return self._ranks[p]

    def _ones(self, p: int, i: int) -> int:
        """Set bits of a plane before a place."""
        block = i // RANK_EVERY
        first = block * RANK_EVERY // 8
        part = np.unpackbits(self.bits[p][first : (i + 7) >> 3])
        return int(self._counts(p)[block]) + int(part[: i - block * RANK_EVERY].sum())

    def access(self, i: int) -> int:
        """The token at a place."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for p in range(len(self.bits)):
            bit, ones = self._bit(p, i), self._ones(p, i)
            value = value << 1 | bit
            i = self.zeros[p] + ones if bit else i - ones
        return int(self.ids[value])

    def _range(self, token: int, i: int) -> tuple[int, int]:
        """Where the occurrences of a token before a place lie below the last plane."""
        low, high, number = 0, i, self.number.get(token)
        if number is None:
            return 0, 0
        for p in range(len(self.bits)):
            a, b = self._ones(p, low), self._ones(p, high)
            if number >> (len(self.bits) - 1 - p) & 1:
                low, high = self.zeros[p] + a, self.zeros[p] + b
            else:
                low, high = low - a, high - b
        return low, high

    def rank(self, token: int, i: int) -> int:
        """How often a token occurs before a place."""
        low, high = self._range(token, i)
        return high - low

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """The place where a token occurs for the k-th time, from 0."""
        low, high = self._range(token, self.n)
        if not 0 <= k < high - low:
            raise IndexError(k)
        at, number = low + k, self.number[token]
        for p in range(len(self.bits) - 1, -1, -1):
            if number >> (len(self.bits) - 1 - p) & 1:
                at = self._place(p, at - self.zeros[p], 1)
            else:
                at = self._place(p, at, 0)
        return at

    def _place(self, p: int, k: int, bit: int) -> int:
        """Where a plane has its k-th set or clear bit."""
        before = self._counts(p)
        if not bit:
            before = np.arange(len(before)) * RANK_EVERY - before
        block = int(np.searchsorted(before, k, side="right")) - 1
        first = block * RANK_EVERY // 8
        part = np.unpackbits(self.bits[p][first : first + RANK_EVERY // 8])
        return block * RANK_EVERY + int(np.flatnonzero(part == bit)[k - int(before[block])])


def to_bytes(doc_ids: list[int | None], ends: np.ndarray, matrix: WaveletMatrix) -> bytes:
    ids = np.array([i or 0 for i in doc_ids], "<i8")
    nulls = np.array([i is None for i in doc_ids], np.uint8)
    out = [struct.pack("<8Q", MAGIC, len(ids), matrix.n, len(matrix.bits), len(matrix.ids), 0, 0, 0), ids.tobytes(), nulls.tobytes(), ends.astype("<u8").tobytes(), matrix.ids.astype("<u4").tobytes()]
    packer = zstandard.ZstdCompressor(level=LEVEL)
    for zeros, bits in zip(matrix.zeros, matrix.bits, strict=True):
        frame = packer.compress(bits.tobytes())
        out += [struct.pack("<2Q", zeros, len(frame)), frame]
    return b"".join(out)


def from_bytes(raw: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    """Document ids, their ends in tokens, and the matrix."""
    magic, docs, n, planes, distinct = struct.unpack_from("<5Q", raw)
    if magic != MAGIC:
        raise ValueError("not a token shard")
    at = 64

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(raw, kind, count, at)
        at += out.nbytes
        return out

    ids, nulls, ends, tokens = take("<i8", docs), take("u1", docs), take("<u8", docs), take("<u4", distinct)
    zeros, bits, unpacker = [], [], zstandard.ZstdDecompressor()
    for _ in range(planes):
        count, size = take("<u8", 2).tolist()
        zeros.append(count)
        bits.append(np.frombuffer(unpacker.decompress(take("u1", size).data), np.uint8))
    return [None if null else int(i) for i, null in zip(ids, nulls, strict=True)], ends, WaveletMatrix(n, tokens, zeros, bits)


#: Stretches that the library encodes in one call, and those of them in one string.
CALL, STRING = 20_000, 64
#: White space other than the space and the line feed, plain text having none of it.
ODD_SPACES = ("\t", "\x0b", "\x0c", "\r", "\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0", *map(chr, [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_CUT = re.compile(r"(?<=\S)(?=[ \n])")


def marked(text: str) -> str:
    """``text`` with a NUL before each space or line feed that follows a
    character that is not white space. No piece of the tokenizer crosses such a place."""
    if "  " in text or "\n " in text or "\n\n" in text or " \n" in text or any(c in text for c in (ODD_SPACES[:8] if text.isascii() else ODD_SPACES)):
        return "\0".join(_CUT.split(text))
    return text.replace("\n", "\0\n").replace(" ", "\0 ")


#: Words of Latin letters, and marks that may follow one: two pieces of the byte-level pattern. An apostrophe may begin a piece of its own.
_LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ]+").fullmatch
MARKS = string.punctuation.replace("'", "")


def _signs() -> np.ndarray:
    """The sign of a byte-level vocabulary that stands for each byte, but the line feed for itself."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    signs = np.arange(256, dtype="<u2")
    rest = [b for b in range(256) if b not in own]
    signs[rest] = 256 + np.arange(len(rest))
    signs[10] = 10
    return signs


SIGNS = _signs()


class Encoder:
    """A tokenizer of the library that encodes each distinct stretch of text once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are parallel already
        self.tokenizer = Tokenizer.from_file(path)
        if resize := getattr(self.tokenizer.model, "_resize_cache", None):
            resize(0)  # what the library keeps itself is for words that come again
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cache: dict[str, bytes] = {}
        self._start_anew()
        said = json.loads(self.tokenizer.to_str())
        cut = said["pre_tokenizer"] or {}
        #: Whether pieces are cut as ``_put_together`` does.
        self.pieces = said["normalizer"] is None and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut["add_prefix_space"]
        # Signs must have ids, and none of them be part of an added token.
        self.pieces = self.pieces and all(a.isascii() for a in self.added) and all(self.tokenizer.token_to_id(chr(c)) is not None for c in np.delete(SIGNS, 10))

        # Stretches are put into one string with NULs between them where NUL is a token
        # that is part of no other; then nothing merges across.
        nul = self.tokenizer.encode("\0", add_special_tokens=False).ids
        sign = self.tokenizer.id_to_token(nul[0]) if len(nul) == 1 else ""
        alone = sign and sum(sign in t for t in self.tokenizer.get_vocab()) == 1
        self.nul = nul[0] if alone and self._ids(" a!\0 b") == [*self._ids(" a!"), *nul, *self._ids(" b")] else None

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _of_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of single pieces. They are brought to the vocabulary's signs here, so that the library has nothing to cut."""
        whole, size, out = self.tokenizer.pre_tokenizer, self.kind.itemsize, []
        self.tokenizer.pre_tokenizer = CharDelimiterSplit("\n")
        try:
            for i in range(0, len(pieces), CALL):
                part = pieces[i : i + CALL]
                joined = "\n\n".join("\n".join(part[j : j + STRING]) for j in range(0, len(part), STRING))
                strings = SIGNS[np.frombuffer(joined.encode(), np.uint8)].tobytes().decode("utf-16-le").split("\n\n")
                found = self.tokenizer.encode_batch(strings, add_special_tokens=False)
                raw = b"".join(np.array(e.ids, self.kind).tobytes() for e in found)
                ends = (np.cumsum(np.concatenate([np.bincount(e.word_ids) for e in found])) * size).tolist()
                out += [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        finally:
            self.tokenizer.pre_tokenizer = whole
        return out

    def _put_together(self, new: list[str]) -> list[str]:
        """Learn stretches that are a word and marks from the ids of both, which many of them share; those that are not."""
        own, words, marks, rest = [], [], [], []
        for s in new:
            word = s.rstrip(MARKS)
            letters = word[1:]
            if (letters.isalpha() if letters.isascii() else _LATIN(letters)) and word[0] in " \n":
                own.append(s)
                words.append(word if word[0] == " " else letters)
                marks.append(s[len(word) :])
            else:
                rest.append(s)
        known = {p: self.cache.get(p) for p in dict.fromkeys(words) | dict.fromkeys(marks)}
        missing = [p for p, ids in known.items() if ids is None]
        known.update(zip(missing, self._of_pieces(missing), strict=True))
        feed = self.cache["\n"]
        ids = [known[w] + known[m] if s[0] == " " else feed + known[w] + known[m] for s, w, m in zip(own, words, marks, strict=True)]
        self._keep(own, ids)
        return rest

    def _learn(self, new: list[str]) -> None:
        if self.pieces:
            new = self._put_together(new)
        # A stretch that begins otherwise or ends in white space is cut otherwise next to a NUL.
        joined = [s for s in new if s[0] in " \n" and not s[-1].isspace()] if self.nul is not None else []
        for i in range(0, len(joined), CALL):
            part = joined[i : i + CALL]
            strings = ["\0".join(part[j : j + STRING]) + "\0" for j in range(0, len(part), STRING)]
            found = self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)
            ids = np.concatenate([np.array(e.ids, self.kind) for e in found])
            ends = np.flatnonzero(ids == self.nul)
            raw, size = ids.tobytes(), self.kind.itemsize
            cuts = zip((np.r_[0, ends[:-1] + 1] * size).tolist(), (ends * size).tolist(), strict=True)
            self._keep(part, [raw[a:b] for a, b in cuts])
        rest = [s for s in new if s not in self.cache] if joined else new
        for i in range(0, len(rest), CALL):
            part = rest[i : i + CALL]
            found = self.tokenizer.encode_batch_fast(part, add_special_tokens=False)
            self._keep(part, [array(self.kind.char, e.ids).tobytes() for e in found])

    def _start_anew(self) -> None:
        self.cache.clear()
        self.cached = 0
        self._keep(["", "\n"], [b"", array(self.kind.char, self._ids("\n")).tobytes()])

    def _keep(self, texts: list[str], ids: list[bytes]) -> None:
        self.cache.update(zip(texts, ids, strict=True))
        self.cached += sum(map(len, texts)) + sum(map(len, ids))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts, special tokens not added."""
        if len(self.cache) > CACHE or self.cached > CACHE_SIZE:
            self._start_anew()
        # A text with a NUL or an added token is given to the library whole.
        whole = {i for i, t in enumerate(texts) if "\0" in t or any(a in t for a in self.added)}
        lists = pc.split_pattern(pa.array(["" if i in whole else marked(t) for i, t in enumerate(texts)], pa.large_string()), "\0")
        stretches = lists.flatten().dictionary_encode()
        distinct = stretches.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = list(map(self.cache.get, distinct))
        if None in known:
            new = [i for i, ids in enumerate(known) if ids is None]
            self._learn([distinct[i] for i in new])
            for i in new:
                known[i] = self.cache[distinct[i]]
        flat = np.frombuffer(b"".join(known), self.kind)
        size = np.fromiter(map(len, known), np.int64, len(known)) // self.kind.itemsize
        start, which = np.cumsum(size) - size, stretches.indices.to_numpy()
        sizes = size[which]
        ends = np.r_[0, np.cumsum(sizes)]
        ids = flat[np.arange(ends[-1]) + np.repeat(start[which] - ends[:-1], sizes)]
        bounds = ends[lists.offsets.to_numpy()].tolist()
        out = [ids[a:b] for a, b in zip(bounds, bounds[1:])]
        for i in whole:
            out[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, self.kind)
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """A worker's encoder for a tokenizer file."""
    return Encoder(path)


SHARDS = "path string, task int, number int, docs long, tokens long"


def write_shards(docs: DataFrame, tokenizer_file: str, folder: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all documents as shards; a written table of them in order, with the
    tokens of all shards before each: ``(path, docs, tokens, start)``."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Ranges of ids only: the driver samples the keys, so texts are none.
    by_id = F.col("doc_id").asc_nulls_first()
    ordered = rows.repartitionByRange(n, by_id).sortWithinPartitions(by_id, "text")
    run_id = uuid.uuid4().hex

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number = TaskContext.get().partitionId(), 0
        ids: list = []
        parts: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, ids, parts, held
            path = f"{folder}/{run_id}/{task:06d}-{number:04d}.wvm"
            ends = np.cumsum([len(p) for p in parts])
            put(path, to_bytes(ids, ends, WaveletMatrix.build(np.concatenate(parts))))
            out = pa.RecordBatch.from_pydict({"path": [path], "task": pa.array([task], pa.int32()), "number": pa.array([number], pa.int32()), "docs": [len(ids)], "tokens": [int(ends[-1])]})
            number, ids, parts, held = number + 1, [], [], 0
            return out

        def add(group_ids: list, texts: list[str]) -> Iterator[pa.RecordBatch]:
            nonlocal held
            for doc_id, found in zip(group_ids, encoder(tokenizer_file).encode(texts), strict=True):
                ids.append(doc_id)
                parts.append(np.append(found, found.dtype.type(end_id)))
                held += len(parts[-1])
                if held >= SHARD_TOKENS:
                    yield flush()

        group_ids, texts, size = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                group_ids.append(doc_id.as_py())
                texts.append(text.as_py())
                size += len(texts[-1])
                if size >= GROUP:
                    yield from add(group_ids, texts)
                    group_ids, texts, size = [], [], 0
        yield from add(group_ids, texts)
        if ids:
            yield flush()

    shards = written(ordered.mapInArrow(write, SHARDS), "token-shards")
    # Starts: first over tasks, a row each, then within a task.
    tasks = shards.groupBy("task").agg(F.sum("tokens").alias("n"))
    before = dict(_running((r.task, r.n) for r in tasks.orderBy("task").toLocalIterator()))
    starts = docs.sparkSession.createDataFrame(list(before.items()) or [], "task int, task_start long")
    inside = Window.partitionBy("task").orderBy("number")
    placed = shards.join(starts, "task").withColumn("start", F.col("task_start") + F.sum("tokens").over(inside) - F.col("tokens"))
    return placed.select("path", "docs", "tokens", "start")


def _running(pairs: Iterator[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    total = 0
    for key, n in pairs:
        yield key, total
        total += n


READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_shards(shards: DataFrame) -> DataFrame:
    """Per document, from the files: ``(doc_id, start, n_tokens, ids_crc32)``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                ids, ends, matrix = from_bytes(get(path))
                tokens = matrix.tokens().astype("<u4")
                ends = ends.astype(np.int64)
                begins = np.r_[np.int64(0), ends[:-1]]
                crc = [zlib.crc32(tokens[a:b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(begins + start), pa.array(ends - begins), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    n = int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return shards.select("path", "start").repartition(n, "path").mapInArrow(read, READ)


def shard_roundtrip(docs: DataFrame, tokenizer_file: str, folder: str | None = None, **kw) -> DataFrame:
    """Write the shards, then what the files hold of each document."""
    return read_shards(write_shards(docs, tokenizer_file, folder or new_folder(docs.sparkSession, "tokens"), **kw))
