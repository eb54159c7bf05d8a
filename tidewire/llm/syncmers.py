"""Document fingerprints: closed syncmers, matched by hash and position.

A window of ``K`` bytes is an anchor if the smallest of its inner
substrings of ``S`` bytes, by a hash, lies at its start or its end. Whether
a window is chosen depends on its own bytes only, so equal passages give
equal anchors whatever surrounds them, and of ``K - S + 1`` windows in a row
one is an anchor. Texts are framed by ``MARGIN`` bytes that no UTF-8 text
has, so every text but the empty one, however short, has that many windows
and at least one anchor.

A fingerprint holds all anchors of a whole text in the order of their
positions: 32 bits of each hash and the step from the anchor before, which
is at most ``K - S + 1`` bytes, as base64. ``anchors`` returns them as rows.
Likenesses are computed from two fingerprints. The k-th occurrence of a
hash in one is matched with its k-th in the other; a match counts if the
match before or after it has the same offset, that is, if a passage of two
anchors or more agrees in content and in spacing. Moved passages count, as
their anchors move together; lone equal hashes don't, unless one of the
texts has a single anchor. The likeness is twice the matches that count over
the number of anchors of both.

Defined cases: a null text is an empty one, without an anchor and with an
empty fingerprint. The likeness of two empty fingerprints is 1, of an empty
one and any other 0. Rows with equal ids are ordered by their text; a null
id comes first. A single document is its own next. Only the id and text
columns are read, so other columns can't clash.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Window and inner substring, in bytes.
K, S = 24, 8
#: Frames: bytes that no UTF-8 text has. With S = 8 no two inner substrings of one are equal.
MARGIN = 20
_BEFORE = bytes([0xF5, 0xF6, 0xF7, 0xF8, 0xF9] * 2 + [0xFA, 0xFB, 0xFC, 0xFD, 0xFE] * 2)
_AFTER = bytes([0xFE, 0xFC, 0xFA, 0xF8, 0xF6] * 2 + [0xFF, 0xFD, 0xFB, 0xF9, 0xF7] * 2)
#: Texts are hashed in stretches of about so many bytes.
STRETCH = 1 << 18

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash."""
    h = (h ^ (h >> np.uint64(33))) * _M1
    h = (h ^ (h >> np.uint64(33))) * _M2
    return h ^ (h >> np.uint64(33))


def _words(raw: np.ndarray) -> np.ndarray:
    """The S = 8 bytes from each position as an integer."""
    w = raw.astype(np.uint64)
    for step in (1, 2, 4):
        w = w[:-step] | (w[step:] << np.uint64(8 * step))
    return w


def _select(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the closed syncmers in a buffer of at least K bytes, and their hashes."""
    words = _words(raw)
    order = mix(words)
    inner = K - S + 1
    least, width = order, 1
    while width < inner:  # minima over windows of doubled width
        step = min(width, inner - width)
        least, width = np.minimum(least[:-step], least[step:]), width + step
    n = len(least)
    at = np.flatnonzero((order[:n] == least) | (order[inner - 1 : inner - 1 + n] == least))
    h = words[at]
    for shift in range(S, K, S):
        h = mix(h) + words[at + shift]
    return at, mix(h)


def anchors_of(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions and hashes of the anchors of a whole text. Those of windows
    that begin in the frame before it are negative."""
    if not raw:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    buffer, at, hashes = np.frombuffer(_BEFORE + raw + _AFTER, np.uint8), [], []
    for start in range(0, len(buffer) - K + 1, STRETCH):
        found = _select(buffer[start : start + STRETCH + K - 1])
        at.append(found[0] + (start - MARGIN))
        hashes.append(found[1])
    return np.concatenate(at), np.concatenate(hashes)


class Prints:
    """Anchors of a text in the order of their positions, with short hashes."""

    def __init__(self, at: np.ndarray, short: np.ndarray):
        self.at, self.short = at, short
        # A key for each anchor: its hash and how often that came before.
        order = np.argsort(short, kind="stable")
        ordered = short[order]
        first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(short) else np.zeros(0, np.int64)
        times = np.arange(len(short)) - np.repeat(first, np.diff(np.r_[first, len(short)]))
        self.keys = (ordered.astype(np.uint64) << np.uint64(32)) | times.astype(np.uint64)
        self.key_at = at[order]


def prints_of(texts: list[bytes]) -> list[Prints]:
    """The anchors of each text. Texts are hashed together, one buffer a stretch."""
    none = Prints(np.zeros(0, np.int64), np.zeros(0, np.uint32))
    out: list[Prints] = [none] * len(texts)
    together, size = [], 0

    def short(hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(32)).astype(np.uint32)

    def flush() -> None:
        nonlocal together, size
        if together:
            ends = np.cumsum([len(texts[i]) + 2 * MARGIN for i in together])
            at, hashes = _select(np.frombuffer(b"".join([_BEFORE + texts[i] + _AFTER for i in together]), np.uint8))
            owner = np.searchsorted(ends, at, side="right")
            inside = at + K <= ends[owner]  # windows that cross from one text to the next don't count
            at, owner, hashes = at[inside], owner[inside], short(hashes[inside])
            at = at - np.r_[0, ends[:-1]][owner] - MARGIN
            cuts = np.searchsorted(owner, np.arange(len(together) + 1))
            for i, a, b in zip(together, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                out[i] = Prints(at[a:b], hashes[a:b])
        together, size = [], 0

    for i, raw in enumerate(texts):
        if len(raw) >= STRETCH:
            at, hashes = anchors_of(raw)
            out[i] = Prints(at, short(hashes))
        elif raw:
            together.append(i)
            size += len(raw)
            if size >= STRETCH:
                flush()
    flush()
    return out


_ENTRY = np.dtype([("hash", ">u4"), ("step", "u1")])


def to_text(p: Prints) -> str:
    """The fingerprint: five bytes for each anchor, its hash and the step to it."""
    entries = np.empty(len(p.at), _ENTRY)
    entries["hash"], entries["step"] = p.short, np.diff(p.at, prepend=-MARGIN)
    return base64.b64encode(entries.tobytes()).decode()


def from_text(fingerprint: str) -> Prints:
    """The anchors that a fingerprint holds."""
    entries = np.frombuffer(base64.b64decode(fingerprint), _ENTRY)
    return Prints(np.cumsum(entries["step"], dtype=np.int64) - MARGIN, entries["hash"].astype(np.uint32))


def likeness(a: Prints, b: Prints) -> float:
    """The likeness of two fingerprints. A text half of which is kept is at about a half."""
    if not len(a.at) or not len(b.at):
        return float(len(a.at) == len(b.at))
    both = np.concatenate([a.keys, b.keys])
    order = np.argsort(both, kind="stable")
    both = both[order]
    same = np.flatnonzero(both[1:] == both[:-1])
    at = a.key_at[order[same]]
    offset = (b.key_at[order[same + 1] - len(a.at)] - at)[np.argsort(at)]
    if min(len(a.at), len(b.at)) == 1:
        count = len(offset)
    else:
        agrees = offset[1:] == offset[:-1]
        count = int(np.count_nonzero(np.r_[agrees, False] | np.r_[False, agrees]))
    return 2 * count / (len(a.at) + len(b.at))


ANCHORS = "doc_id long, position long, anchor long"


def anchors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, position, anchor)``: every anchor of every text with its byte position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                at, hashes = anchors_of((text.as_py() or "").encode())
                yield pa.RecordBatch.from_arrays([pa.array([doc_id.as_py()] * len(at), pa.int64()), pa.array(at), pa.array(hashes.view(np.int64))], ["doc_id", "position", "anchor"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, ANCHORS)


def with_next(docs: DataFrame, ranges: int) -> tuple[DataFrame, int]:
    """Documents dealt into ranges by id, each followed by its next one.

    Rows ``(part, doc_id, text, borrowed)``: within a part by ascending id;
    the last row of a part is ``borrowed``, the first document of the next
    part that has any (of the first part, after the last). Each text is
    moved once, and once more for the first of each part. The driver holds
    a bound and a first id for each part, no more.
    """
    bounds = docs.stat.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.2 / ranges) if ranges > 1 else []
    bounds = sorted({int(b) for b in bounds})
    part = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= F.col("doc_id"))) if bounds else F.lit(0)
    dealt = docs.withColumn("part", F.when(F.col("doc_id").isNull(), 0).otherwise(part).cast("int"))
    found = sorted(dealt.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("has"), "doc_id")).alias("low")).select("part", "low.has", "low.doc_id").collect())
    if not found:
        return dealt.select("part", "doc_id", "text", F.lit(False).alias("borrowed")), 1
    # The first document of each part is needed by the part before it.
    lows = {r.part: (r.has, r.doc_id) for r in found}
    parts = sorted(lows)
    before = {p: parts[i - 1] for i, p in enumerate(parts)}
    spark = docs.sparkSession
    heads = spark.createDataFrame([(p, lows[p][1], before[p]) for p in parts], "head_part int, head_id long, needed_by int")
    first = (
        dealt.join(F.broadcast(heads), (dealt["part"] == heads["head_part"]) & dealt["doc_id"].eqNullSafe(heads["head_id"]))
        .groupBy("needed_by", "doc_id")
        .agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
        .select(F.col("needed_by").alias("part"), "doc_id", "text", F.lit(True).alias("borrowed"))
    )
    return dealt.select("part", "doc_id", "text", F.lit(False).alias("borrowed")).union(first), parts[-1] + 1


COMPARED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness.

    The edited text has the last ``n_chars // 2`` code points replaced by as
    many of the next document's first, or by all of it.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    dealt, n = with_next(rows, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = dealt.repartitionById(n, F.col("part")).sortWithinPartitions(F.col("part"), F.col("borrowed"), F.col("doc_id").asc_nulls_first(), F.col("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs() -> Iterator[tuple]:
            held = None
            for batch in batches:
                for part, doc_id, text, borrowed in zip(*(batch.column(c) for c in ("part", "doc_id", "text", "borrowed")), strict=True):
                    now = (part.as_py(), doc_id.as_py(), text.as_py())
                    if held is not None and held[0] == now[0]:
                        yield held[1], held[2], now[2]
                    held = None if borrowed.as_py() else now

        def finish(group: list[tuple]) -> pa.RecordBatch:
            edited = [text[: len(text) - len(text) // 2] + after[: len(text) // 2] for _, text, after in group]
            raw = [t.encode() for t in edited]
            all_texts = [text.encode() for _, text, _ in group]
            last = group[-1][2].encode()
            found = prints_of([*all_texts, last, *raw])
            own, after, other = found[: len(group)], found[1 : len(group) + 1], found[len(group) + 1 :]
            out = [
                pa.array([i for i, _, _ in group], pa.int64()),
                pa.array([len(t) for _, t, _ in group], pa.int64()),
                pa.array([hashlib.sha256(r).hexdigest() for r in raw]),
                pa.array([to_text(s) for s in own]),
                pa.array([to_text(s) for s in other]),
                pa.array([likeness(a, b) for a, b in zip(own, other, strict=True)]),
                pa.array([likeness(a, b) for a, b in zip(own, after, strict=True)]),
            ]
            return pa.RecordBatch.from_arrays(out, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        group, size, last = [], 0, None
        for doc_id, text, after in pairs():
            # A group is a run of neighbours, so the next one's anchors are found once.
            if group and (size >= STRETCH or last is not text):
                yield finish(group)
                group, size = [], 0
            group.append((doc_id, text, after))
            size += len(text)
            last = after
        if group:
            yield finish(group)

    return ordered.mapInArrow(run, COMPARED)
