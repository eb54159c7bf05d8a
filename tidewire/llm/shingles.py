"""Words and word shingles of whole texts, as 64-bit hashes in numpy.

A word is a run of characters other than space and the controls 0x09 to
0x0D, with A to Z lower-cased. Texts are hashed as UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .syncmers import mix

WORDS = 5
#: Texts are hashed in stretches of about so many bytes, cut between words.
STRETCH = 1 << 19
SPACES = (9, 10, 11, 12, 13, 32)

_rng = np.random.default_rng(20240607)
_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_VALUE[ord("A") : ord("Z") + 1] = _VALUE[ord("a") : ord("z") + 1]
_VALUE[list(SPACES)] = 0
_IS_WORD = np.ones(256, bool)
_IS_WORD[list(SPACES)] = False
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PLACE = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``n`` of each."""
    if len(_powers[0]) < n:
        for k, b in enumerate((_BASE, _INVERSE)):
            p = np.full(2 * n, b, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A hash and the start of each word of a buffer."""
    buffer = np.frombuffer(raw, np.uint8)
    inside = np.zeros(len(buffer) + 2, bool)
    inside[1:-1] = _IS_WORD[buffer]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    up, down = _power(len(buffer) + 1)
    sums = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum(_VALUE[buffer] * up[: len(buffer)], out=sums[1:])
    # The sum over a word, moved to where the buffer starts, and the word's length.
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts


def _cuts(raw: bytes) -> Iterator[bytes]:
    """Stretches of a long text, each ending between words."""
    at = 0
    while at < len(raw):
        end = min(len(raw), at + STRETCH)
        while end < len(raw) and _IS_WORD[raw[end]]:
            end += 1
        yield raw[at:end]
        at = end


def words_of(texts: list[bytes]) -> list[np.ndarray]:
    """The word hashes of each text, in order."""
    out: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(texts)
    together, size = [], 0

    def flush() -> None:
        nonlocal together, size
        if together:
            lengths = np.array([len(texts[i]) + 1 for i in together])
            hashes, starts = word_hashes(b" ".join([texts[i] for i in together]))
            cuts = np.searchsorted(starts, np.r_[0, np.cumsum(lengths)])
            for i, a, b in zip(together, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                out[i] = hashes[a:b]
        together, size = [], 0

    for i, raw in enumerate(texts):
        if len(raw) > STRETCH:
            out[i] = np.concatenate([word_hashes(part)[0] for part in _cuts(raw)])
            continue
        together.append(i)
        size += len(raw)
        if size >= STRETCH:
            flush()
    flush()
    return out


def shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of the five-word shingles in order; of fewer words, the whole sequence as one."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    if n < WORDS:
        return mix((words * _PLACE[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n))
    total = np.zeros(n - WORDS + 1, np.uint64)
    for i in range(WORDS):
        total += words[i : n - WORDS + 1 + i] * _PLACE[i]
    return mix(total + np.uint64(WORDS))


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The distinct shingles of each text, sorted."""
    return [np.unique(shingles(w)) for w in words_of(texts)]


def text_batches(batches: Iterator[pa.RecordBatch], limit: int = 1 << 20) -> Iterator[tuple[list, list[bytes]]]:
    """Ids and UTF-8 texts (null: empty) of batches ``(doc_id, text)``, about ``limit`` bytes at a time."""
    ids: list = []
    texts: list[bytes] = []
    size = 0
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
            ids.append(doc_id.as_py())
            texts.append((text.as_py() or "").encode())
            size += len(texts[-1])
            if size >= limit:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts
