"""Byte-level BPE against the public library."""

import base64
import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewire.llm import bpe

FILE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(FILE, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(texts):
    return [np.frombuffer(i, "<u4").tolist() for i in bpe.load(FILE, public_tokenizers.PATTERN).encode_batch(texts)]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list(" \n\t\r\0aBé日1!'s\x1c\u00a0😀ﬁ")), max_size=60))
def test_any_text(library, text):
    assert encode([text]) == [library.encode_ordinary(text)]


def test_kept_stretches_are_bounded_by_size(library, monkeypatch):
    """Texts of one long stretch each don't pile up, and ids stay the same when a worker starts anew."""
    monkeypatch.setattr(bpe, "CACHE_SIZE", 50_000)
    own = bpe.load(FILE, public_tokenizers.PATTERN)
    for i in range(40):
        text = f"{i}x" * 2000
        assert np.frombuffer(own.encode_batch([text])[0], "<u4").tolist() == library.encode_ordinary(text)
        assert sum(len(k) + len(v) for k, v in own.cache.items()) == own.cached < 50_000 + 30_000


def test_long_pieces(library):
    r = random.Random(3)
    texts = ["a" * 5000, "ab" * 3000, "日本" * 2000, " " * 4000 + "x", "!" * 3333, "\n" * 3000, "".join(r.choice("abcdefghij") for _ in range(6000)), "x" * 513]
    assert encode(texts) == [library.encode_ordinary(t) for t in texts]


def test_runs_of_many_bytes_in_near_linear_time(library):
    """A run of 200 KB takes about ten times as long as one of 20 KB."""
    r = random.Random(6)
    own, took = bpe.load(FILE, public_tokenizers.PATTERN), []
    for n in (20_000, 200_000):
        text = "".join(r.choice("abcdefghijklmnop") for _ in range(n))
        start = time.process_time()
        found = own.merge_long(text.encode()).tolist()
        took.append(time.process_time() - start)
        assert found == library.encode_ordinary(text)
    assert took[1] < 30 * took[0] + 0.5 and took[1] < 10


def test_small_vocabulary_with_unsafe_merges():
    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 290, b"abc": 300, b"ab": 500, b"cd": 400, b"abcd": 310}
    own = bpe.ByteBPE(ranks, public_tokenizers.PATTERN)
    other = tiktoken.Encoding("small", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(4)
    texts = ["".join(r.choice("abcd") for _ in range(n)) for n in (1, 2, 3, 17, 300, 700, 2000)]
    assert [np.frombuffer(i, "<u4").tolist() for i in own.encode_batch(texts)] == [other.encode_ordinary(t) for t in texts]


def test_odd_documents(odd, odd_rows, library):
    found = sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.roundtrip(odd, FILE, public_tokenizers.PATTERN).collect())
    want = []
    for row in odd_rows:
        ids = library.encode_ordinary(row[1] or "")
        want.append((row[0] or 0, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((row[1] or "").encode()).hexdigest()))
    assert found == sorted(want)


def test_encode_then_decode(odd, odd_rows):
    coded = bpe.encode(odd, FILE, public_tokenizers.PATTERN)
    found = bpe.decode(coded, FILE, public_tokenizers.PATTERN).collect()
    assert sorted((r.doc_id or 0, bytes(r.decoded)) for r in found) == sorted((r[0] or 0, (r[1] or "").encode()) for r in odd_rows)


def test_empty_table(empty):
    assert bpe.roundtrip(empty, FILE, public_tokenizers.PATTERN).count() == 0
