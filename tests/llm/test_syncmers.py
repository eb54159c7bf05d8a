"""Syncmer anchors and fingerprints against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tidewire.llm import syncmers as s


def brute_anchors(raw):
    """(position, window) of every closed syncmer of the framed text."""
    if not raw:
        return []
    raw = s._BEFORE + raw + s._AFTER
    order = [int(s.mix(np.array([int.from_bytes(raw[i : i + s.S], "little")], np.uint64))[0]) for i in range(len(raw) - s.S + 1)]
    inner = s.K - s.S + 1
    return [(i - s.MARGIN, raw[i : i + s.K]) for i in range(len(raw) - s.K + 1) if min(order[i : i + inner]) in (order[i], order[i + inner - 1])]


def brute_likeness(a, b):
    """Matches of the k-th occurrences of windows, counted where a neighbour has the same offset."""
    if not a or not b:
        return float(len(a) == len(b))

    def numbered(found):
        seen, out = Counter(), {}
        for at, window in found:
            out[window, seen[window]] = at
            seen[window] += 1
        return out

    x, y = numbered(a), numbered(b)
    offsets = [off for _, off in sorted((x[k], y[k] - x[k]) for k in x.keys() & y.keys())]
    if min(len(a), len(b)) == 1:
        return 2 * len(offsets) / (len(a) + len(b))
    count = sum((i > 0 and offsets[i - 1] == o) or (i + 1 < len(offsets) and offsets[i + 1] == o) for i, o in enumerate(offsets))
    return 2 * count / (len(a) + len(b))


@pytest.mark.parametrize("stretch", [1 << 18, 100])
def test_anchors(monkeypatch, stretch):
    monkeypatch.setattr(s, "STRETCH", stretch)
    r = random.Random(1)
    texts = [bytes(r.choice(b"ab c") for _ in range(n)) for n in (0, 1, 2, 5, 24, 25, 70, 99, 100, 101, 1500)]
    for raw, together in zip(texts, s.prints_of(texts), strict=True):
        at, hashes = s.anchors_of(raw)
        assert at.tolist() == [i for i, _ in brute_anchors(raw)]
        assert (together.at == at).all() and (together.short == hashes >> np.uint64(32)).all()
        again = s.from_text(s.to_text(together))
        assert (again.at == at).all() and (again.short == together.short).all()


def test_every_text_has_an_anchor_within_the_bound():
    r = random.Random(5)
    for n in [*range(1, 60), 400]:
        for _ in range(20):
            raw = bytes(r.choice(b"abcdefgh ") for _ in range(n))
            at, _ = s.anchors_of(raw)
            assert len(at) and np.diff(np.r_[-s.MARGIN - 1, at]).max() <= s.K - s.S + 1


def test_anchors_are_free_of_context():
    r = random.Random(2)
    passage = bytes(r.choice(b"abcdefgh ") for _ in range(400))
    one, two = (s.anchors_of(before + passage) for before in (b"short ", b"something longer before it "))
    inside = lambda found, n: {(a - n, h) for a, h in zip(found[0].tolist(), found[1].tolist(), strict=True) if a >= n}
    assert inside(one, 6) == inside(two, 27) and len(inside(one, 6)) > 20


def test_likeness_equals_brute_force():
    r = random.Random(3)
    pieces = [bytes(r.choice(b"abcd ") for _ in range(r.choice([1, 6, 40, 90]))) for _ in range(9)]
    texts = [b"", *[b"".join(r.choice(pieces) for _ in range(r.randint(1, 8))) for _ in range(40)]]
    found = s.prints_of(texts)
    anchors = [brute_anchors(t) for t in texts]
    some = 0
    for i, a in enumerate(found):
        for j, b in enumerate(found):
            want = brute_likeness(anchors[i], anchors[j])
            assert s.likeness(a, b) == pytest.approx(want) == s.likeness(s.from_text(s.to_text(a)), s.from_text(s.to_text(b)))
            some += 0 < want < 1
        assert s.likeness(a, a) == 1.0
    assert some > 300


def test_short_texts_are_compared_in_parts():
    a, b, c = s.prints_of([b"small green house", b"small green mouse", b"1234 5678"])
    assert 0 < s.likeness(a, b) < 1 and s.likeness(a, c) == 0.0 and s.to_text(a) != s.to_text(b)


@pytest.mark.parametrize("parts", ["1", "4", "13"])
def test_edits_against_brute_force(spark, odd, odd_rows, parts):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        found = s.compare_with_edits(odd).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    rows = sorted(((r[0], r[1] or "") for r in odd_rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for n, (i, text) in enumerate(rows):
        after = rows[(n + 1) % len(rows)][1]
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        a, b, c = s.prints_of([t.encode() for t in (text, edited, after)])
        want.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), s.to_text(a), s.to_text(b), s.likeness(a, b), s.likeness(a, c)))
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, want))


def test_one_and_none(spark, empty):
    assert s.compare_with_edits(empty).count() == 0
    row = s.compare_with_edits(spark.createDataFrame([(1, "abcdefg" * 9)], "doc_id long, text string")).first()
    assert row.near_next == 1.0 and row.n_chars == 63
    assert s.anchors(empty).count() == 0


def test_query_against_all_anchors(spark, small):
    """Both likenesses of every document, from all of its windows and no fingerprint."""
    rows = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{small}/documents.parquet").collect())
    rows = [(i, t) for i, t in rows if len(t) < 6000]
    found = {r.doc_id: r for r in s.compare_with_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    anchors = [brute_anchors(t.encode()) for _, t in rows]
    for n, (i, text) in enumerate(rows):
        after = rows[(n + 1) % len(rows)][1]
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        assert found[i].near_edited == pytest.approx(brute_likeness(anchors[n], brute_anchors(edited.encode())))
        assert found[i].near_next == pytest.approx(brute_likeness(anchors[n], anchors[(n + 1) % len(rows)]))


def test_all_anchors_of_long_texts_count(spark):
    r = random.Random(6)
    long = "".join(r.choice("abcdefgh ") for _ in range(60_000))
    other = long[:30_000] + "x" * 30 + long[30_030:]
    docs = spark.createDataFrame([(1, long), (2, other)], "doc_id long, text string")
    one, two = sorted(s.compare_with_edits(docs).collect())
    assert one.fingerprint != two.fingerprint and 0.99 < one.near_next == two.near_next < 1
    assert len(s.from_text(one.fingerprint).at) == len(s.anchors_of(long.encode())[0]) > 6000
