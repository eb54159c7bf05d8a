"""Benchmark passages found against every window."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tidewire.llm import decontaminate

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def grams(words):
    return [tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))] if words else []


def brute(docs, items, threshold=0.8):
    """The best similarity of all windows, slid over each document word by word."""
    out, own = {}, {}
    for j, passage in items:
        words = WORD.findall((passage or "").lower())
        if words:
            own[j] = len(words), Counter(grams(words))
    for i, text in docs:
        words = WORD.findall((text or "").lower())
        for j, (n, a) in own.items() if words else ():
            n, g = min(n, len(words)), min(5, n)
            if g < 5 or n < 5:  # a window of under five words is one gram
                starts = [tuple(words[at : at + n]) for at in range(len(words) - n + 1)]
                best = float(any(w in a for w in starts))
            else:
                found = grams(words)
                size, best, common, seen = n - 4, 0.0, 0, Counter()
                for at, new in enumerate(found):
                    common += seen[new] < a[new]
                    seen[new] += 1
                    if at >= size:
                        old = found[at - size]
                        seen[old] -= 1
                        common -= seen[old] < a[old]
                    if at >= size - 1:
                        best = max(best, common / (sum(a.values()) + size - common))
            if best >= threshold:
                out[i, j] = best
    return out


@pytest.fixture(scope="module")
def planted():
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdef") for _ in range(r.randint(2, 5)))
    items = [(j, " ".join(word() for _ in range(n))) for j, n in enumerate([1, 3, 5, 15, 15, 30, 59])] + [(7, None), (8, ""), (9, "ab " * 20)]
    docs = []
    for i in range(120):
        text = [word() for _ in range(r.choice([0, 2, 14, 80]))]
        for _ in range(r.randint(0, 2)):
            passage = (r.choice(items)[1] or "").split()
            if passage and r.random() < 0.5:
                passage[r.choice([0, -1])] = word()
            at = r.randint(0, len(text))
            text[at:at] = passage
        docs.append((i, " ".join(text)))
    return docs, items


def test_matches_equal_brute_force(spark, planted, monkeypatch):
    docs, items = planted
    frames = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    for size in (decontaminate.BLOCK_BYTES, 300):  # in one block of items and in several
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
        found = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.find_leaks(*frames).collect()}
        assert found == pytest.approx(want) and len(want) > 40
        clean = {r.doc_id for r in decontaminate.drop_leaks(*frames).collect()}
        assert clean == {i for i, _ in docs} - {i for i, _ in want}


@pytest.mark.parametrize("near", [None, 5])
def test_index_finds_all_within_radius(monkeypatch, near):
    rng = np.random.default_rng(2)
    prints = rng.integers(0, 256, (40, 16), dtype=np.uint8)
    windows = np.unpackbits(prints[rng.integers(0, 40, 300)], axis=1)
    for row in windows:
        row[rng.choice(128, rng.integers(0, 60), replace=False)] ^= 1
    windows = np.packbits(windows, axis=1)
    distance = np.unpackbits(windows[:, None] ^ prints[None], axis=2).sum(axis=2)
    monkeypatch.setattr(decontaminate, "PAIRS", 9000)
    if near:  # more values than the probes would have: values are probed, not compared
        prints = np.concatenate([prints, rng.integers(0, 256, (3000, 16), dtype=np.uint8)])
        distance = np.unpackbits(windows[:, None] ^ prints[None], axis=2).sum(axis=2)
    found = [p for w, i in decontaminate.HammingIndex(prints).within(windows) for p in zip(w.tolist(), i.tolist(), strict=True)]
    want = set(zip(*map(list, np.nonzero(distance <= decontaminate.RADIUS)), strict=True))
    assert set(found) == want and len(found) == len(want)


def test_index_leaves_out_most_pairs():
    rng = np.random.default_rng(4)
    prints, windows = rng.integers(0, 256, (400, 16), dtype=np.uint8), rng.integers(0, 256, (200, 16), dtype=np.uint8)
    assert len(decontaminate.HammingIndex(prints).candidates(windows)[0]) < 0.3 * 400 * 200


def test_radius_loses_hardly_any_similar_window():
    """Windows of a similarity from 0.8 to 0.87, where fingerprints differ most."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    inside = n = 0
    while n < 1500:
        item = [word() for _ in range(r.randint(15, 60))]
        window = list(item)
        for _ in range(r.randint(1, 4)):
            window[r.choice([0, -1, r.randrange(len(window))])] = word()
        window = ([word() for _ in range(r.choice([0, 0, 1, 2, 3]))] + window)[: len(item)]
        a, b = (decontaminate.grams(w, 5) for w in decontaminate.words_of([" ".join(t).encode() for t in (item, window)]))
        if 0.8 <= decontaminate.weighted_similarity(a, b) < 0.87:
            n += 1
            inside += sum(len(w) for w, _ in decontaminate.HammingIndex(decontaminate.fingerprint(a)).within(decontaminate.fingerprint(b)))
    assert inside / n >= 0.99


def test_long_documents_full_of_passages(monkeypatch):
    """Stretches give the same matches as a whole text."""
    monkeypatch.setattr(decontaminate, "STRETCH", 64)
    r = random.Random(10)
    items = [(j, " ".join(f"w{r.randrange(50)}" for _ in range(n))) for j, n in enumerate([6, 12, 12, 30, 80])]
    text = " ".join(" ".join(r.choice(items)[1].split()[r.choice([0, 0, 1]) :]) for _ in range(60))
    index = decontaminate.Benchmark(items, 0.8)
    words = decontaminate.words_of([text.encode()])[0]
    assert {(1, m[0]): m[1] for m in index.matches(words)} == pytest.approx(brute([(1, text)], items))


def test_odd_documents(spark, odd, empty):
    items = spark.createDataFrame([(0, "the same words in the same order again"), (1, "one two"), (None, None)], "item_id long, text string")
    found = sorted((r.doc_id, r.item_id) for r in decontaminate.find_leaks(odd, items).collect())
    assert found == [(1, 0), (2, 0), (6, 1)]
    kept = decontaminate.drop_leaks(odd, items)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 4
    assert decontaminate.find_leaks(empty, items).count() == 0
    assert decontaminate.find_leaks(odd, items.limit(0)).count() == 0
    assert decontaminate.drop_leaks(odd, items.limit(0)).count() == odd.count()


def test_a_lost_block_raises(spark, tmp_path):
    items = spark.createDataFrame([(1, "one two three four five six"), (2, None)], "item_id long, text string")
    [(path, n)] = decontaminate.item_blocks(items)
    assert n == 2 and decontaminate.load_block(path, n, 0.8)
    with pytest.raises(FileNotFoundError, match="of 2"):
        decontaminate.load_block(f"file://{tmp_path}/gone", n, 0.8)
    assert [n for _, n in decontaminate.item_blocks(items.limit(0))] == [0]
