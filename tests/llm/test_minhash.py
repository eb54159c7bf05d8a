"""Near-duplicate groups against all pairs."""

import random
import re

import numpy as np
import pytest

from tidewire.llm import minhash, shingles

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    words = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows, percent):
    sets = {i: shingle_set(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            common = len(sets[a] & sets[b])
            if sets[a] and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def corpus(seed, n):
    """Families of edited texts whose similarities lie on both sides of the threshold."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    rows = []
    for _ in range(n):
        base = [word() for _ in range(r.choice([1, 3, 5, 12, 60, 200]))]
        for _ in range(r.choice([1, 1, 2, 5, 14])):
            text = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
                text[r.randrange(len(text))] = word()
            rows.append((len(rows), r.choice([" ", "\n", "\t "]).join(w.upper() if r.random() < 0.1 else w for w in text)))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("percent", "block"), [(85, 512), (80, 8)])
def test_groups_equal_brute_force(spark, monkeypatch, percent, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = corpus(percent, 60)
    found = minhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute(rows, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_odd_documents(odd, odd_rows):
    found = minhash.near_groups(odd).collect()
    assert len(found) == len(odd_rows)
    want = brute([(r[0], r[1]) for r in odd_rows if r[0] is not None], 85)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found if r.doc_id is not None} == want
    assert [(r.n_shingles, r.component_id, r.kept) for r in found if r.doc_id is None] == [(1, None, True)]


def test_repeated_ids_with_other_texts(spark):
    """The fewest shingles stand for an id, in any order of the rows; ties go by the set's digest."""
    r = random.Random(12)
    text = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    short, long = text(60), text(90)
    near_short, near_long = [*short[:-1], "x"], [*long[:-1], "y"]
    tie_a, tie_b = text(40), text(40)
    rows = [(1, long), (1, short), (2, near_short), (3, near_long), (4, tie_a), (4, tie_b), (5, [*tie_a[:-1], "z"]), (6, [*tie_b[:-1], "z"]), (6, text(3)[:1] * 2)]
    sets = shingles.shingle_sets([" ".join(t).encode() for t in (tie_a, tie_b)])
    digest = list(zip(*minhash.digests(sets), strict=True))
    chosen = {4: tie_a if digest[0] < digest[1] else tie_b, 6: rows[-1][1], 1: short}
    want = brute([(i, " ".join(chosen.get(i, t))) for i, t in dict(rows).items()], 85)
    assert want[2][1] == 1 and want[3][1] == 3
    for order in (rows, rows[::-1], sorted(rows, key=lambda x: x[1])):
        df = spark.createDataFrame([(i, " ".join(t)) for i, t in order], "doc_id long, text string").repartition(3)
        found = minhash.near_groups(df).collect()
        assert len(found) == len(rows) and {r.doc_id: (r.n_shingles, r.component_id) for r in found} == want


def test_hot_groups_in_parts(spark, monkeypatch):
    """A group of copies and one of near copies, each far larger than a part."""
    monkeypatch.setattr(minhash, "FAN", 8)
    monkeypatch.setattr(minhash, "PARTS", 5)
    r = random.Random(13)
    base = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join(base)) for i in range(100, 160)] + [(i, " ".join([*base[:-1], f"end{i}"])) for i in range(200, 300)] + [(i, " ".join(f"o{r.randrange(999)}" for _ in range(30))) for i in range(40)]
    found = minhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute(rows, 85)


def test_dedup_keeps_columns_and_null_ids(odd):
    kept = minhash.dedup(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 4, 5, 6, 6, 7, 8, 9, 10]


def test_empty(empty):
    assert minhash.near_groups(empty).count() == 0 and minhash.dedup(empty).count() == 0


def test_signatures_estimate_with_less_variance():
    rng = np.random.default_rng(5)
    errors = []
    for _ in range(150):
        a = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
        b = a.copy()
        b[:4] = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
        s = minhash.signatures([a, b])
        errors.append((s[0] == s[1]).mean() - 36 / 44)
    independent = (36 / 44 * 8 / 44 / minhash.PLACES) ** 0.5
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < independent


def test_signature_of_a_set_alone_or_together():
    rng = np.random.default_rng(6)
    sets = [rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (1, 5, 0, 700, 90)]
    together = minhash.signatures(sets)
    for s, row in zip(sets, together, strict=True):
        assert (minhash.signatures([s])[0] == row).all()
    assert (together[2] == 0xFFFFFFFF).all() and (together[0] != 0xFFFFFFFF).all()


def test_shingles_in_stretches(monkeypatch):
    texts = [b"", b"  ", b"A b\x0bc", b"x" * 300, ("wort é " * 200).encode(), b"one two three four five six"]
    whole = shingles.shingle_sets(texts)
    monkeypatch.setattr(shingles, "STRETCH", 64)
    assert all((a == b).all() for a, b in zip(whole, shingles.shingle_sets(texts), strict=True))
    assert [len(s) for s in whole] == [len(shingle_set(t.decode())) for t in texts]
