"""License scans against a plain search and a brute-force count of diagonals."""

import re
from collections import defaultdict

import pytest

from tidewire.llm import license_scan as ls

MIT = next(t for t in ls.TEMPLATES if t.label == "mit" and len(t.words) > ls.SHORT)


def words(text):
    return re.findall(ls.WORD, re.sub("[A-Z]", lambda c: c[0].lower(), text or ""))


def brute(text):
    """Base places by comparing at each place; spans by all pairs of places of notices."""
    w = words(text)
    base = [(i, t.label) for t in ls.TEMPLATES if t.phrase for i in range(len(w) - len(t.words) + 1) if tuple(w[i : i + len(t.words)]) == t.words]
    labels, score = {name for _, name in base}, 1.0 if base else 0.0
    for t in (t for t in ls.TEMPLATES if not t.phrase):
        diagonals = defaultdict(set)
        for i in range(len(w) - ls.VOTE + 1):
            for j in range(len(t.words) - ls.VOTE + 1):
                if tuple(w[i : i + ls.VOTE]) == t.words[j : j + ls.VOTE]:
                    diagonals[i - j] |= set(range(j, j + ls.VOTE))
        parts, reached, last = [], None, None
        for first, d in sorted((d + min(c), d) for d, c in diagonals.items()):
            if reached is None or first > reached + ls.GAP or abs(d - last) > ls.DRIFT:
                parts.append((set(), first, -1))
            covered, start, end = parts[-1]
            parts[-1] = (covered | diagonals[d], start, max(end, d + max(diagonals[d])))
            reached, last = max(reached if reached is not None else -1, d + max(diagonals[d])), d
        for covered, first, end in parts:
            coverage, density = len(covered) / len(t.words), min(1.0, len(covered) / (end - first + 1))
            score = max(score, min(coverage, density))
            if density >= ls.DENSE and coverage >= (1.0 if len(t.words) < ls.SHORT else ls.COVERED):
                labels.add(t.label)
    at = [i for i, _ in base]
    return len(w), len(base), min(at, default=None), max(at, default=None), ",".join(sorted({n for _, n in base})), ",".join(sorted(labels)), score


def found(df):
    return {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, pytest.approx(r.score)) for r in df.collect()}


def changed():
    """The MIT notice whole, with words put in, with words left out, cut in half, and twice."""
    w = list(MIT.words)
    inserted = w[:20] + ["dear", "reader"] + w[20:50] + ["indeed"] + w[50:]
    missing = w[:15] + w[18:45] + w[46:]
    return [" ".join(x) for x in (w, inserted, missing, w[: len(w) // 2], w + ["prose"] * 60 + inserted)]


def test_against_brute_force(spark):
    texts = [
        "plain words",
        "Released under the MIT License. And the CC BY one; cc  by again, CC-BY too",
        "gnu general public gnu general public license gnu general public",
        "Apache\nLicense apache license, apachelicense",
        "mit licenseé mit liKense MIT LICENSE",
        "this worK is licensed under the gnu general public license version 3",
        "Licensed under CC BY-SA 4.0 " + "filler " * 5000 + "licensed under the Apache License, Version 2.0.",
        "cc",
        *changed(),
    ]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = found(ls.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)))
    assert got == {i: brute(t) for i, t in rows}
    n = len(texts) - 5
    assert [got[n + i][5] for i in range(5)] == ["mit", "mit", "mit", "", "mit"]
    assert got[5][5] == "gpl" and got[2][1] == 1


def test_spans_are_apart(spark):
    text = changed()[-1]
    voted = ls.votes(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    spans = sorted((r.first, r.last) for r in ls.spans(voted).where("label = 'mit' and verified").collect())
    n = len(MIT.words)
    assert spans == [(0, n - 1), (n + 60, 2 * n + 60 + 2)]


def test_odd_rows(spark, odd, odd_rows, empty):
    got = sorted(ls.scan(odd).collect(), key=repr)
    want = sorted([(i, *brute(t)) for i, t, *_ in odd_rows], key=repr)
    assert sorted([tuple(r) for r in got], key=repr) == want
    assert ls.scan(empty).collect() == []
    assert ls.scan(empty).columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def test_own_templates(spark):
    own = [ls.template("house", "property of the house of words"), ls.template("short", "house of", phrase=True)]
    got = found(ls.scan(spark.createDataFrame([(1, "This is PROPERTY of the house of words!")], "doc_id long, text string"), own))
    assert got == {1: (8, 1, 5, 5, "short", "house,short", 1.0)}
    with pytest.raises(ValueError, match="too short"):
        ls.template("x", "one")
    with pytest.raises(ValueError, match="words of templates"):
        ls.votes(spark.createDataFrame([(1, "x")], "doc_id long, text string"), [ls.Template("big", ("a",) * (ls.MOST_WORDS + 1), False)])


def test_no_python_and_no_shuffle_of_words(spark, odd):
    plan = ls.scan(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
