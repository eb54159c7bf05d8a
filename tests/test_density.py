"""Density clusters against a version in plain numpy that holds all pairs, and defined cases."""

import math

import numpy as np
import pytest

from tidewire.operators import density, topics

#: Coarse levels, each being some jobs.
RATIO = 2.0


def partition(weights: np.ndarray, members: list[int], level: int) -> list[list[int]]:
    """Components of ``members`` by links of at most ``level``."""
    left, out = set(members), []
    while left:
        group, todo = [], [left.pop()]
        while todo:
            x = todo.pop()
            group.append(x)
            near = [y for y in left if weights[x, y] <= level]
            left.difference_update(near)
            todo += near
        out.append(sorted(group))
    return out


def brute(x: np.ndarray, core: int, least: int, neighbours: int | None = None, ratio: float = RATIO) -> set[tuple[int, ...]]:
    """The clusters taken, from the top of the hierarchy down."""
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    apart = np.sqrt(np.maximum(2 * np.round(1 - u @ u.T, 9), 0))
    np.fill_diagonal(apart, np.inf)
    cores = np.sort(apart, axis=1)[:, min(core, len(x) - 1) - 1]
    linked = np.maximum(np.maximum(apart, cores[:, None]), cores[None, :])
    if neighbours:
        order = np.argsort(apart, axis=1, kind="stable")[:, :neighbours]
        near = np.zeros(apart.shape, bool)
        np.put_along_axis(near, order, True, axis=1)
        linked[~(near | near.T)] = np.inf
    with np.errstate(divide="ignore"):
        weights = np.where(np.isinf(linked), 10**6, np.maximum(np.ceil(np.log(np.maximum(linked, density.FLOOR) / density.FLOOR) / math.log(ratio) - 1e-6), 0))

    def below(members: list[int], top: int, born: float) -> tuple[float, set[tuple[int, ...]], float, set]:
        """Stability and clusters taken of the cluster that ``members`` are at level ``top``, and of those below alone."""
        stability, now, level = 0.0, members, top
        while True:
            parts = partition(weights, now, level - 1) if level > 0 else [[m] for m in now]
            big = [p for p in parts if len(p) >= least]
            gone = density.inverse(level, ratio) - born
            if len(big) == 1:
                stability += (len(now) - len(big[0])) * gone
                now, level = big[0], level - 1
                continue
            stability += len(now) * gone
            inner = [below(p, level - 1, density.inverse(level, ratio)) for p in big]
            total, taken = sum(i[0] for i in inner), set().union(*(i[1] for i in inner))
            own = round(stability, 9) >= round(total, 9)
            return (stability, {tuple(members)}, total, taken) if own else (total, taken, total, taken)

    roots = [p for p in partition(weights, list(range(len(x))), 10**5) if len(p) >= least]
    found = [below(p, 60, 0.0) for p in roots]
    return found[0][3] if len(found) == 1 else set().union(*(f[1] for f in found))


def sample(seed: int, groups: int, copies: int = 0) -> np.ndarray:
    r = np.random.default_rng(seed)
    centres = r.normal(size=(groups, 6))
    rows = [c + r.normal(size=6) * r.choice([0.02, 0.15, 0.4]) for c in centres for _ in range(r.integers(2, 9))]
    return np.array([*rows, *r.normal(size=(6, 6)), *rows[: 3 * copies : 3], *rows[: 3 * copies : 3]])


def taken(spark, x: np.ndarray, **how) -> set[tuple[int, ...]]:
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    groups: dict[int, list[int]] = {}
    rows = density.clusters_of(df, ratio=RATIO, **how).collect()
    assert len({r.id for r in rows}) == len(rows)
    for r in rows:
        groups.setdefault(r.topic_id, []).append(r.id)
    assert sorted(groups) == list(range(len(groups)))
    order = [(-len(groups[i]), min(groups[i])) for i in range(len(groups))]
    assert order == sorted(order)
    return {tuple(sorted(g)) for g in groups.values()}


@pytest.mark.parametrize(("seed", "least", "core", "copies"), [(3, 2, 1, 4), (4, 5, 3, 3)])
def test_against_all_pairs(spark, seed, least, core, copies):
    x = sample(seed, 6, copies)
    expected = brute(x, core, least)
    assert expected
    assert taken(spark, x, neighbours=len(x), core=core, least=least) == expected


def test_near_neighbours_only(spark):
    x = sample(7, 9)
    expected = brute(x, 2, 3, neighbours=5)
    assert len(expected) > 1
    assert taken(spark, x, neighbours=5, core=2, least=3) == expected


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.001]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, [-1.0, 0.5]), (9, [-1.0, 0.5]), (10, [-1.0, 0.5])]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    found = {r.id: r.topic_id for r in density.clusters_of(df, neighbours=2).collect()}
    assert set(found) == {1, 2, 3, 8, 9, 10}
    assert found[1] == found[2] == found[3] == 0 and found[8] == found[9] == found[10] == 1
    assert density.clusters_of(df.where("false")).count() == 0
    assert density.clusters_of(df.where("id = 1")).count() == 0
    with pytest.raises(ValueError):
        density.clusters_of(df, neighbours=1, core=2)


def test_topics_by_density(spark):
    stories = spark.createDataFrame([(i, f"{'cats purr' if i < 4 else 'stocks fall'} {i}") for i in range(9)], "id long, title string")
    v = [[1.0, 0.01 * i, 0.0] if i < 4 else [0.0, 0.01 * i, 1.0] for i in range(8)] + [[0.0, -1.0, 0.0]]
    vectors = spark.createDataFrame(list(enumerate(v)), "id long, embedding array<double>")
    rows = {r.id: r for r in topics.discover(stories, vectors, method="density").collect()}
    assert len({rows[i].topic_id for i in range(4)}) == 1 and len({rows[i].topic_id for i in range(4, 8)}) == 1
    assert rows[0].topic_id != rows[4].topic_id
    assert {rows[i].topic_keyword.split("_")[0] for i in range(4)} <= {"cats", "purr"}
