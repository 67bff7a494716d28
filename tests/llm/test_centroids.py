import hashlib
import random

import numpy as np
import pytest

from geoquarry.llm import centroids


def test_tree_finds_the_first_of_the_nearest():
    rng = np.random.default_rng(4)
    for k, dim, top in ((1, 3, 5), (2, 2, 2), (40, 64, 300), (57, 2, 4), (300, 3, 6), (64, 5, 1)):
        points, rows = rng.integers(-top, top, (k, dim)), rng.integers(-top, top, (500, dim))
        for leaf in (1, 4, 100):
            number, distance = centroids.VantageTree(points, leaf).nearest(rows)
            every = ((rows[:, None, :] - points[None]) ** 2).sum(2)
            assert (number == every.argmin(1)).all() and (distance == every.min(1)).all()


def test_tree_passes_over_most_of_separated_centroids(monkeypatch):
    rng = np.random.default_rng(5)
    middles = rng.integers(-10_000, 10_000, (16, 8))
    points = (middles[:, None] + rng.integers(-20, 20, (16, 16, 8))).reshape(-1, 8)
    seen = []
    monkeypatch.setattr(centroids, "squared", lambda v, p, f=centroids.squared: (seen.append(len(v)), f(v, p))[1])
    tree = centroids.VantageTree(points)
    seen.clear()
    rows = points[rng.integers(0, 256, 1000)] + rng.integers(-5, 5, (1000, 8))
    tree.nearest(rows)
    assert sum(seen) < 0.3 * 1000 * 256


def test_large_components_keep_exact_distances():
    points = np.array([[-centroids.LIMIT + 1] * 64, [centroids.LIMIT - 1] * 64])
    number, distance = centroids.VantageTree(points, 1).nearest(np.array([[centroids.LIMIT - 2] * 64]))
    assert number[0] == 1 and distance[0] == 64


def brute(rows, k, rounds, dim):
    kept = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    middle = [v for _, v in first[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(middle))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        middle = [[sum(x) // len(groups[n]) for x in zip(*groups[n])] if n in groups else c for n, c in enumerate(middle)]
    return sorted(((i, nearest(v)[1], nearest(v)[0]) for i, v in kept), key=str), middle


@pytest.mark.parametrize("k,rounds", [(7, 5), (1, 1), (500, 2)])
def test_clusters_equal_a_plain_walk(spark, k, rounds):
    rng = random.Random(9)
    rows = [(i, [rng.gauss(rng.choice((-2, 0, 3)), 0.3) for _ in range(4)]) for i in range(150)]
    rows += [(i, [1.0, -0.5, 0.25, 0.0]) for i in range(150, 220)]  # a group of equal vectors
    rows += [(3, rows[3][1]), (None, [0.1, 0.2, 0.3, 0.4]), (300, None), (301, []), (302, [1.0] * 3), (303, [1.0] * 5), (304, [1.0, None, 1.0, 1.0])]
    rows += [(305, [float("nan"), 1.0, 1.0, 1.0]), (306, [float("-inf"), 1.0, 1.0, 1.0]), (307, [-0.001] * 4)]
    frame = spark.createDataFrame([(i, v, "x", 1.0) for i, v in rows], "vec_id long, embedding array<float>, cluster string, distance double").repartition(4)
    found, middle = centroids.cluster(frame, k, rounds, dim=4)
    want, points = brute(rows, k, rounds, 4)
    assert middle.tolist() == points
    assert sorted((tuple(r) for r in found.collect()), key=str) == want


def test_no_vectors_and_too_large_ones(spark):
    empty = spark.createDataFrame([(1, None)], "vec_id long, embedding array<double>")
    found, middle = centroids.cluster(empty)
    assert found.count() == 0 and len(middle) == 0
    with pytest.raises(Exception, match="beyond a long"):
        centroids.cluster(spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<double>"))[0].count()
