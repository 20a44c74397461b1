"""Centroid clustering against a plain version in exact integers."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from rallyframe.llm import centroids

NAMES = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def plain(rows, n=16, rounds=3, size=64):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(64 * x) for x in v]))
    starts = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centres = [list(v) for _, v in starts[:n]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centres))

    for _ in range(rounds):
        members = [[] for _ in centres]
        for _, v in kept:
            members[nearest(v)[1]].append(v)
        centres = [[sum(x) // len(own) for x in zip(*own)] if own else c for own, c in zip(members, centres)]
    found = [(i, *nearest(v)) for i, v in kept]
    inertia = Counter()
    for _, d, k in found:
        inertia[k] += d
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return [(i, k, d, inertia[k], sum(inertia.values()), names[k]) for i, d, k in found]


def key(row):
    return tuple((x is not None, x if x is not None else 0) for x in row)


def vectors(seed, n):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(9)]
    return [(k, [x + rng.gauss(0, 0.4) for x in rng.choice(centres)]) for k in range(n)]


@pytest.mark.parametrize("slice_rows", [8192, 7])
def test_clusters(spark, slice_rows, monkeypatch):
    monkeypatch.setattr(centroids, "SLICE_ROWS", slice_rows)
    rows = vectors(1, 300)
    rows += [(900 + k, rows[0][1]) for k in range(150)] + [rows[5]] * 3 + [(None, rows[7][1])]
    bad = [list(rows[0][1]) for _ in range(3)]
    bad[0][3], bad[1][4], bad[2][5] = None, math.nan, math.inf
    rows += [(2000 + k, v) for k, v in enumerate(bad)]
    rows += [(2010, None), (2011, []), (2012, rows[0][1][:63]), (2013, rows[0][1] + [0.0]), (2014, [-1e3] * 64), (2015, [0.0] * 64)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "7 AS cluster", "8 AS v")
    got = centroids.centre_clusters(centroids.integer_vectors(frame.repartition(4)))
    assert got.columns == NAMES
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain(rows), key=key)


def test_equal_vectors_and_empty_clusters(spark):
    """All vectors are one: every centre is the same, the first takes all, the others stay as they are."""
    rows = [(k, [0.5] * 64) for k in range(40)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = centroids.centre_clusters(centroids.integer_vectors(frame))
    assert sorted(map(tuple, got.collect())) == sorted(plain(rows))


def test_few_vectors(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert centroids.centre_clusters(centroids.integer_vectors(frame)).collect() == []
    three = spark.createDataFrame(vectors(3, 3), "vec_id long, embedding array<double>")
    assert sorted(map(tuple, centroids.centre_clusters(centroids.integer_vectors(three)).collect())) == sorted(plain(vectors(3, 3)))
    nameless = spark.createDataFrame([(None, [1.0] * 64)], "vec_id long, embedding array<double>")
    (row,) = centroids.centre_clusters(centroids.integer_vectors(nameless)).collect()
    assert tuple(row) == (None,) * 6
    wide = spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="would not fit"):
        centroids.centre_clusters(centroids.integer_vectors(wide)).collect()


@pytest.mark.parametrize("size", [1, 2, 8, 64])
def test_transform_keeps_distances(size):
    matrix = centroids.hadamard(size)
    assert (matrix @ matrix.T == size * np.eye(size, dtype=np.int64)).all()
    assert ((np.diff(matrix) != 0).sum(1) == np.arange(size)).all()
    assert centroids.steps(size)[-1][1] == size
    with pytest.raises(ValueError):
        centroids.hadamard(3 * size)


def test_search_is_exact_and_drops_far_centres():
    rng = np.random.default_rng(0)
    centres = rng.integers(-40, 40, (200, 64))
    points = centres[rng.integers(0, 200, 500)] + rng.integers(-4, 5, (500, 64))
    points[:50] = centres[3]
    centres[17] = centres[3]  # of equals the smaller number
    turn = centroids.hadamard(64).T
    own, far, work = centroids.nearest(points @ turn, centres @ turn)
    gaps = ((points[:, None] - centres[None]) ** 2).sum(2)
    assert (own == gaps.argmin(1)).all() and (far == 64 * gaps.min(1)).all()
    assert work < 0.3 * points.size * len(centres)
