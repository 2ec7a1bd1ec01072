"""Annulus search and rounds of clustering against plain versions in Python's integers."""

import hashlib
import math
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessaline.llm import centroids


def far(a, b):
    return sum((int(x) - int(y)) ** 2 for x, y in zip(a, b, strict=True))


def nearest(row, points):
    return min((far(row, p), i) for i, p in enumerate(points))


@given(st.integers(1, 9), st.integers(1, 3), st.integers(0, 10**6), st.sampled_from([2, 40, 10**6, 1 << 26, 1 << 40]))
@settings(max_examples=150, deadline=None)
def test_search(k, size, seed, scale):
    """Equal to all comparisons; small scales make ties and equal centroids, large ones need wide integers."""
    r = np.random.default_rng(seed)
    points, rows = r.integers(-scale, scale + 1, (k, size)), r.integers(-scale, scale + 1, (60, size))
    best, distance, compared = centroids.Centroids(points).nearest(rows)
    for row, b, d, c in zip(rows, best, distance, compared, strict=True):
        assert (int(d), int(b)) == nearest(row, points) and 1 <= c <= k


def test_ties_on_the_edge_of_an_annulus():
    """Both centroids lie on the row's line, at the same distance: the second one's norm is exactly at the bound."""
    points = np.array([[30, 40], [3, 4], [300, 400]])
    best, distance, _ = centroids.Centroids(points[[0, 2]]).nearest(np.array([[165, 220]]))
    assert (best[0], distance[0]) == (0, 135**2 + 180**2)
    best, _, _ = centroids.Centroids(points[[2, 0]]).nearest(np.array([[165, 220]]))
    assert best[0] == 0


def test_far_norms_are_not_compared():
    """Centroids on shells of their own: each row meets few of them."""
    r = np.random.default_rng(1)
    points = np.array([[10_000 * (i + 1), 0, 0] for i in range(50)])
    rows = points[r.integers(0, 50, 500)] + r.integers(-900, 900, (500, 3))
    best, distance, compared = centroids.Centroids(points).nearest(rows)
    assert compared.mean() < 2 and all((int(d), int(b)) == nearest(x, points) for x, b, d in zip(rows, best, distance, strict=True))


def plain(rows, k=8, rounds=10, size=64):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "~", r[1])
    points = [list(q) for _, q in sorted(kept, key=key)[:k]]
    for _ in range(rounds):
        mine = [[] for _ in points]
        for _, q in kept:
            mine[nearest(q, points)[1]].append(q)
        points = [[sum(c) // len(m) for c in zip(*m, strict=True)] if m else p for m, p in zip(mine, points, strict=True)]
    found = [(i, *nearest(q, points)[::-1]) for i, q in kept]
    sums = [sum(d for _, c, d in found if c == j) for j in range(len(points))]
    prints = [hashlib.sha256(",".join(map(str, p)).encode()).hexdigest() for p in points]
    fit = lambda x: x if x < 1 << 63 else None
    return sorted(map(str, [(i, c, fit(d), fit(sums[c]), fit(sum(sums)), prints[c]) for i, c, d in found]))


def test_query(spark):
    """Rows of every kind: nulls, other lengths, repeated ids and vectors, no id, shells of norms, a column named like ours."""
    r = random.Random(5)
    rows = [(i, [r.gauss(0, 1 + i % 4) for _ in range(64)]) for i in range(300)]
    rows += [(i, rows[3][1]) for i in (3, 3, 900)] + [(None, [0.5] * 64), (None, None), (7, None), (8, [1.0]), (9, [None] + [1.0] * 63)]
    rows += [(10, [float("nan")] * 64), (11, [float("inf")] * 64), (12, [0.0] * 64), (13, [-0.0] * 64), (14, [])]
    frame = spark.createDataFrame([(*x, "x") for x in rows], "vec_id long, embedding array<double>, cluster string")
    assert sorted(str(tuple(x)) for x in centroids.op12(frame).collect()) == plain(rows)


def test_fewer_rows_than_centroids(spark):
    rows = [(i, [float(i)] * 64) for i in range(3)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(str(tuple(x)) for x in centroids.op12(frame).collect()) == plain(rows)
    assert centroids.op12(frame.limit(0)).collect() == []


def test_distances_beyond_a_long(spark):
    """The cluster is exact; what a long can't hold is null."""
    rows = [(i, [float(i % 5) * 1e9] + [0.25] * 63) for i in range(20)] + [(20, [3e14] + [1e14] * 63)] * 2
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    made = centroids.op12(frame).collect()
    assert len(made) == 22 and sorted(str((x.vec_id, x.cluster)) for x in made) == sorted(
        str((i, int(c.split(", ")[1]))) for i, c in ((int(p[1:].split(", ")[0]), p) for p in plain(rows))
    )
    assert sorted(str(tuple(x)) for x in made) == plain(rows)
