import hashlib
import math

import numpy as np
from covlens.llm.centroid_clustering import cluster, integers, nearest


def brute(rows, dims, count=8, rounds=10):
    """Per kept row: (vec_id, cluster, distance, cluster inertia, inertia, hash of the centroid)."""
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in named[:count]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        found = assign()
        for j in range(len(centroids)):
            mine = [v for (_, v), (_, c) in zip(kept, found, strict=True) if c == j]
            if mine:
                centroids[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    found = assign()
    inertia = {j: sum(d for d, c in found if c == j) for j in range(len(centroids))}
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    fits = lambda x: x if x < 1 << 63 else None
    whole = all(d < 1 << 63 for d, _ in found)
    return [
        (i, c, fits(d), fits(inertia[c]) if all(x < 1 << 63 for x, k in found if k == c) else None, fits(sum(inertia.values())) if whole else None, hashes[c])
        for (i, _), (d, c) in zip(kept, found, strict=True)
    ]


def _check(spark, rows, dims, **options):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, distance string")
    got = [tuple(r) for r in cluster(df, dims=dims, **options).collect()]
    assert sorted(got, key=str) == sorted(brute(rows, dims, **options), key=str)
    return got


def test_walk_finds_the_nearest_with_ties():
    rng = np.random.default_rng(1)
    for dims, spread in [(1, 4), (2, 3), (5, 50), (64, 1000)]:
        x, c = rng.integers(-spread, spread, (300, dims)), rng.integers(-spread, spread, (8, dims))
        c[5] = c[2]
        exact = ((x[:, None, :] - c) ** 2).sum(2)
        found, distance = nearest(x, c)
        assert (found == exact.argmin(1)).all() and (distance == exact.min(1)).all()


def test_far_centroids_do_not_matter():
    found, distance = nearest(np.array([[1, 1], [9, 9]]), np.array([[0, 0], [10, 10], [900, 900]]))
    assert found.tolist() == [0, 1] and distance.tolist() == [2, 2]


def test_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), (rng.standard_normal(6) + 3 * (i % 4)).tolist()) for i in range(200)]
    rows += [(7, rows[7][1]), (7, rows[9][1]), (500, rows[3][1])]  # repeated rows and ids
    _check(spark, rows, 6)
    _check(spark, [(i, [round(x) / 1024 for x in v]) for i, v in rows], 6)  # many ties


def test_odd_rows(spark):
    rows = [
        (1, None), (2, []), (3, [1.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (None, [0.25, 0.5]),
        (8, [0.25, 0.5]), (9, [-0.0, -1e-9]), (9, [0.1, 0.2]), (10, [1.0, 2.0, 3.0]), (11, [0.25, 0.5]),
    ]
    got = _check(spark, rows, 2)
    assert sorted(str(r[0]) for r in got) == ["11", "8", "9", "9", "None"]
    _check(spark, rows, 2, count=2)


def test_huge_components(spark):
    rows = [(i, [1e300 * i, -1.0]) for i in range(5)] + [(10 + i, [float(i), 2.0**60]) for i in range(5)]
    _check(spark, rows, 2, count=3)


def test_empty(spark):
    assert _check(spark, [], 2) == [] and _check(spark, [(1, None)], 2) == []


def test_integers():
    assert integers(np.array([[-0.1, 0.1, 1.0]])).tolist() == [[-103, 102, 1024]]
    assert integers(np.array([[2.0**70]])).tolist() == [[2**80]]
