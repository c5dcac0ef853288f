"""Clustering with pivots against plain Lloyd rounds in unbounded integers."""

import hashlib
import math

import numpy as np
import pytest

from sitelight.llm import centroids

LAYOUT = "vec_id long, embedding array<double>, cluster string, distance string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "c", "d") for i, v in rows], LAYOUT).repartition(3)


def lloyd(rows, k, rounds, seed, dim, scale):
    cut = lambda x: max(-(2**63), min(2**63 - 1, math.floor(x)) if math.isfinite(x) else (2**63 - 1 if x > 0 else -(2**63)))
    kept = [(i, [cut(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centres = [list(v) for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for n, members in groups.items():
            centres[n] = [sum(column) // len(members) for column in zip(*members, strict=True)]
    found = [(i, *nearest(v)) for i, v in kept]
    inertia = {n: sum(d for _, d, m in found if m == n) for n in range(len(centres))}
    top = lambda x: min(x, 2**63 - 1)
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, n, top(d), top(inertia[n]), top(sum(inertia.values())), name[n]) for i, d, n in found), key=repr)


def found(spark, rows, k, rounds, seed, dim, scale, **more):
    result, _, shares = centroids.cluster(frame(spark, rows), k, rounds, seed, dim, scale, **more)
    assert result.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted(map(tuple, result.collect()), key=repr), shares


@pytest.mark.parametrize("far", [0, 5])
def test_equals_plain_rounds(spark, far):
    draw = np.random.default_rng(4)
    middle = draw.normal(size=(6, 5)) * 3
    rows = [(int(i), [float(x) for x in middle[i % 6] + draw.normal(size=5)]) for i in range(300)]
    got, shares = found(spark, rows, 6, 4, 3, 5, 16, far_pivots=far)
    assert got == lloyd(rows, 6, 4, 3, 5, 16)
    assert len(shares) == 5 and all(1 / 6 <= s < 0.8 for s in shares)


def test_ties_repeats_and_empty_clusters(spark):
    rows = [(1, [0.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (4, [1.0, 0.0]), (4, [1.0, 0.0]), (4, [5.0, 5.0]), (5, [-1.0, -1.0]), (None, [9.0, 9.0])]
    for seed in range(4):
        assert found(spark, rows, 5, 3, seed, 2, 1)[0] == lloyd(rows, 5, 3, seed, 2, 1)


def test_rows_that_take_no_part(spark):
    rows = [(1, None), (2, [1.0]), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [1.0, float("-inf")]), (6, [0.5, -0.26]), (7, []), (8, [0.0, 0.0])]
    got, _ = found(spark, rows, 8, 2, 3, 2, 4)
    assert got == lloyd(rows, 8, 2, 3, 2, 4) and {r[0] for r in got} == {6, 8}


def test_large_components_stay_exact(spark):
    rows = [(1, [1e18, 3.0]), (2, [1e18, -3.0]), (3, [-1e18, 3e9]), (4, [3e38, 1.0]), (5, [7e9, 2.0]), (6, [7e9, 3.0]), (7, [1e308, -1e308]), (8, [0.0, 0.0])]
    for seed in (3, 4):
        assert found(spark, rows, 3, 3, seed, 2, 1)[0] == lloyd(rows, 3, 3, seed, 2, 1)


def test_empty_table(spark):
    got, _ = found(spark, [], 8, 10, 3, 64, 1024)
    assert got == []


def test_bounds_spare_distances_and_never_change_the_nearest():
    draw = np.random.default_rng(5)
    x = draw.integers(-300, 300, (400, 64)) + 2000 * draw.integers(0, 2, (400, 64)).cumsum(axis=0)[:, :1]
    centres = x[draw.integers(0, 400, 12)]
    pivots = centres + draw.integers(-5, 5, centres.shape)
    cluster, best, measured = centroids.assign(x, centroids.pivot_distances(x, pivots), centres, pivots)
    all_distances = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2)
    assert (cluster == all_distances.argmin(axis=1)).all() and (best == all_distances.min(axis=1)).all()
    assert measured < 0.3 * x.shape[0] * len(centres)
