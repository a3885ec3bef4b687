import hashlib
import math
import random

import numpy as np
import pytest

from tessera.llm import clustering

DIMS, K = 8, 5
SCHEMA = "vec_id long, embedding array<double>, cluster int, X string"


def plain(rows, k, rounds, dims, scale=256):
    """All exact distances in Python integers."""
    kept = [(i, [math.floor(scale * x) for x in e]) for i, e, *_ in rows if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) for x in e)]
    key = lambda r: (hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1])
    points = [r[1] for r in sorted(kept, key=key)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, p, strict=True)), c) for c, p in enumerate(points))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        for c, vs in groups.items():
            points[c] = [sum(xs) // len(vs) for xs in zip(*vs, strict=True)]
    return [(i, near(v)[1], near(v)[0]) for i, v in kept], points


def vectors(seed=3, n=300):
    dice = random.Random(seed)
    middles = [[dice.gauss(0, 1) for _ in range(DIMS)] for _ in range(6)]
    rows = [(i, [m + dice.gauss(0, 0.2) for m in dice.choice(middles)], 1, "x") for i in range(n)]
    rows += [(n + i, rows[7][1], None, None) for i in range(40)]  # one vector many times
    rows += [rows[0], rows[0], (0, [9.0] * DIMS, 1, "id again"), (n + 50, [-0.001] * DIMS, 0, ""), (n + 51, [0.0] * DIMS, 0, "")]
    bad = [None, [], [1.0] * (DIMS - 1), [1.0] * (DIMS + 1), [None] + [1.0] * (DIMS - 1), [math.nan] * DIMS, [math.inf] * DIMS, [-math.inf] + [0.0] * (DIMS - 1)]
    return rows + [(n + 60 + i, e, 0, "bad") for i, e in enumerate(bad)]


@pytest.mark.parametrize("segments", [1, 3, 8])
def test_equals_all_exact_distances(spark, segments):
    rows = vectors()
    got, points = clustering.cluster_vectors(spark.createDataFrame(rows, SCHEMA).repartition(5), k=K, rounds=4, dims=DIMS, segments=segments)
    want, middles = plain(rows, K, 4, DIMS)
    assert sorted((r["vec_id"], r["cluster"], r["distance"]) for r in got.collect()) == sorted(want)
    assert points.tolist() == middles


def test_report(spark):
    rows = vectors()
    got = clustering.cluster_report(spark.createDataFrame(rows, SCHEMA), k=K, rounds=2, dims=DIMS, segments=4).collect()
    want, points = plain(rows, K, 2, DIMS)
    by = {c: sum(d for _, k, d in want if k == c) for _, c, _ in want}
    assert {(r["cluster"], r["cluster_inertia"]) for r in got} == set(by.items())
    assert {r["inertia"] for r in got} == {sum(by.values())}
    assert {(r["cluster"], r["centroid_sha256"]) for r in got} == {(c, hashlib.sha256(",".join(map(str, points[c])).encode()).hexdigest()) for c in by}


def test_bounds_never_pass_a_distance():
    dice = np.random.default_rng(5)
    for spread in (3, 1000, clustering.LIMIT):
        x, c = dice.integers(-spread, spread + 1, (200, 64)), dice.integers(-spread, spread + 1, (40, 64))
        x[:40] = c  # distance 0
        near = clustering.Centroids.of(c, 16)
        bound = near.bounds(clustering.segment_norms(x, 16))
        exact = np.square(x[:, None, :] - c[None]).sum(axis=2)
        assert (bound <= exact).all()


def test_screening_leaves_few_of_separate_groups():
    dice = np.random.default_rng(6)
    c = dice.integers(-200, 200, (40, 64))
    c[:, :32] *= np.arange(1, 41)[:, None]
    x = np.repeat(c, 20, axis=0) + dice.integers(-5, 6, (800, 64))
    near = clustering.Centroids.of(c, 16)
    cluster, _, tested = near.nearest(x, clustering.segment_norms(x, 16))
    assert (cluster == np.repeat(np.arange(40), 20)).all() and tested.mean() < 10


def test_ties_go_to_the_smaller_number():
    near = clustering.Centroids.of(np.array([[4, 0], [0, 0], [0, 0], [2, 2]]), 1)
    cluster, best, _ = near.nearest(np.array([[0, 0], [2, 0]]), clustering.segment_norms(np.array([[0, 0], [2, 0]]), 1))
    assert cluster.tolist() == [1, 0] and best.tolist() == [0, 4]


def test_fewer_vectors_than_centroids_nulls_and_large_components(spark):
    rows = [(1, [1e300] * 2), (2, [-1e300] * 2), (None, [0.5, 0.25]), (None, [0.5, 0.25])]
    got = {(r["vec_id"], r["cluster"] is not None, r["distance"]) for r in clustering.cluster_report(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), dims=2, segments=1).collect()}
    assert got == {(1, True, 0), (2, True, 0), (None, True, 0)}
    floats = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0, 2.5])], "vec_id string, embedding array<float>")
    assert clustering.cluster_report(floats, dims=2, segments=2).count() == 2


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    out = clustering.cluster_report(empty, dims=DIMS, segments=2)
    assert out.count() == 0 and out.columns[:3] == ["vec_id", "cluster", "distance"]
    with pytest.raises(ValueError):
        clustering.cluster_vectors(empty.drop("embedding"))
