import hashlib

import numpy as np
import pytest

from quarry.llm import clusters


def plain(rows, dim, k, rounds, by, seed):
    """The contract, vector by vector in plain whole numbers: id, cluster, distance, and the centroids."""
    kept = [(i, [int(np.floor(by * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    said = sorted((i is None, "" if i is None else hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept)
    centroids = [v for *_, v in said[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    pick = lambda: [min((far(v, c), j) for j, c in enumerate(centroids)) for _, v in kept]
    for _ in range(rounds):
        of = pick()
        for j in range(len(centroids)):
            if own := [v for (_, v), (_, x) in zip(kept, of, strict=True) if x == j]:
                centroids[j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    of = pick()
    return sorted(((i, j, d) for (i, _), (d, j) in zip(kept, of, strict=True)), key=repr), centroids


def found(spark, rows, dim, k, rounds, by=16, seed=3, kind="double"):
    done = clusters.fit(spark.createDataFrame(rows, f"id long, v array<{kind}>").repartition(3), "id", "v", dim, k, rounds, by, seed, segment=3)
    return clusters.assigned(done).collect(), done


@pytest.mark.parametrize("dim,k", [(7, 5), (4, 1), (9, 12)])
def test_equals_plain(spark, dim, k):
    rng = np.random.default_rng(dim)
    rows = [(int(i) if i % 11 else None, (rng.normal(size=dim) + i % 4).tolist()) for i in range(200)]
    rows += [rows[5], rows[5], (900, None), (901, [1.0] * (dim + 1)), (902, [None] + [1.0] * (dim - 1)), (903, [float("nan")] * dim), (904, [float("inf")] * dim), (905, [])]
    got, done = found(spark, rows, dim, k, 4)
    want, centroids = plain(rows, dim, k, 4, 16, 3)
    assert sorted(((r.id, r.cluster, r.distance) for r in got), key=repr) == want and done.centroids.tolist() == centroids
    for r in got:
        assert r.cluster_inertia == sum(d for _, j, d in want if j == r.cluster) and r.inertia == sum(d for *_, d in want)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest()


def test_ties_few_vectors_and_empty(spark):
    got, _ = found(spark, [(1, [0.0, 0.0]), (1, [0.0, 0.0]), (2, [0.0, 0.0])], 2, 8, 3)
    assert [(r.cluster, r.distance) for r in got] == [(0, 0)] * 3  # equal centroids: the smaller number
    got, done = found(spark, [(1, None), (2, [1.0])], 2, 8, 3)
    assert not got and not len(done.centroids)
    with pytest.raises(Exception, match="would not fit a long"):
        found(spark, [(1, [1e30, 0.0])], 2, 2, 1)


def test_bounds_hold_and_screen(spark):
    rng = np.random.default_rng(1)
    whole = rng.integers(-3000, 3000, (500, 64)) + 4000 * rng.integers(0, 4, (500, 1))
    centroids = whole[:8]
    lower = (whole**2).sum(1)[:, None] + (centroids**2).sum(1) - 2 * clusters.norms(whole) @ clusters.norms(centroids).T
    exact = ((whole[:, None] - centroids) ** 2).sum(2)
    assert (lower <= exact).all()
    number, best, count = clusters.nearest(whole, clusters.norms(whole), (whole**2).sum(1), centroids)
    assert (best == exact.min(1)).all() and (number == exact.argmin(1)).all()
    assert count < 500 * 8 * 0.7  # far centroids are screened out
    squares = np.array([0, 1, 2, 3, 4, 8, 9, 10, 2**52 - 1, 2**52, 2**52 + 1])
    assert clusters.rooted(squares).tolist() == [0, 1, 2, 2, 2, 3, 3, 4, 2**26, 2**26, 2**26 + 1]
