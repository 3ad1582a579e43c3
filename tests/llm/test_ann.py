import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import ann


def plain(rows, k, asks):
    """Exact search: (query_id, rank, vec_id, score) in order, by brute force."""
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for n, (i, v) in enumerate(ok):
        if asks(i):
            near = sorted((float(np.sqrt(((v - w) ** 2).sum())), j) for m, (j, w) in enumerate(ok) if m != n and len(w) == len(v))[:k]
            out += [(i, r, j, d) for r, (d, j) in enumerate(near, 1)]
    return sorted(out)


def same(got, want):
    got = sorted(map(tuple, got))
    assert [(x[0], x[1], round(x[3], 9)) for x in got] == [(x[0], x[1], round(x[3], 9)) for x in want] and sorted((x[0], x[2]) for x in got) == sorted((x[0], x[2]) for x in want)


@pytest.mark.parametrize("kind,sent", [("double", 32 << 20), ("float", 0)])
def test_equals_brute_force_where_shards_are_ranked_whole(spark, kind, sent):
    rng = np.random.default_rng(5)
    rows = [(i, np.float32(rng.normal(size=24 if i % 3 else 5)).astype(float).tolist()) for i in range(300)]
    rows += [rows[4], rows[30], (40, rows[20][1]), (None, rows[1][1]), (500, None), (510, [0.0] * 24), (520, [None] + [1.0] * 23), (530, [float("nan")] * 24), (540, [float("inf")] * 24), (550, []), (560, [1.0]), (570, [2.0] * 40)]
    df = spark.createDataFrame(rows, f"vec_id long, v array<{kind}>").repartition(5)
    for size, k in ((64, 10), (7, 3), (1000, 400)):
        same(ann.search(df, "vec_id", "v", F.col("id") % 10 == 0, k=k, size=size, fan=2, most_sent=sent).collect(), plain(rows, k, lambda i: i % 10 == 0))


def test_a_third_of_equal_vectors(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=32).tolist()
    rows = [(i, v if i % 3 == 0 else rng.normal(size=32).tolist()) for i in range(900)]
    same(ann.search(spark.createDataFrame(rows, "vec_id long, v array<double>"), "vec_id", "v", F.col("id") % 30 == 0, wanted=50, size=450).collect(), plain(rows, 10, lambda i: i % 30 == 0))


def test_empty(spark):
    assert ann.search(spark.createDataFrame([], "vec_id long, v array<float>"), "vec_id", "v", F.lit(True)).count() == 0
    assert ann.search(spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, v array<float>"), "vec_id", "v", F.lit(True)).count() == 0


@pytest.mark.parametrize("wanted", [1, 5, 60, 399])
def test_probing_finds_every_code_within_the_radius(wanted):
    rng = np.random.default_rng(wanted)
    model = ann.learned(rng.normal(size=(400, 20)))
    codes = model.codes(rng.normal(size=(400, 20)))
    orders = np.argsort(codes, axis=0, kind="stable").T
    starts = np.stack([np.searchsorted(c[o], np.arange((1 << ann.SUB) + 1)) for c, o in zip(codes.T, orders, strict=True)])
    for q in [*codes[:5], *model.codes(rng.normal(size=(5, 20)))]:
        rows, r = ann.probed(q, codes, orders, starts, wanted)
        d = np.bitwise_count(codes ^ q).sum(axis=1, dtype=int)
        assert rows.tolist() == np.flatnonzero(d <= r).tolist() and len(rows) >= wanted and (d <= r - 1).sum() < wanted


@pytest.mark.parametrize("clusters,spread,dim", [(1, 1.0, 64), (20, 0.3, 64), (50, 0.05, 32), (10, 1.0, 200)])
def test_recall(spark, clusters, spread, dim):
    """Shards that are not ranked whole: 8,000 vectors in one shard, 4 % of which a radius must hold."""
    rng = np.random.default_rng(dim + clusters)
    x = rng.normal(size=(clusters, dim))[rng.integers(0, clusters, 8000)] + spread * rng.normal(size=(8000, dim))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, v array<float>")
    got = ann.search(df, "vec_id", "v", F.col("id") % 100 == 0, wanted=ann.WANTED, size=8000).collect()
    q = np.arange(0, 8000, 100)
    d = ((x[q] ** 2).sum(1)[:, None] + (x**2).sum(1) - 2 * x[q] @ x.T)
    d[np.arange(len(q)), q] = np.inf
    true = {(int(a), int(b)) for a, row in zip(q, np.argsort(d, axis=1)[:, :10], strict=True) for b in row}
    assert len(got) == 800 and len(true & {(r.query_id, r.vec_id) for r in got}) / len(true) >= 0.9


DIR = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="the tables are not here")
def test_recall_of_the_query(spark):
    from quarry.llm import queries

    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DIR}/embeddings.parquet").collect()]
    want = plain(rows, 10, lambda i: i % 100 == 0)
    got = queries.op13_nearest_neighbours(spark, DIR).collect()
    assert len(got) == len(want) and len({(x[0], x[2]) for x in want} & {(r.query_id, r.vec_id) for r in got}) / len(want) >= 0.9
