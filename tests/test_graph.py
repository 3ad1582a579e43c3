import os
import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import graph as G
from quarry.plans import sets

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("sent", [0, 5_000_000])
@pytest.mark.parametrize("size", [64, 1 << 24])
def test_members_of_groups_are_neighbours(spark, sent, size):
    random.seed(3)
    ids = [-5, 2**40, *range(100, 160)]
    nodes = spark.createDataFrame([(k, None if i % 9 == 8 else f"c{i % 4}") for i, k in enumerate(ids)], "k long, c string")
    groups = [random.sample([*ids[:40], 7, 8], random.randrange(1, 6)) for _ in range(80)] + [ids[1:50], [], [ids[2]], [7, 8]]
    df = spark.createDataFrame([(g,) for g in groups] + [(None,)], "m array<long>").repartition(5)
    got = G.group_connectivity(nodes, df, "m", "k", "c", most_sent=sent, size=size)
    pairs = spark.createDataFrame(sorted({(a, b) for g in groups for a in g for b in g if a < b}), "s long, t long")
    want = G.connectivity(nodes, pairs, "k", "c", "s", "t")
    shown = lambda x: sorted((r.k, r.degree, round(r.log_degree, 9), round(r.entropy, 9), round(r.connectivity, 9)) for r in x.collect())
    assert shown(got) == shown(want) and {r[1] for r in shown(got)} >= {0, 48}


def test_groups_without_neighbours(spark):
    nodes = spark.createDataFrame([(1, "a"), (2, "b")], "k long, c string")
    for groups, n in (([[1], [9, 1]], nodes), ([], nodes), ([[1, 2]], nodes.limit(0))):
        got = G.group_connectivity(n, spark.createDataFrame([(g,) for g in groups], "m array<long>"), "m", "k", "c").collect()
        assert [(r.degree, r.connectivity) for r in got] == [(0, 0.0)] * n.count()


@pytest.mark.skipif(not os.path.isdir(DIR), reason="the tables are not here")
def test_no_pair_of_suppliers_becomes_a_row(spark):
    rows = sets.kc_connectivity(spark, DIR).withColumn("one", F.lit(1))
    assert "explode" not in rows._jdf.queryExecution().optimizedPlan().toString()
