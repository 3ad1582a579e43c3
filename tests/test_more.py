"""Fills in turn, quotas, relations of threads, grouping sets, and normal forms, against plain Python."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from quarry.functions.text import claim_key, nfkc
from quarry.operators import fills, planning, reports


def filled(blocks, reach):
    """One block after another, in place."""
    value = [b[1] for b in blocks]
    for i, (g, _, wanted) in enumerate(blocks):
        if value[i] is None and wanted:
            near = [j for d in range(1, reach + 1) for j in (i - d, i + d) if 0 <= j < len(blocks) and blocks[j][0] == g and value[j] is not None]
            value[i] = value[near[0]] if near else None
    return value


@pytest.mark.parametrize("reach", [1, 2, 5])
def test_fill_in_turn(spark, reach):
    r = random.Random(reach)
    gaps = [(g, "s" if r.random() < 0.12 else None, r.random() < 0.8) for g in ["a", "b", None, "c"] for _ in range(200)]
    chain = [("d", "x", False), *[("d", None, True)] * 40, *[("d", None, False)] * 7, *[("d", None, True)] * 9, ("d", "y", True)]
    blocks = [(g, None if v is None else f"{v}{i}", w) for i, (g, v, w) in enumerate(gaps + chain)]
    df = spark.createDataFrame([(g, i, v, w, {"n": i}) for i, (g, v, w) in enumerate(blocks)], "g string, at long, v string, w boolean, other map<string,int>").repartition(7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = fills.nearest_fill_in_turn(df, ["g"], ["at"], "v", F.col("w"), reach).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {x["at"]: x.filled for x in got} == dict(enumerate(filled(blocks, reach))) and len(got) == len(blocks)
    assert list(fills.folded(iter(blocks), reach)) == filled(blocks, reach)
    assert filled(chain, 5)[1:41] == ["x"] * 40  # further than one pass reaches


def test_quota_first(spark):
    r = random.Random(1)
    nodes = [(p, f"K{p}{i}", r.randint(0, 5), r.choice(["figure", "table", None])) for p in (1, 2, 3) for i in range(8 if p < 3 else 1)]
    edges = [(p, f"E{i}", r.choice([f"K{p}{j}" for j in range(12)]), r.choice([f"K{p}{j}" for j in range(12)])) for p in (1, 2, 3) for i in range(12)]
    for minimum, limit in ((2, 5), (0, 30), (9, 12)):
        got = planning.quota_first(spark.createDataFrame(nodes, "p long, k string, s int, kind string"), spark.createDataFrame(edges, "p long, edge_id string, source string, target string"), ["p"], "k", [F.desc("s")], F.col("kind") == "figure", minimum, limit)
        want = []
        for p in (1, 2, 3):
            own = sorted((n for n in nodes if n[0] == p), key=lambda n: (-n[2], n[1]))
            first = [n for n in own if n[3] == "figure"][:minimum]
            ids = {n[1] for n in own}
            plans = [("quota", [n[1]]) for n in first] + [("rank", [n[1]]) for n in own if n not in first]
            plans += [("edge", [e, a, b]) for q, e, a, b in sorted(edges, key=lambda e: int(e[1][1:])) if q == p and (a in ids or b in ids)]
            want += [(p, i, *x) for i, x in enumerate(plans[:limit], 1)]
        assert sorted((x.p, x.place, x.source, x.ids) for x in got.collect()) == sorted(want)
    short = planning.short_of_quota(spark.createDataFrame(nodes, "p long, k string, s int, kind string"), ["p"], F.col("kind") == "figure", 2)
    assert {x.p for x in short.collect()} == {p for p in (1, 2, 3) if sum(n[0] == p and n[3] == "figure" for n in nodes) < 2}


def test_thread_relations(spark):
    turns = [(1, "RT2", "T1", "bridge_reasoning", ["E2", "E1", "E9"]), (1, "RT10", "T1", "review_consistency", ["E1"]), (1, "RT1", "T1", "opening", ["E1"]), (1, "RT3", "T1", "bridge_reasoning", ["E3"]), (1, "RT3", "T2", "bridge_reasoning", None)]
    edges = [(1, "E1", "a", "b"), (1, "E2", "b", "c"), (1, "E3", "a", "zz"), (2, "E9", "a", "b")]
    got = planning.thread_relation_plans(
        spark.createDataFrame(turns, "p long, thread_id string, thread_turn_id string, role string, supporting_edge_ids array<string>"), spark.createDataFrame(edges, "p long, edge_id string, source string, target string"),
        spark.createDataFrame([(1, x) for x in "abc"], "p long, kc_id string"), ["p"], 5,
    )
    assert sorted((x.place, x.thread_id, x.edge_ids, x.kc_ids) for x in got.collect()) == [(1, "RT2", ["E2", "E1"], ["b", "c", "a"]), (2, "RT10", ["E1"], ["a", "b"])]


def test_breakdowns_are_one_scan(spark):
    rows = spark.createDataFrame([("p", "a", "m", "t", True), ("p", "a", None, "f", False), ("p", None, "m", "t", None), ("q", "b", "m", "t", True)], "k string, type string, scope string, modality string, bad boolean")
    found = reports.challenge_breakdowns(rows, ["k"], F.col("type"), F.col("scope"), F.col("modality"), F.col("bad"))
    p = next(r for r in found.collect() if r.k == "p")
    assert (p.n, p.n_failed, p.failure_rate, p.resistance_rate) == (3, 1, 0.3333, 0.6667)
    assert p.by_type == {"a": 2, "unknown": 1} and p.failed_by_type == {"a": 1} and p.by_scope == {"m": 2, "unknown": 1} and p.failed_by_modality == {"t": 1}
    assert p.by_type_and_modality == {"a|t": 1, "a|f": 1, "unknown|t": 1} and p.failed_by_type_and_modality == {"a|t": 1}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Expand") == 1 and plan.count("LogicalRDD") + plan.count("LocalRelation") == 1


def test_nfkc(spark):
    texts = ["plain Text 1", "ＦＵＬＬ Ｗidth １２", "ﬁne ﬂow ①②", "é é", "K Å", "", None, "日本 ㍿"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").select("i", nfkc(F.col("t")).alias("n"), claim_key(nfkc(F.col("t"))).alias("k")).collect()
    form = lambda t: unicodedata.normalize("NFKC", t)
    assert {r.i: (r.n, r.k) for r in got} == {i: (None, None) if t is None else (form(t), " ".join(re.findall("[a-z0-9]+", form(t).lower()))) for i, t in enumerate(texts)}
