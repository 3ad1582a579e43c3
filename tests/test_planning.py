from pyspark.sql import functions as F

from quarry.operators import external as E
from quarry.operators import graph as G
from quarry.operators import planning as P
from quarry.operators import selection as X

NODES = [("KC1", "U1", "M1", 0.9, "strong", False, ["no"], "A1"), ("KC2", "U1", "M1", 0.8, "weak", True, [], None), ("KC10", "U2", "M1", 0.8, "weak", False, ["x", "y"], "A1"), ("KC3", "U3", "M2", 0.1, "weak", False, [], None)]
SCHEMA = "kc_id string, unit_id string, macro_id string, score double, claim_strength string, is_general boolean, forbidden_claims array<string>, asset_id string"


def nodes(spark):
    return spark.createDataFrame(NODES, SCHEMA).withColumns({"claim": F.concat(F.lit("c"), "kc_id"), "asset_type": F.lit("figure")})


def test_contexts_and_skips(spark):
    n = nodes(spark)
    units, macros = spark.createDataFrame([("U1",), ("U2",), ("U9",)], "unit_id string"), spark.createDataFrame([("M1",), ("M2",), ("M3",)], "macro_id string")
    assert [tuple(r) for r in P.unit_contexts(n, units).collect()] == [("U1", ["KC1", "KC2"])]
    assert [(r.macro_id, r.batch, r.kc_ids) for r in P.macro_contexts(n).collect()] == [("M1", 0, ["KC1", "KC10", "KC2"])]
    assert sorted((r.unit_id, r.n_kcs) for r in P.skipped_units(units, n).collect()) == [("U2", 1), ("U9", 0)]
    assert sorted(tuple(r) for r in P.skipped_macros(macros, n).collect()) == [("M2", 1, 1), ("M3", 0, 0)]
    edges = spark.createDataFrame([("M1", "M2"), ("M2", "M3")], "source string, target string")
    assert P.skipped_macro_edges(edges, n).collect()[0].target == "M3"
    assert P.adjacent_contexts(edges, n).select("source_kc_ids").first()[0] == ["KC1", "KC10", "KC2"]
    active = spark.createDataFrame([("KC2",)], "kc_id string")
    assert sorted(tuple(r) for r in P.bank_counts(macros, n, active).collect()) == [("M1", 3, 1), ("M2", 1, 0), ("M3", 0, 0)]
    assert sorted((r.macro_id, r.target_kc_ids) for r in P.main_targets(n, active).collect()) == [("M1", ["KC2"]), ("M2", ["KC3"])]
    assert [(r.asset_id, r.kc_ids) for r in P.asset_references(n).collect()] == [("A1", ["KC1", "KC10"])]


def test_plans(spark):
    n = nodes(spark)
    edges = spark.createDataFrame([("E2", "KC1", "KC2", "solves"), ("E10", "KC1", "KC3", "tested_by")], "edge_id string, source string, target string, relation string")
    plans = P.overclaim_plans(n).unionByName(P.false_premise_plans(n)).unionByName(P.wrong_relation_plans(edges, spark.createDataFrame([("KC1",), ("KC2",)], "kc_id string")))
    assert plans.count() == 2 + 3 + 1 and plans.filter("challenge_type = 'wrong_relation_challenge'").first().trap == "KC2 solves KC1"
    assert P.deduplicated(plans.union(plans), ["trap"]).count() == 6
    pool = P.balanced(plans, ["false_premise_challenge", "overclaim_challenge", "wrong_relation_challenge"], ["trap"], 5)
    assert [(r.challenge_plan_id, r.challenge_type[:5]) for r in pool.orderBy("challenge_plan_id").collect()] == [("CHP_0001", "false"), ("CHP_0002", "overc"), ("CHP_0003", "wrong"), ("CHP_0004", "false"), ("CHP_0005", "overc")]
    used, tried = spark.createDataFrame([("CHP_0001",)], "challenge_plan_id string"), spark.createDataFrame([("CHP_0002", 3), ("CHP_0003", 2)], "challenge_plan_id string, n int")
    assert P.next_plan(pool, ["challenge_plan_id"], used, tried).first().challenge_plan_id == "CHP_0003"
    assert P.thread_plans(spark.createDataFrame([(f"T{i}",) for i in range(10)], "thread_id string")).count() == 24


def test_sections_and_context(spark):
    groups = spark.createDataFrame([("s1", "Intro"), ("s2", "Method"), ("s3", "Else")], "section_id string, section_title string")
    macros = spark.createDataFrame([("M1", ["intro", "S2"]), ("M2", ["Method"])], "macro_id string, source_sections array<string>")
    assert sorted((r.section_id, r.macro_id, r.resolution) for r in P.resolved_sections(groups, macros).collect()) == [("s1", "M1", "resolved"), ("s2", None, "ambiguous"), ("s3", None, "unresolved")]
    blocks = spark.createDataFrame([("p", f"b{i}", i, f"t{i}") for i in range(4)], "paper_id string, block_id string, order int, text string")
    assets = spark.createDataFrame([("p", ["b1", "b2"], "[table]")], "paper_id string, block_ids array<string>, rendered string")
    assert P.evaluation_context(blocks, assets).first().text == "t0\n\n[table]\n\nt3"


def test_clients_and_checks(spark):
    df = spark.createDataFrame([("a b",), (None,), ("a b",)], "t string")
    rows = E.embedded(E.chatted(df, "t", "said"), "t", "v").collect()
    assert rows[0].said == rows[2].said and rows[0].said.startswith("offline:") and rows[1].said is None and rows[1].v is None and len(rows[0].v) == 64
    assert E.trials(df, spark.createDataFrame([("s1",), ("s2",)], "solver string"), "t").count() == 6
    edge = spark.createDataFrame([("K1", "K1", True, None, "U1", "U2")], "source string, target string, source_known boolean, target_known boolean, source_unit string, target_unit string")
    assert sorted(r.violation for r in E.violations(edge, ["source"], E.edge_checks("unit")).collect()) == ["known_ends", "no_loop", "one_unit"]


def test_graph_text_and_sets(spark):
    n, e = spark.createDataFrame([("K1", 'say "x"'), ("K2", None)], "k string, c string"), spark.createDataFrame([("K1", "K2", "solves")], "s string, t string, r string")
    lines = [r.line for r in G.mermaid(n, e, "k", "c", "s", "t", "r").orderBy("part", "id").collect()]
    assert lines == ["graph TD", "    K1[\"say 'x'\"]", '    K2[""]', "    K1 -->|solves| K2"]
    assert G.unknown_endpoints(e, n.filter("k = 'K1'"), "s", "t", "k").count() == 1
    a = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    assert X.appended(a, spark.createDataFrame([(2, "z"), (3, "c"), (3, "d")], "id int, v string"), ["id"]).count() == 3
    assert X.shuffled(a, "id", 1).count() == 2
    got = a.select(X.merged_sequences(F.array(F.lit(2), F.lit(1)), F.array(F.lit(1), F.lit(3))).alias("m"), X.stop_reason(F.array(F.lit(1)), F.array(F.lit(1)), F.array().cast("array<int>")).alias("s")).first()
    assert got.m == [2, 1, 3] and got.s == "pool_exhausted"


def test_wrong_relation_plans_leave_no_tie(spark):
    rows = [("KC1", f"KC{i}", "E1", "equals") for i in (10, 3, 2)] + [("KC1", "KC2", "E1", "precedes")]
    for shown in (rows, rows[::-1]):
        edges = spark.createDataFrame(shown, "source string, target string, edge_id string, relation string")
        assert [r.trap for r in P.wrong_relation_plans(edges, nodes(spark), 3).orderBy("trap").collect()] == ["KC2 equals KC1", "KC2 precedes KC1", "KC3 equals KC1"]
