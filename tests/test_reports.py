import json
import random

from pyspark.sql import functions as F

from quarry.operators import dialogue as D
from quarry.operators import replay as R
from quarry.operators import reports as P


def test_component_and_macro_metrics(spark):
    kc = spark.createDataFrame([("p", "K1", "lit", "critical", True), ("p", "K2", "missing", "normal", True), ("p", "K3", "corrected", "critical", False), ("q", "K1", "unlit", "normal", False)], "p string, kc_id string, status string, importance string, is_target boolean")
    macros = spark.createDataFrame([("p", "M1", ["K1"], [], 3, 1, True), ("p", "M2", ["K1", "K2"], [], 4, 2, False), ("p", "M3", [], ["a", "a"], 0, 4, True), ("q", "M1", [], [], 0, 0, False)], "p string, macro_id string, target_kc_ids array<string>, covered_kc_ids array<string>, bank_count int, active_count int, asked boolean")
    c = {r.p: r for r in P.coverage(kc, ["p"]).collect()}
    assert (c["p"].global_kc_lit_count, c["p"].target_kc_coverage_rate, c["p"].critical_kc_coverage_rate, c["q"].target_kc_coverage_rate) == (2, 0.5, 1.0, 0.0)
    m = {r.p: r for r in P.macro_metrics(macros, kc, ["p"]).collect()}
    assert (m["p"].macro_total, m["p"].macro_main_question_asked_rate, m["p"].macro_completion_rate, m["p"].average_active_kc_coverage_per_macro) == (3, 0.6667, 0.3333, 0.5833)
    b = {r.p: r for r in P.bank_metrics(macros, kc, ["p"]).collect()}
    assert (b["p"].kc_bank_total, b["p"].active_to_bank_ratio, b["q"].active_to_bank_ratio) == (7, 0.2857, 0.0)
    both = P.report([P.coverage(kc, ["p"]), P.macro_metrics(macros, kc, ["p"])], ["p"])
    assert both.count() == 2 and P.means(both).first().macro_total == 2.0


def turns(spark, rows):
    made = [json.dumps({"paper_id": p, "target_model": "m", "turns": t}) for p, t in rows]
    return D.turns_of(spark.createDataFrame([(x,) for x in made], "v string").select(F.from_json("v", D.TRAJECTORY).alias("r")).select("r.*"), "paper_id")


def test_turn_metrics(spark):
    ask = lambda i, macro: {"turn_id": f"T{i}", "question_type": "main", "macro_id": macro}
    bad = {"turn_id": "C1", "question_type": "challenge_question", "challenge_type": "overclaim_challenge", "asset_references": [{"asset_type": "table"}, {"asset_type": "figure"}], "judge_result": {"state": "MISLED", "hallucination_events": [{"hallucination_type": "x"}]}}
    good = {"turn_id": "C2", "question_type": "thread_challenge_question", "judge_result": {"state": "CHALLENGE_RESISTED"}}
    t = turns(spark, [("p", [ask(1, "M2"), ask(2, "M1"), ask(3, "M10"), bad, good]), ("q", [ask(1, "M1")]), ("r", [ask(1, "odd"), ask(2, "M1")]), ("s", [good])])
    assert {r.paper_id: r.macro_order_following_score for r in P.order_score(t, ["paper_id"]).collect()} == {"p": 0.6667, "q": 1.0, "r": 0.0, "s": 0.0}
    c = {r.paper_id: r for r in P.challenge_metrics(t, ["paper_id"]).collect()}
    assert (c["p"].challenge_total, c["p"].challenge_failure_rate, c["p"].challenge_resistance_rate) == (2, 0.5, 0.5) and c["q"].challenge_total == 0 and c["q"].challenge_by_type == {}
    assert c["p"].challenge_by_type == {"overclaim_challenge": 1, "unknown": 1} and c["p"].challenge_failure_by_type_and_modality == {"x|figure+table": 1}
    events = spark.createDataFrame([("p", "review_regression", "resolved"), ("p", None, None)], "paper_id string, hallucination_type string, status string")
    e = {r.paper_id: r for r in P.event_metrics(t, events, ["paper_id"]).collect()}
    assert (e["p"].hallucination_event_count, e["p"].hallucination_repair_success_rate, e["p"].hallucination_turn_rate, e["p"].hallucination_by_status) == (2, 0.5, 0.2, {"resolved": 1, "unknown": 1})


def test_small_groups(spark):
    g = spark.createDataFrame([("p", "resolved", "detail"), ("p", None, "detail"), ("p", "exhausted", None)], "p string, status string, task_type string")
    assert P.gap_metrics(g, ["p"]).first().coverage_gap_by_status == {"exhausted": 1, "resolved": 1, "unknown": 1} and P.task_metrics(g, ["p"]).first().stage_task_by_type == {"detail": 2, "unknown": 1}
    c = P.claim_metrics(spark.createDataFrame([("p", "SUPPORTED", ["a", "b"]), ("p", "SUPPORTED", ["a"]), ("p", "OVERCLAIM", [])], "p string, label string, kc_ids array<string>"), ["p"]).first()
    assert (c.verified_claim_count, c.supported_claim_rate, c.supported_kc_count, c.overclaim_count) == (3, 0.6667, 2, 1)
    th = P.thread_metrics(spark.createDataFrame([("p", "completed_success", None, None), ("p", "active", True, None), ("p", "reviewed_inconsistent", False, False)], "p string, status string, success boolean, consistent boolean"), ["p"]).first()
    assert (th.thread_completion_rate, th.thread_success_rate, th.thread_review_consistency_rate) == (0.6667, 0.6667, 0.0)
    b = P.breakdown(g, ["p"], "task_type", F.col("status") == "resolved", F.col("status") == "x", F.col("status").isNull())
    assert sorted((r.task_type, r.question_count, r.failed_count, r.incomplete_count) for r in b.collect()) == [("detail", 2, 1, 1), ("unknown", 1, 0, 0)]


def test_corrections_equal_a_fold(spark):
    random.seed(2)
    rows = [(d, i, random.choice(["HALLUCINATION", "OK"]), random.sample("abc", random.randint(0, 2)), random.sample("abc", random.randint(0, 2))) for d in range(25) for i in range(10)]
    df = spark.createDataFrame(rows, "d int, i int, state string, covered array<string>, missing array<string>")
    got = {r.d: (r.self_correction_rate, r.average_correction_turns) for r in P.correction_metrics(R.marks(df, ["d"], "i", F.col("state"), F.col("covered"), F.col("missing")), ["d"], "i").collect()}
    for d in range(25):
        opened, deltas = {}, []
        for _, i, state, covered, missing in (r for r in rows if r[0] == d):
            for k in {*covered, *missing} if state == "HALLUCINATION" else set(covered):
                if state == "HALLUCINATION":
                    opened.setdefault(k, i)
                elif k in opened:
                    deltas.append(i - opened.pop(k))
        n = len(opened) + len(deltas)
        want = (round(len(deltas) / n, 4), round(sum(deltas) / len(deltas), 4) if deltas else 0.0) if n else (0.0, 0.0)
        assert got.get(d, (0.0, 0.0)) == want
