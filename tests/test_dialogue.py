import json
import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import dialogue as D
from quarry.operators import metrics as M
from quarry.operators import replay as R
from quarry.streaming.replay import step


def turn(i, kind, target=(), covered=(), missing=(), answer="x" * 23, events=(), **more):
    return {
        "turn_id": f"T{i}", "question_id": more.pop("question_id", f"Q{i}"), "question_type": kind, "target_kc_ids": list(target), "model_answer": answer,
        "judge_result": {"state": "X", "coverage": {"target_kc_ids": list(target), "covered_kc_ids": list(covered), "missing_kc_ids": list(missing)}, "hallucination_events": list(events), **more.pop("judge", {})}, **more,
    }


def frame(spark, *papers):
    lines = [json.dumps({"paper_id": f"p{i}", "target_model": "m", "turns": t}) for i, t in enumerate(papers)]
    return spark.createDataFrame([(x,) for x in lines], "v string").select(F.from_json("v", D.TRAJECTORY).alias("r")).select("r.*")


EVENT = {"event_id": "E1", "hallucination_type": "challenge_false_premise_acceptance", "related_kc_ids": ["K1"], "source_question_id": "Q2"}


def test_worked_example(spark):
    df = frame(spark, [turn(1, "macro_main_question", ["K1", "K2"], ["K1"], ["K2"]), turn(2, "challenge_question", ["K1"], events=[EVENT], judge={"challenge_result": {"failed": True}})])
    turns = D.turns_of(df, "paper_id")
    found = {r.metric: (r.numerator, r.denominator, r.value) for r in D.metric_pairs(D.counts(turns, "paper_id"), D.repair_tasks(turns, "paper_id"), "paper_id").collect()}
    want = {
        "one_turn_kc_coverage": (1, 2, 0.5), "one_turn_macro_complete_rate": (0, 1, 0.0), "challenge_failure_rate": (1, 1, 1.0), "text_challenge_failure_rate": (1, 1, 1.0),
        "multimodal_challenge_failure_rate": (0, 0, None), "mean_hallucination_events": (1, 1, 1.0), "hallucination_turn_rate": (1, 2, 0.5), "hallucination_event_density": (1, 2, 0.5),
        "detail_repair_success_rate": (0, 0, None), "hallucination_repair_success_rate": (0, 0, None), "detail_repair_avg_rounds": (0, 0, None), "hallucination_repair_avg_rounds": (0, 0, None),
        "mean_total_turns": (2, 1, 2.0), "mean_answer_chars_per_turn": (46, 2, 23.0),
    }
    assert found == want


def test_repairs(spark):
    fix = lambda i, covered, events=(), kind="detail", root="T1", q="Q1": turn(i, f"{kind}_followup", covered=covered, events=events, repair_context={"repair_type": kind, "root_turn_id": root, "root_question_id": q, "remaining_kc_ids": ["K2"]})
    main = turn(1, "main", ["K1", "K2"], ["K1"], ["K2"])
    df = frame(spark, [main, fix(2, []), fix(3, ["K2"]), fix(4, ["K2"])], [main, fix(2, []), fix(3, []), fix(4, [])], [main, fix(2, [], [EVENT], "hallucination"), fix(3, [], (), "hallucination")], [fix(1, ["K2"], root="T9"), main | {"turn_id": "T9"}])
    turns = D.turns_of(df, "paper_id")
    found = {r.paper_id: (r.repair_type, r.attempts, r.succeeded, r.exhausted, r.span) for r in D.repair_tasks(turns, "paper_id").collect()}
    assert found == {"p0": ("detail", 2, True, False, 3), "p1": ("detail", 3, False, True, 4), "p2": ("hallucination", 2, True, False, 3)}
    assert [r.paper_id for r in D.orphaned_repairs(turns, "paper_id").collect()] == ["p3"]


def test_fallbacks_violations_and_categories(spark):
    old = turn(1, "challenge_question", ["K1"], judge={"covered_kc_ids": ["K1", "K1"]})
    del old["judge_result"]["coverage"]
    df = frame(spark, [old, turn(2, "challenge_question", events=[EVENT, EVENT | {"hallucination_type": "odd", "related_kc_ids": ["a", "a"]}, {"event_id": "E3"}])], [turn(1, " "), turn(1, "main")], [])
    turns = D.turns_of(df, "paper_id")
    (a, b, *_) = turns.filter("paper_id = 'p0'").orderBy("turn_index").select(D.kc_ids(F.col("turn"), "covered").alias("c"), D.coverage_complete(F.col("turn")).alias("full"), D.challenge_failed(F.col("turn")).alias("f"), D.modality(F.col("turn")).alias("m")).collect()
    assert (a.c, a.full, a.f, a.m) == (["K1"], True, False, "text") and b.f
    assert sorted((r.paper_id, r.violation) for r in D.turn_violations(df, "paper_id").collect()) == [("p1", "blank question_type"), ("p1", "repeated turn_id"), ("p2", "no turns")]
    events = {r.event_at: (r.category, sorted(r.issues)) for r in D.event_rows(turns, "paper_id").collect()}
    assert events[0] == ("challenge_false_premise_acceptance", []) and events[1] == (None, ["repeated_related_ids", "unmapped_category"])
    assert events[2] == (None, ["empty_related_ids", "missing_label", "missing_source_question"])


def test_policy_expressions(spark):
    rows = [("challenge_question", None, "overclaim", None), ("thread_bridge_question", "MISLED", None, None), ("review_followup", "X", None, "wrong_relation_challenge"), ("main", "GLOBAL_OVERCLAIM", "x", "y")]
    df = spark.createDataFrame(rows, "q string, s string, mode string, kind string")
    got = df.select(D.family(F.col("q"), F.col("s")), D.challenge_event_type(F.coalesce("mode", F.lit("")), F.coalesce("kind", F.lit(""))), D.action(F.col("q"))).collect()
    assert [tuple(r) for r in got] == [
        ("challenge_failure", "challenge_overclaim_acceptance", "next_main_question"), ("challenge_failure", "challenge_failure", "thread_question"),
        ("review_regression", "challenge_wrong_relation_acceptance", "review_followup"), ("fabricated_claim", "challenge_failure", "next_main_question"),
    ]


def test_replay_equals_fold(spark):
    random.seed(1)
    rows = [(d, i, random.choice(["HALLUCINATION", "OK", "OK"]), random.sample("abcd", random.randint(0, 2)), random.sample("abcd", random.randint(0, 2))) for d in range(20) for i in range(12)]
    df = spark.createDataFrame(rows, "d int, i int, state string, covered array<string>, missing array<string>")
    marked = R.marks(df, ["d"], "i", F.col("state"), F.col("covered"), F.col("missing"))
    got = {(r.d, r.kc_id): r.status for r in R.states(marked, ["d"], ["i"]).collect()}
    want = {}
    for d, _, state, covered, missing in rows:
        for k in {*covered, *missing}:
            mark = "bad" if state == "HALLUCINATION" else "covered" if k in covered else "missing"
            want[d, k] = step(*want.get((d, k), (None, None)), mark)
    assert got == {k: s for k, (s, _) in want.items()}


def test_metric_checks(spark):
    df = spark.createDataFrame([(0.5, 1, 2), (0.6, 1, 2), (None, 0, 0), (0.0, 0, 0)], "v double, n int, d int")
    assert M.pair_violations(df, "v", "n", "d").count() == 2
    a, b = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, None)], "k int, v double"), spark.createDataFrame([(1, 1.0 + 1e-13), (3, None), (4, 1.0)], "k int, v double")
    assert sorted(r.k for r in M.differences(a, b, ["k"], "v", 1e-12).collect()) == [2, 4]
    assert M.duplicate_keys(a.union(a), ["k"]).count() == 3
    with pytest.raises(ValueError):
        from quarry.operators.external import strict

        strict(a, "rows")


def test_normal_form(spark):
    from quarry.operators import normalize as N

    bad = turn(1, "challenge_question", ["K1"], ["K1"], judge={"state": "MISLED", "coverage": {"covered_kc_ids": ["K1", "K1"], "missing_kc_ids": ["K2"]}}, target_failure_mode="overclaim")
    fixing = turn(2, "hallucination_followup", judge={"state": "HALLUCINATION"}, repair_context={"repair_type": "hallucination", "root_turn_id": "T1", "root_question_id": "Q1"})
    step_ = turn(3, "thread_bridge_question", ["K1"], [], ["K1"], judge={"state": "INCOMPLETE"})
    done = turn(4, "main", ["K1"], ["K1"], judge={"state": "INCOMPLETE", "hallucination_events": [{"hallucination_type": "x"}]})
    rows = N.normalized(D.turns_of(frame(spark, [bad, fixing, step_, done]), "paper_id")).orderBy("turn_index").collect()
    assert [tuple(e)[:4] for e in rows[0].events] == [("H_T1_1", "challenge_overclaim_acceptance", "challenge_failure", ["K1", "K2"])]
    assert rows[0].coverage.covered_kc_ids == ["K1"] and not rows[0].coverage.coverage_complete and rows[0].challenge_result.failed and rows[0].thread_result is None
    assert rows[1].events == [] and rows[2].thread_result.partial and rows[2].state == "INCOMPLETE"
    assert rows[3].state == "MAIN_PROGRESS" and rows[3].events[0].event_id == "H_T4_1" and rows[3].events[0].source_question_id == "Q4" and rows[3].challenge_result is None
