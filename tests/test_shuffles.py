"""Queries over records keep their lines where they lie: no records are gathered, and steps over one trajectory need no join."""

import os

import pytest
from pyspark.sql import functions as F

from quarry.operators import dialogue as D
from quarry.operators import replay as Y
from quarry.operators import reports as R
from quarry.operators.similarity import similar_pairs
from quarry.plans import dialogues, sets

DIR = os.environ.get("QUARRY_TEST_DIR", "/root/testdata/sf0.001")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(DIR), reason="the tables are not here")
def test_turns_are_not_gathered(spark):
    for query in (dialogues.trajectory_counts, dialogues.turn_labels, dialogues.normalized_turns, dialogues.replayed_states):
        assert "collect_list" not in plan(query(spark, DIR)), query.__name__
    assert plan(dialogues.trajectory_metrics(spark, DIR)).count("Join") == 2  # lines with their orders, once for the counts and once for the repairs


def test_steps_over_a_trajectory_need_no_join(spark):
    turns = D.turns_of(spark.createDataFrame([], D.TRAJECTORY), "paper_id", "target_model").repartition(2, "paper_id")
    marked = spark.createDataFrame([], "d int, i int, kc_id string, mark string")
    for df in (D.repair_tasks(turns, "paper_id", "target_model"), D.orphaned_repairs(turns, "paper_id"), R.order_score(turns, ["paper_id"]), Y.states(marked, ["d"], ["i"]), D.metric_pairs(D.counts(turns, "paper_id"), D.repair_tasks(turns, "paper_id"), "paper_id")):
        assert "Join" not in plan(df)


def test_turns_that_share_their_ids(spark):
    t = lambda i, kind="main", **more: (i, {"turn_id": "T1", "question_id": "Q1", "question_type": kind, **more})
    fix = {"repair_context": {"repair_type": "hallucination", "root_turn_id": "T1", "root_question_id": "Q1"}}
    rows = [("a", *t(1)), ("a", *t(2)), ("a", *t(3, "hallucination_followup", **fix)), ("b", *t(1, "hallucination_followup", **fix)), ("b", *t(2)), (None, *t(1)), (None, *t(2, "hallucination_followup", **fix))]
    turn = F.from_json(F.to_json("t"), D.TURN)
    slim = "turn_id string, question_id string, question_type string, repair_context struct<repair_type:string,root_turn_id:string,root_question_id:string>"
    turns = spark.createDataFrame([(k, i, {**{"repair_context": None}, **x}) for k, i, x in rows], f"k string, turn_index int, t struct<{slim.replace(' string', ':string').replace('repair_context struct', 'repair_context:struct')}>").select("k", "turn_index", turn.alias("turn"))
    assert [tuple(r) for r in D.repair_tasks(turns, "k").collect()] == [("a", "hallucination", "T1", "Q1", 2, True, False, 3)]
    assert sorted((str(r.k), r.turn_index) for r in D.orphaned_repairs(turns, "k").collect()) == [("None", 2), ("b", 1)]


def test_order_of_turns_without_a_macro(spark):
    rows = [("a", 1, "M2"), ("a", 2, "x"), ("a", 3, "M1"), ("a", 4, "M3"), ("b", 1, "x"), ("c", 1, None)]
    turns = spark.createDataFrame(rows, "k string, turn_index int, m string").select("k", "turn_index", F.struct(F.lit("main").alias("question_type"), F.col("m").alias("macro_id")).alias("turn"))
    assert {r.k: r.macro_order_following_score for r in R.order_score(turns, ["k"]).collect()} == {"a": 0.6667, "b": 1.0, "c": 0.0}


@pytest.mark.skipif(not os.path.isdir(DIR), reason="the tables are not here")
def test_neighbours_are_sent_as_lists(spark):
    assert "(l_partkey" not in "".join(x for x in plan(sets.kc_connectivity(spark, DIR)).splitlines() if "Join" in x)


def test_tokens_are_never_joined_with_their_counts(spark, monkeypatch):
    from quarry.operators import similarity

    kept, stored = [], similarity.written
    monkeypatch.setattr(similarity, "written", lambda df, name, *a: kept.append((name, plan(df))) or stored(df, name, *a))
    rows = [(i, [f"w{j}" for j in range(i, i + 40)]) for i in range(30)]
    df = spark.createDataFrame(rows, "key long, tokens array<string>").withColumn("g", F.lit("a"))
    found = sorted((r.a, r.b) for r in similar_pairs(df, "key", "tokens", ["g"], 0.9, 5, most_sent=8).collect())
    assert found == [(i, j) for i in range(30) for j in range(i + 1, min(i + 3, 30))]
    assert not [name for name, said in kept if "Join" in said and name != "token-hot"]


def test_components_never_spoken_of_need_no_join(spark):
    found = spark.createDataFrame([("a", "K1", "lit", 1, 2), ("b", "K9", "lit", 1, 1), (None, "K1", "lit", 3, 3)], "d string, kc_id string, status string, n_bad int, n_corrected int")
    graph = spark.createDataFrame([("a", "K1"), ("a", "K2"), ("a", "K2"), (None, "K1")], "d string, kc_id string")
    got = Y.with_all(found, graph, ["d"])
    assert "Join" not in plan(got)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [("a", "K1", "lit", 1, 2), ("a", "K2", "unlit", 0, 0), ("a", "K2", "unlit", 0, 0), (None, "K1", "unlit", 0, 0)]))


@pytest.mark.skipif(not os.path.isdir(DIR), reason="the tables are not here")
def test_no_query_of_the_step_gathers_turns(spark):
    for name in ("trajectory_metrics", "report_order", "trajectory_categories", "answer_lengths", "trajectory_events", "trajectory_counts", "turn_buckets", "tasks_and_gaps"):
        assert "collect_list" not in plan(getattr(dialogues, name)(spark, DIR)), name
