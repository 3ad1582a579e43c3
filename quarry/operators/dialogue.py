"""Dialogue records: turns of nested reports as rows, their accessors, counts, normal forms and labels.

A trajectory is one row with an array of turns; the accessors are expressions over one turn, so counts need no join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.metrics import category, category_pivot, ratio

EVENT = "struct<event_id:string,hallucination_type:string,hallucination_family:string,related_kc_ids:array<string>,status:string,source_question_id:string,followup_turns:array<string>>"
TURN = (
    "struct<turn_id:string,question_id:string,question_type:string,macro_id:string,target_kc_ids:array<string>,model_answer:string,"
    "requires_multimodal_input:boolean,asset_references:array<struct<asset_id:string,asset_type:string>>,target_failure_mode:string,challenge_type:string,"
    "repair_context:struct<repair_type:string,root_turn_id:string,root_question_id:string,remaining_kc_ids:array<string>>,"
    "judge_result:struct<state:string,confidence:double,covered_kc_ids:array<string>,missing_kc_ids:array<string>,"
    "coverage:struct<target_kc_ids:array<string>,covered_kc_ids:array<string>,missing_kc_ids:array<string>,coverage_complete:boolean>,"
    f"hallucination_events:array<{EVENT}>,challenge_result:struct<failed:boolean>>>"
)
TRAJECTORY = f"paper_id string, target_model string, turns array<{TURN}>"

# The types of events and the category that each falls into; others stay unmapped.
CATEGORIES = {
    "contradicted_kc_claim": "contradicted_kc_claim", "review_regression": "contradicted_kc_claim",
    "challenge_false_premise_acceptance": "challenge_false_premise_acceptance", "thread_premise_mutation_acceptance": "challenge_false_premise_acceptance",
    "challenge_overclaim_acceptance": "challenge_overclaim_acceptance", "thread_overclaim_acceptance": "challenge_overclaim_acceptance",
    "challenge_wrong_relation_acceptance": "challenge_wrong_relation_acceptance", "thread_wrong_bridge_acceptance": "challenge_wrong_relation_acceptance",
    "thread_reasoning_hallucination": "challenge_wrong_relation_acceptance",
}
# Question types and the action that follows; others lead to the next main question.
ACTIONS = {
    "detail_followup": "detail_followup", "hallucination_followup": "hallucination_followup", "review_followup": "review_followup", "multi_hop_reasoning": "multi_hop_question",
    "main": "next_main_question", "macro_main_question": "next_main_question", "thread_premise_question": "thread_question", "thread_evidence_question": "thread_question",
    "thread_bridge_question": "thread_question", "thread_review_question": "thread_question", "thread_question": "thread_question",
}
# The types of main and thread questions, and the states that count as hallucination.
MAIN = ("main", "macro_main_question")
THREAD = ("thread_premise_question", "thread_evidence_question", "thread_bridge_question", "thread_review_question", "thread_question")
BAD_STATES = ("HALLUCINATION", "MISLED", "GLOBAL_OVERCLAIM", "REFUSE_TO_CORRECT")
# Failure modes and challenge types, and the event type of each.
FAILURES = {"false_premise": "challenge_false_premise_acceptance", "overclaim": "challenge_overclaim_acceptance", "wrong_relation": "challenge_wrong_relation_acceptance"}


def turns_of(trajectories: DataFrame, *keys: str) -> DataFrame:
    """(keys, turn_index from 1, turn): one row per turn, in the order of the list."""
    return trajectories.select(*keys, F.posexplode("turns").alias("_at", "turn")).select(*keys, (F.col("_at") + 1).alias("turn_index"), "turn")


def turn_violations(trajectories: DataFrame, *keys: str) -> DataFrame:
    """(keys, violation) of trajectories that are malformed; strict runs raise if there are any."""
    ids = F.transform("turns", lambda t: t["turn_id"])
    blank = F.exists(ids, lambda i: i.isNull() | (F.trim(i) == ""))
    typed = F.exists("turns", lambda t: t["question_type"].isNull() | (F.trim(t["question_type"]) == ""))
    checks = [(F.coalesce(F.size("turns") <= 0, F.lit(True)), "no turns"), (blank, "blank turn_id"), (F.size(F.array_distinct(ids)) < F.size(ids), "repeated turn_id"), (typed, "blank question_type")]
    found = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for c, name in checks]), lambda x: x.isNotNull())
    return trajectories.select(*keys, F.explode(found).alias("violation"))


def _filled(values: Column) -> Column:
    return F.when(F.size(values) > 0, values)


def kc_ids(turn: Column, kind: str) -> Column:
    """The ids of a kind (target, covered, missing) as a set: the first list with ids, of the coverage and then of the older places."""
    field = f"{kind}_kc_ids"
    older = turn["target_kc_ids"] if kind == "target" else turn["judge_result"][field]
    new = turn["judge_result"]["coverage"][field]
    return F.array_distinct(F.coalesce(_filled(new), _filled(older), new, older))


def coverage_complete(turn: Column) -> Column:
    target, covered = kc_ids(turn, "target"), kc_ids(turn, "covered")
    return F.coalesce(turn["judge_result"]["coverage"]["coverage_complete"], (F.size(target) > 0) & (F.size(F.array_except(target, covered)) == 0), F.lit(False))


def events_of(turn: Column) -> Column:
    return F.coalesce(turn["judge_result"]["hallucination_events"], F.expr(f"cast(array() as array<{EVENT}>)"))


def challenge_failed(turn: Column) -> Column:
    by_event = F.exists(events_of(turn), lambda e: F.coalesce(e["hallucination_type"].startswith("challenge_"), F.lit(False)))
    return F.coalesce(turn["judge_result"]["challenge_result"]["failed"], by_event)


def multimodal(turn: Column) -> Column:
    return F.coalesce(turn["requires_multimodal_input"], F.lit(False)) | F.coalesce(F.size(turn["asset_references"]) > 0, F.lit(False))


def modality(turn: Column) -> Column:
    """The kinds of assets of a turn joined by +, or multimodal or text."""
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform(turn["asset_references"], lambda a: a["asset_type"]))), "+")
    return F.coalesce(F.nullif(kinds, F.lit("")), F.when(multimodal(turn), "multimodal").otherwise("text"))


def counts(turns: DataFrame, *keys: str) -> DataFrame:
    """The counters of each trajectory, all in one pass over its turns; turns come from turns_of."""
    t = F.col("turn")
    main, challenge = t["question_type"].isin(*MAIN), t["question_type"] == "challenge_question"
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    both = F.size(F.array_intersect(kc_ids(t, "target"), kc_ids(t, "covered")))
    total = lambda c, v: F.coalesce(F.sum(F.when(c, v)), F.lit(0)).cast("long")
    return turns.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("turns"), n(main).alias("main_turns"), n(main & coverage_complete(t)).alias("main_complete"),
        total(main, F.size(kc_ids(t, "target"))).alias("main_target_kcs"), total(main, both).alias("main_covered_kcs"),
        n(challenge).alias("challenges"), n(challenge & challenge_failed(t)).alias("challenge_failures"),
        n(challenge & ~multimodal(t)).alias("text_challenges"), n(challenge & ~multimodal(t) & challenge_failed(t)).alias("text_challenge_failures"),
        n(challenge & multimodal(t)).alias("multimodal_challenges"), n(challenge & multimodal(t) & challenge_failed(t)).alias("multimodal_challenge_failures"),
        F.sum(F.size(events_of(t))).alias("events"), n(F.size(events_of(t)) > 0).alias("event_turns"), F.coalesce(F.sum(F.char_length(t["model_answer"])), F.lit(0)).alias("answer_chars"),
    )


def _asked(turns: DataFrame, keys: tuple[str, ...], more: dict[str, Column]) -> DataFrame:
    """Follow-ups with the places of the turns that asked the question they name: (keys, root_turn_id, root_question_id, at, more, n_roots, root_at).

    n_roots counts those earlier in the same trajectory, root_at is the first of them. Each turn stands once as a question and once more where it
    is a follow-up, so that one window in place of a join finds them, and turns that lie together by trajectory stay there.
    """
    t = F.col("turn")
    r = t["repair_context"]
    one = lambda id, question, child: F.struct(id.alias("root_turn_id"), question.alias("root_question_id"), F.lit(child).alias("child"))
    both = F.array(one(t["turn_id"], t["question_id"], False), F.when(r["root_turn_id"].isNotNull(), one(r["root_turn_id"], r["root_question_id"], True)))
    rows = turns.select(*keys, F.col("turn_index").alias("at"), *[c.alias(n) for n, c in more.items()], F.explode(F.filter(both, lambda x: x.isNotNull())).alias("x"))
    rows = rows.select(*keys, "at", *more, "x.*")
    earlier = Window.partitionBy(*keys, "root_turn_id", "root_question_id").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    known = F.col("root_question_id").isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    at = F.when(~F.col("child") & known, F.col("at"))
    return rows.withColumns({"n_roots": F.count(at).over(earlier), "root_at": F.min(at).over(earlier)}).filter("child").drop("child")


def repair_tasks(turns: DataFrame, *keys: str, budget: int = 3) -> DataFrame:
    """One row per repaired question: repair_type, root, attempts, succeeded, exhausted, span.

    A follow-up belongs to an earlier turn of the same trajectory that asked the question it names. A detail repair succeeds
    when none of the remaining ids is missing any more, a hallucination repair when its turn holds no event.
    """
    t = F.col("turn")
    r, none = t["repair_context"], F.array().cast("array<string>")
    done = F.when(r["repair_type"] == "detail", F.size(F.array_except(F.coalesce(r["remaining_kc_ids"], none), F.coalesce(kc_ids(t, "covered"), none))) == 0).otherwise(F.size(events_of(t)) == 0)
    rows = _asked(turns, keys, {"repair_type": r["repair_type"], "done": done}).filter("n_roots > 0")
    group = [*keys, "root_turn_id", "root_question_id", "repair_type"]
    won = F.coalesce(F.max("done").over(Window.partitionBy(*group).orderBy("at").rangeBetween(Window.unboundedPreceding, -1)), F.lit(False))
    tried = lambda c: F.when(~F.col("_won"), c)
    first = rows.withColumn("_won", won).groupBy(*group).agg(
        F.sum(tried(F.col("n_roots"))).cast("int").alias("attempts"), F.max(F.coalesce("done", F.lit(False))).alias("succeeded"), (F.sum("n_roots") >= budget).alias("_spent"), (F.max(tried(F.col("at"))) - F.min("root_at") + 1).alias("span"))
    return first.select(*keys, "repair_type", "root_turn_id", "root_question_id", "attempts", "succeeded", (~F.col("succeeded") & F.col("_spent")).alias("exhausted"), "span")


def orphaned_repairs(turns: DataFrame, *keys: str) -> DataFrame:
    """Follow-ups whose root is missing, later, or asked another question; strict runs raise if there are any."""
    return _asked(turns, keys, {}).filter("n_roots = 0").select(*keys, "root_turn_id", "root_question_id", F.col("at").alias("turn_index"))


def metric_pairs(counted: DataFrame, repairs: DataFrame, *keys: str) -> DataFrame:
    """(keys, metric, numerator, denominator, value): the metrics of each trajectory, null where the denominator is zero."""
    of = lambda kind, c: F.coalesce(F.sum(F.when(F.col("repair_type") == kind, c)), F.lit(0)).cast("long")
    fixed = repairs.groupBy(*keys).agg(*[x for kind in ("detail", "hallucination") for x in (of(kind, F.lit(1)).alias(f"{kind}_tasks"), of(kind, F.col("succeeded").cast("int")).alias(f"{kind}_fixed"), of(kind, F.when(F.col("succeeded"), F.col("attempts"))).alias(f"{kind}_rounds"))])
    # the two meet in an aggregate, whose rows stay where their trajectory lies; a join would deal them out by all keys
    names = [c for c in (*counted.columns, *fixed.columns) if c not in keys]
    both = counted.withColumn("_n", F.lit(1)).unionByName(fixed, allowMissingColumns=True)
    known = [F.col(k).isNotNull() for k in keys]
    both = both.filter(reduce(lambda a, b: a & b, known, F.col("_n").isNull()) | F.col("_n").isNotNull())
    rows = both.groupBy(*keys).agg(F.max("_n").alias("_n"), *[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in dict.fromkeys(names)]).filter("_n = 1").drop("_n").withColumn("one", F.lit(1).cast("long"))
    pairs = {
        "one_turn_kc_coverage": ("main_covered_kcs", "main_target_kcs"), "one_turn_macro_complete_rate": ("main_complete", "main_turns"),
        "challenge_failure_rate": ("challenge_failures", "challenges"), "text_challenge_failure_rate": ("text_challenge_failures", "text_challenges"),
        "multimodal_challenge_failure_rate": ("multimodal_challenge_failures", "multimodal_challenges"), "mean_hallucination_events": ("events", "one"),
        "hallucination_turn_rate": ("event_turns", "turns"), "hallucination_event_density": ("events", "turns"),
        "detail_repair_success_rate": ("detail_fixed", "detail_tasks"), "hallucination_repair_success_rate": ("hallucination_fixed", "hallucination_tasks"),
        "detail_repair_avg_rounds": ("detail_rounds", "detail_fixed"), "hallucination_repair_avg_rounds": ("hallucination_rounds", "hallucination_fixed"),
        "mean_total_turns": ("turns", "one"), "mean_answer_chars_per_turn": ("answer_chars", "turns"),
    }
    stacked = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(a).cast("long").alias("numerator"), F.col(b).cast("long").alias("denominator")) for m, (a, b) in pairs.items()]))
    return rows.select(*keys, stacked.alias("x")).select(*keys, "x.*").withColumn("value", ratio("numerator", "denominator"))


def event_rows(turns: DataFrame, *keys: str) -> DataFrame:
    """One row per event with its category and a list of issues: labels missing, ids empty or repeated, sources missing, types unmapped."""
    rows = turns.select(*keys, "turn_index", F.posexplode(events_of(F.col("turn"))).alias("event_at", "e")).select(*keys, "turn_index", "event_at", "e.*")
    found = category(F.col("hallucination_type"), CATEGORIES)
    issues = {
        "missing_label": F.col("hallucination_type").isNull(), "empty_related_ids": F.coalesce(F.size("related_kc_ids") <= 0, F.lit(True)),
        "repeated_related_ids": F.size(F.array_distinct("related_kc_ids")) < F.size("related_kc_ids"), "missing_source_question": F.col("source_question_id").isNull(),
        "unmapped_category": F.col("hallucination_type").isNotNull() & found.isNull(),
    }
    return rows.withColumn("category", found).withColumn("issues", F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in issues.items()]), lambda x: x.isNotNull()))


def category_rows(events: DataFrame, tasks: DataFrame, model: str, keys: tuple[str, ...]) -> DataFrame:
    """Per model the events of completed tasks in each category, zeros kept; events of unknown tasks are an error of the caller."""
    done = events.join(tasks.filter("status = 'completed'").select(*keys), list(keys), "left_semi")
    return category_pivot(done, [model], "hallucination_type", CATEGORIES, tasks)


def family(question_type: Column, state: Column) -> Column:
    """The family of an event, by the question asked and then by the state found."""
    return (
        F.when(question_type == "thread_challenge_question", "thread_reasoning_hallucination").when((question_type == "challenge_question") | (state == "MISLED"), "challenge_failure")
        .when(question_type.isin(*THREAD), "thread_reasoning_hallucination").when(question_type == "review_followup", "review_regression").when(state == "GLOBAL_OVERCLAIM", "fabricated_claim").otherwise("contradicted_kc_claim")
    )


def challenge_event_type(failure_mode: Column, challenge_type: Column) -> Column:
    """The event type of a failed challenge; what fits no known mode is a challenge_failure."""
    found = None
    for mode, kind in FAILURES.items():
        hit = (F.trim(failure_mode) == mode) | (F.trim(challenge_type) == f"{mode}_challenge")
        found = F.when(hit, kind) if found is None else found.when(hit, kind)
    return found.otherwise("challenge_failure")


def action(question_type: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ACTIONS.items() for x in kv]), question_type), F.lit("next_main_question"))


def next_action(state: Column, n_missing: Column, thread_ready: Column, path_ready: Column) -> Column:
    return (
        F.when(state.isin("HALLUCINATION", "MISLED"), "hallucination_followup").when(state == "REFUSE_TO_CORRECT", "end_failed").when(n_missing > 0, "detail_followup")
        .when(thread_ready, "thread_question").when(path_ready, "multi_hop_question").otherwise("next_main_question")
    )


def repaired_state(state: Column, missing: Column) -> Column:
    """INCOMPLETE with nothing missing is progress."""
    return F.when((state == "INCOMPLETE") & (F.coalesce(F.size(missing), F.lit(0)) <= 0), "MAIN_PROGRESS").otherwise(state)


def challenge_outcome(state: Column, missing: Column) -> Column:
    """failed, resisted or incomplete."""
    return F.when(state.isin(*BAD_STATES), "failed").when((state == "INCOMPLETE") | (F.coalesce(F.size(missing), F.lit(0)) > 0), "incomplete").otherwise("resisted")


def final_status(failed: Column, turn_no: Column, most_turns: int) -> Column:
    return F.when(failed, "failed").when(turn_no >= most_turns, "stopped_by_max_turns").otherwise("completed")
