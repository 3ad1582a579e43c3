"""Judge results in one normal form: coverage, events, outcomes of challenges and threads, from records of any age.

All are expressions over a turn as dialogue.TURN has it, so a table of turns is normalised in one projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import safe_id
from quarry.operators.dialogue import BAD_STATES, EVENT, THREAD, challenge_event_type, events_of, family, kc_ids, repaired_state

VERSION = "v2.step3"
NONE = "cast(array() as array<string>)"


def coverage(turn: Column) -> Column:
    """Target, covered and missing ids, each once in their order, and whether nothing is missing."""
    none = F.expr(NONE)
    target, covered, missing = (F.coalesce(kc_ids(turn, k), none) for k in ("target", "covered", "missing"))
    complete = F.coalesce(turn["judge_result"]["coverage"]["coverage_complete"], F.size(missing) == 0)
    return F.struct(target.alias("target_kc_ids"), covered.alias("covered_kc_ids"), missing.alias("missing_kc_ids"), complete.alias("coverage_complete"), F.coalesce(turn["judge_result"]["confidence"], F.lit(0.0)).alias("confidence"))


def _type(turn: Column, state: Column) -> Column:
    kind = turn["question_type"]
    mode, challenge = F.coalesce(turn["target_failure_mode"], F.lit("")), F.coalesce(turn["challenge_type"], F.lit(""))
    return F.when((kind == "challenge_question") | F.coalesce(state == "MISLED", F.lit(False)), challenge_event_type(mode, challenge)).otherwise(family(kind, state))


def _related(turn: Column) -> Column:
    none = F.expr(NONE)
    return F.array_distinct(F.concat(F.coalesce(kc_ids(turn, "covered"), none), F.coalesce(kc_ids(turn, "missing"), none)))


def _event(turn: Column, state: Column, number: Column, related: Column) -> list[Column]:
    return [
        F.concat(F.lit("H_"), safe_id(turn["turn_id"]), F.lit("_"), number.cast("string")).alias("event_id"), _type(turn, state).alias("hallucination_type"), family(turn["question_type"], state).alias("hallucination_family"),
        related.alias("related_kc_ids"), F.lit("unresolved").alias("status"), turn["question_id"].alias("source_question_id"), F.expr(NONE).alias("followup_turns"),
    ]


def events(turn: Column) -> Column:
    """The events of a turn, ids and defaults filled in; a bad state without any is an event of its own, unless an open hallucination is being repaired."""
    state, given = turn["judge_result"]["state"], events_of(turn)
    filled = F.transform(
        given,
        lambda e, i: F.struct(
            F.coalesce(e["event_id"], F.concat(F.lit("H_"), safe_id(turn["turn_id"]), F.lit("_"), (i + 1).cast("string"))).alias("event_id"), _type(turn, state).alias("hallucination_type"), family(turn["question_type"], state).alias("hallucination_family"),
            F.array_distinct(F.when(F.size(e["related_kc_ids"]) > 0, e["related_kc_ids"]).otherwise(_related(turn))).alias("related_kc_ids"), F.coalesce(e["status"], F.lit("unresolved")).alias("status"),
            F.coalesce(e["source_question_id"], turn["question_id"]).alias("source_question_id"), F.coalesce(e["followup_turns"], F.expr(NONE)).alias("followup_turns"),
        ),
    )
    own = F.array(F.struct(*_event(turn, state, F.lit(1), _related(turn)))).cast(f"array<{EVENT}>")
    repairing = F.coalesce(turn["repair_context"]["repair_type"] == "hallucination", F.lit(False))
    return F.when((F.size(given) == 0) & F.coalesce(state.isin(*BAD_STATES), F.lit(False)) & ~repairing, own).otherwise(filled.cast(f"array<{EVENT}>"))


def challenge_result(turn: Column) -> Column:
    """What a challenge came to; null for other questions."""
    state = turn["judge_result"]["state"]
    found = F.struct(state.alias("state"), (state == "CHALLENGE_RESISTED").alias("resisted"), state.isin(*BAD_STATES).alias("failed"), (state == "INCOMPLETE").alias("incomplete"))
    return F.when(turn["question_type"].isin("challenge_question", "thread_challenge_question"), found)


def thread_result(turn: Column) -> Column:
    """What a step of a thread came to; null for other questions."""
    failed, missing = F.coalesce(turn["judge_result"]["state"].isin(*BAD_STATES), F.lit(False)), F.coalesce(F.size(kc_ids(turn, "missing")) > 0, F.lit(False))
    found = F.struct((~failed & ~missing).alias("success"), (~failed & missing).alias("partial"), failed.alias("failed"))
    return F.when(turn["question_type"].isin(*THREAD, "thread_challenge_question"), found)


def normalized(turns: DataFrame) -> DataFrame:
    """turns with state, coverage, events, challenge_result, thread_result and normalization_version."""
    t = F.col("turn")
    return turns.withColumns({
        "state": repaired_state(t["judge_result"]["state"], kc_ids(t, "missing")), "coverage": coverage(t), "events": events(t), "challenge_result": challenge_result(t), "thread_result": thread_result(t),
        "normalization_version": F.lit(VERSION),
    })
