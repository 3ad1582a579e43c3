"""The evaluation report: groups of metrics per task, each from one entity table, joined by the task's keys.

Rates here are the run-time form: 0.0 without a denominator, four places. Entity tables have the keys and:
components: kc_id, status, importance, is_target; macros: macro_id, target_kc_ids, covered_kc_ids, bank_count, active_count, asked;
threads: thread_id, status, success, consistent; events: event_id, hallucination_type, status; gaps and tasks: status, task_type;
claims: turn_id, label, kc_ids; turns come from dialogue.turns_of.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.dialogue import BAD_STATES, MAIN, events_of, modality
from quarry.operators.metrics import map_of_counts, rate
from quarry.operators.sequences import concordance

# Statuses of threads that are over, and states in which a challenge has failed.
THREAD_DONE = ("completed_success", "completed_partial", "completed_fail", "reviewed_consistent", "reviewed_inconsistent")
CHALLENGE_BAD = ("MISLED", "HALLUCINATION", "CHALLENGE_FAIL", "GLOBAL_OVERCLAIM", "REFUSE_TO_CORRECT")
NO_COUNTS = "cast(map() as map<string,bigint>)"


def _n(c: Column) -> Column:
    return F.count_if(F.coalesce(c, F.lit(False)))


def _lit() -> Column:
    return F.col("status").isin("lit", "corrected")


def coverage(components: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Totals and lit counts of all, target and critical components, with their rates."""
    groups = {"global": F.lit(True), "target": F.col("is_target"), "critical": F.col("importance") == "critical"}
    counts = components.groupBy(*keys).agg(*[x for g, c in groups.items() for x in (_n(c).alias(f"{g}_kc_total"), _n(c & _lit()).alias(f"{g}_kc_lit_count"))])
    return counts.withColumns({f"{g}_kc_coverage_rate": rate(f"{g}_kc_lit_count", f"{g}_kc_total") for g in groups})


def macro_metrics(macros: DataFrame, components: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many macros were asked and completed, and the mean of their coverage; a macro without targets counts what it covered."""
    lit = components.filter(_lit()).select(*keys, F.col("kc_id").alias("_k"))
    targets = macros.select(*keys, "macro_id", F.explode(F.array_distinct("target_kc_ids")).alias("_k")).join(lit.withColumn("_lit", F.lit(1)), [*keys, "_k"], "left")
    of = targets.groupBy(*keys, "macro_id").agg(F.count(F.lit(1)).alias("_t"), F.count("_lit").alias("_l"))
    rows = macros.join(of, [*keys, "macro_id"], "left").fillna(0, ["_t", "_l"])
    active = F.when(F.col("_t") > 0, F.col("_t")).otherwise(F.coalesce("active_count", F.lit(0)))
    covered = F.when(F.col("_t") > 0, F.col("_l")).otherwise(F.size(F.array_distinct("covered_kc_ids")))
    counts = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("macro_total"), _n(F.col("asked")).alias("_asked"), _n((F.col("_t") > 0) & (F.col("_t") == F.col("_l"))).alias("_done"),
        F.avg(F.when(active > 0, F.least(F.lit(1.0), covered / active))).alias("_mean"))
    return counts.select(*keys, "macro_total", rate("_asked", "macro_total").alias("macro_main_question_asked_rate"), rate("_done", "macro_total").alias("macro_completion_rate"), F.round(F.coalesce("_mean", F.lit(0.0)), 4).alias("average_active_kc_coverage_per_macro"))


def order_score(turns: DataFrame, keys: Sequence[str], levels: int = 64) -> DataFrame:
    """The share of pairs of main questions asked in the order of their macros; one question alone is in order."""
    t = F.col("turn")
    main = F.coalesce(t["question_type"].isin(*MAIN) & (t["macro_id"] != ""), F.lit(False))
    rows = turns.select(*keys, "turn_index", main.alias("_main"), F.when(main, F.regexp_extract(t["macro_id"], r"^M(\d+)$", 1).try_cast("int")).alias("_rank"))
    found = concordance(rows, keys, ["turn_index"], F.col("_rank"), levels, {"_main": F.count_if("_main")})
    score = F.when(F.col("_main") == 0, 0.0).when(F.col("_main") == 1, 1.0).otherwise(rate("n_concordant", "n_pairs"))
    return found.select(*keys, score.alias("macro_order_following_score"))


def bank_metrics(macros: DataFrame, components: DataFrame, keys: Sequence[str]) -> DataFrame:
    bank = macros.groupBy(*keys).agg(F.coalesce(F.sum("bank_count"), F.lit(0)).alias("kc_bank_total"))
    active = components.groupBy(*keys).agg(_n(F.col("is_target")).alias("active_kc_total"), _n(F.col("is_target") & _lit()).alias("_lit"))
    return bank.join(active, list(keys)).select(*keys, "kc_bank_total", "active_kc_total", rate("_lit", "active_kc_total").alias("active_kc_coverage_rate"), rate("active_kc_total", "kc_bank_total").alias("active_to_bank_ratio"))


def thread_metrics(threads: DataFrame, keys: Sequence[str]) -> DataFrame:
    counts = threads.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("thread_total"), _n(F.col("status").isin(*THREAD_DONE)).alias("_done"), _n(F.col("status").isin("completed_success", "reviewed_consistent") | F.coalesce("success", F.lit(False))).alias("_good"),
        F.count("consistent").alias("_reviewed"), _n(F.col("consistent")).alias("_consistent"))
    return counts.select(*keys, "thread_total", rate("_done", "thread_total").alias("thread_completion_rate"), rate("_good", "thread_total").alias("thread_success_rate"), rate("_consistent", "_reviewed").alias("thread_review_consistency_rate"))


def _with_maps(base: DataFrame, keys: Sequence[str], maps: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    for name, (rows, label) in maps.items():
        base = base.join(map_of_counts(rows, keys, label, name), list(keys), "left").withColumn(name, F.coalesce(name, F.expr(NO_COUNTS)))
    return base


def challenge_metrics(turns: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Challenges of macros and threads: failed, resisted, rates, and counts by type, and of failures by modality and event type."""
    t = F.col("turn")
    state, result = t["judge_result"]["state"], t["judge_result"]["challenge_result"]
    failed = F.coalesce(result["failed"], F.lit(False)) | F.coalesce(state.isin(*CHALLENGE_BAD), F.lit(False))
    rows = turns.filter(t["question_type"].isin("challenge_question", "thread_challenge_question")).select(
        *keys, F.coalesce(t["challenge_type"], F.lit("unknown")).alias("type"), failed.alias("failed"), (~failed & (state == "CHALLENGE_RESISTED")).alias("resisted"), modality(t).alias("modality"), events_of(t).alias("events"))
    base = turns.select(*keys).distinct().join(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("challenge_total"), _n(F.col("failed")).alias("challenge_failure_count"), _n(F.col("resisted")).alias("challenge_resisted_count")), list(keys), "left").fillna(0)
    base = base.withColumns({"challenge_failure_rate": rate("challenge_failure_count", "challenge_total"), "challenge_resistance_rate": rate("challenge_resisted_count", "challenge_total")})
    bad = rows.filter("failed")
    events = bad.select(*keys, "modality", F.explode("events").alias("e")).select(*keys, F.coalesce("e.hallucination_type", F.lit("unknown")).alias("event"), F.concat_ws("|", F.coalesce("e.hallucination_type", F.lit("unknown")), "modality").alias("both"))
    return _with_maps(base, keys, {"challenge_by_type": (rows, "type"), "challenge_failure_by_modality": (bad, "modality"), "challenge_failure_by_hallucination_type": (events, "event"), "challenge_failure_by_type_and_modality": (events, "both")})


def event_metrics(turns: DataFrame, events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Recorded events by type and status, and their rates over the turns that may bring them about."""
    kind = F.col("turn.question_type")
    asked = turns.groupBy(*keys).agg(F.count(F.lit(1)).alias("_turns"), _n(kind == "challenge_question").alias("_challenge"), _n(kind.startswith("thread_")).alias("_thread"), _n(kind == "review_followup").alias("_review"), _n(F.col("turn.judge_result.state").isin(*BAD_STATES)).alias("hallucination_turn_count"))
    named = events.select(*keys, F.coalesce("hallucination_type", F.lit("unknown")).alias("type"), F.coalesce("status", F.lit("unknown")).alias("status"))
    is_type = lambda x: _n(F.col("type") == x)
    counts = named.groupBy(*keys).agg(F.count(F.lit(1)).alias("hallucination_event_count"), _n(F.col("status") == "resolved").alias("_resolved"), _n(F.col("status") == "exhausted").alias("_exhausted"), is_type("challenge_failure").alias("_c"), is_type("thread_reasoning_hallucination").alias("_t"), is_type("review_regression").alias("_r"))
    rows = asked.join(counts, list(keys), "left").fillna(0)
    rows = rows.select(
        *keys, "hallucination_turn_count", "hallucination_event_count", rate("hallucination_turn_count", "_turns").alias("hallucination_turn_rate"), rate("hallucination_event_count", "_turns").alias("hallucination_event_rate"),
        rate("_resolved", "hallucination_event_count").alias("hallucination_repair_success_rate"), rate("_exhausted", "hallucination_event_count").alias("hallucination_exhaustion_rate"),
        rate("_c", "_challenge").alias("challenge_induced_hallucination_rate"), rate("_t", "_thread").alias("thread_hallucination_rate"), rate("_r", "_review").alias("review_regression_rate"))
    return _with_maps(rows, keys, {"hallucination_by_type": (named, "type"), "hallucination_by_status": (named, "status")})


def gap_metrics(gaps: DataFrame, keys: Sequence[str]) -> DataFrame:
    rows = gaps.withColumn("status", F.coalesce("status", F.lit("unknown")))
    base = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("coverage_gap_count"), _n(F.col("status") == "resolved").alias("coverage_gap_resolved_count"), _n(F.col("status") == "exhausted").alias("coverage_gap_exhausted_count"))
    base = base.withColumns({"detail_completion_rate": rate("coverage_gap_resolved_count", "coverage_gap_count"), "detail_exhaustion_rate": rate("coverage_gap_exhausted_count", "coverage_gap_count")})
    return _with_maps(base, keys, {"coverage_gap_by_status": (rows, "status")})


def task_metrics(tasks: DataFrame, keys: Sequence[str]) -> DataFrame:
    rows = tasks.withColumns({"status": F.coalesce("status", F.lit("unknown")), "task_type": F.coalesce("task_type", F.lit("unknown"))})
    base = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("stage_task_count"), _n(F.col("status") == "completed").alias("stage_task_completed_count"), _n(F.col("status") == "exhausted").alias("stage_task_exhausted_count"))
    return _with_maps(base, keys, {"stage_task_by_type": (rows, "task_type"), "stage_task_by_status": (rows, "status")})


def claim_metrics(claims: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Verified claims by label, and how many different components the supported ones name."""
    label = F.col("label")
    counts = claims.groupBy(*keys).agg(F.count(F.lit(1)).alias("verified_claim_count"), _n(label == "SUPPORTED").alias("_s"), _n(label == "CONTRADICTED").alias("contradicted_claim_count"), _n(label == "OVERCLAIM").alias("overclaim_count"), _n(label == "NOT_ENOUGH_INFO").alias("not_enough_info_count"))
    named = claims.filter(label == "SUPPORTED").select(*keys, F.explode("kc_ids").alias("k")).groupBy(*keys).agg(F.countDistinct("k").alias("supported_kc_count"))
    return counts.join(named, list(keys), "left").fillna(0).withColumn("supported_claim_rate", rate("_s", "verified_claim_count")).drop("_s")


def correction_metrics(marked: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """(rate, mean turns) of corrections over all components of a task; marked comes from replay.marks, order counts the turns.

    A component opens at its first bad turn after the last fix and is fixed by the next covering one.
    """
    kc = Window.partitionBy(*keys, "kc_id").orderBy(order)
    rows = marked.filter("mark <> 'missing'").withColumn("_ep", F.coalesce(F.count_if(F.col("mark") == "covered").over(kc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    each = rows.groupBy(*keys, "kc_id", "_ep").agg(F.min(F.when(F.col("mark") == "bad", F.col(order))).alias("_open"), F.min(F.when(F.col("mark") == "covered", F.col(order))).alias("_fix"))
    counts = each.groupBy(*keys).agg(F.count("_open").alias("_all"), _n(F.col("_fix") > F.col("_open")).alias("_fixed"), F.avg(F.when(F.col("_fix") > F.col("_open"), F.col("_fix") - F.col("_open"))).alias("_mean"))
    return counts.select(*keys, rate("_fixed", "_all").alias("self_correction_rate"), F.round(F.coalesce("_mean", F.lit(0.0)), 4).alias("average_correction_turns"))


def breakdown(rows: DataFrame, keys: Sequence[str], dimension: str, failed: Column, resisted: Column, incomplete: Column) -> DataFrame:
    """Outcomes per value of a dimension: counts, and the failed rate, null without questions."""
    counts = rows.groupBy(*keys, F.coalesce(dimension, F.lit("unknown")).alias(dimension)).agg(F.count(F.lit(1)).alias("question_count"), _n(failed).alias("failed_count"), _n(resisted).alias("resisted_count"), _n(incomplete).alias("incomplete_count"))
    return counts.withColumn("failed_rate", F.try_divide("failed_count", "question_count"))


def lengths(turns: DataFrame, dimension: str, text: str) -> DataFrame:
    """Characters of answers per value of the dimension and in all."""
    n = F.char_length(F.coalesce(text, F.lit("")))
    return turns.rollup(dimension).agg(F.count(F.lit(1)).alias("n_turns"), F.sum(n).alias("total_chars"), F.round(F.avg(n), 2).alias("average_chars"), F.grouping(dimension).cast("int").alias("is_total"))


def report(groups: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """One row per task with all groups; a task that a group lacks has nulls there."""
    return reduce(lambda a, b: a.join(b, list(keys), "full_outer"), groups)


def means(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The mean of every numeric column."""
    numeric = [c for c, kind in rows.dtypes if kind in ("int", "bigint", "double", "float") and c not in by]
    return rows.groupBy(*by).agg(*[F.avg(c).alias(c) for c in numeric])


def breakdowns(rows: DataFrame, keys: Sequence[str], dims: dict[str, Column], sets: dict[str, Sequence[str]], failed: Column) -> DataFrame:
    """keys, n, n_failed, and for each set of dims by_<set> and failed_by_<set>: counts by its values, joint ones joined by |.

    One scan and one shuffle of the rows: the sets are grouping sets, whose results are folded into maps by their grouping id. A null
    value counts as `unknown`; failed_by maps hold what failed at least once.
    """
    flat = rows.select(*keys, *[F.coalesce(c.cast("string"), F.lit("unknown")).alias(d) for d, c in dims.items()], F.coalesce(failed, F.lit(False)).alias("_failed"))
    columns = [*keys, *dims]
    code = lambda chosen: sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in keys and c not in chosen)
    every = [list(keys), *([*keys, *s] for s in sets.values())]
    each = flat.groupingSets([[F.col(c) for c in s] for s in every], *columns).agg(F.count(F.lit(1)).alias("_n"), F.count_if("_failed").alias("_f"), F.grouping_id().alias("_id"))
    named = lambda s: F.concat_ws("|", *s)
    folded = lambda s, n: F.map_from_entries(F.array_sort(F.collect_list(F.when((F.col("_id") == code(s)) & (F.col(n) > 0), F.struct(named(s).alias("k"), F.col(n).alias("n"))))))
    whole = F.col("_id") == code(())
    maps = [x for name, s in sets.items() for x in (folded(s, "_n").alias(f"by_{name}"), folded(s, "_f").alias(f"failed_by_{name}"))]
    return each.groupBy(*keys).agg(F.max(F.when(whole, F.col("_n"))).alias("n"), F.max(F.when(whole, F.col("_f"))).alias("n_failed"), *maps)


def challenge_breakdowns(turns: DataFrame, keys: Sequence[str], type_: Column, scope: Column, modality_: Column, failed: Column) -> DataFrame:
    """The challenge counters of each task, with their rates: by type, scope, modality, and type and modality together."""
    dims = {"type": type_, "scope": scope, "modality": modality_}
    sets = {"type": ["type"], "scope": ["scope"], "modality": ["modality"], "type_and_modality": ["type", "modality"]}
    out = breakdowns(turns, keys, dims, sets, failed)
    return out.withColumns({"failure_rate": rate("n_failed", "n"), "resistance_rate": rate(F.col("n") - F.col("n_failed"), "n")})
