"""Replay of judged turns into states of knowledge components, macros and repair tasks.

The state after a dialogue follows from few of its rows, so a replay is windows and aggregates; the same rules as a fold,
one row after the other, serve streams (quarry.streaming.replay), and tests hold the two against each other.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.dialogue import BAD_STATES


def marks(turns: DataFrame, keys: Sequence[str], order: str, state: Column, covered: Column, missing: Column) -> DataFrame:
    """(keys, order, kc_id, mark): what each turn says of each component: bad, covered or missing, in that precedence."""
    bad = F.coalesce(state.isin(*BAD_STATES), F.lit(False))
    none = F.array().cast("array<string>")
    c, m = F.coalesce(covered, none), F.coalesce(missing, none)
    said = F.transform(F.array_union(c, m), lambda k: F.struct(k.alias("kc_id"), F.when(bad, "bad").when(F.array_contains(c, k), "covered").otherwise("missing").alias("mark")))
    return turns.select(*keys, order, F.explode(said).alias("s")).select(*keys, order, "s.*")


def states(marked: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """(keys, kc_id, status, n_bad, n_corrected): the final state of each component that a turn spoke of.

    A bad turn leaves it hallucinated; a covering one after that, corrected; any other covering one, lit; and one that only
    misses it changes nothing but an untouched component, which is missing then.
    """
    kc = [*keys, "kc_id"]
    decisive = F.when(F.col("mark") != "missing", F.col("mark"))
    before = F.last(decisive, ignorenulls=True).over(Window.partitionBy(*kc).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    rows = marked.withColumns({"_mark": decisive, "_before": before})
    fixes = (F.col("_mark") == "covered") & (F.col("_before") == "bad")
    status = F.when(F.col("_mark") == "bad", "hallucinated").when(fixes, "corrected").otherwise("lit")
    place = F.when(F.col("_mark").isNotNull(), F.struct(*[F.col(c) if isinstance(c, str) else c for c in order]))  # null places are left out
    return rows.groupBy(*kc).agg(F.coalesce(F.max_by(status, place), F.lit("missing")).alias("status"), F.count_if(F.col("_mark") == "bad").alias("n_bad"), F.count_if(fixes).alias("n_corrected"))


def with_all(found: DataFrame, components: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All components of a dialogue's graph, those never spoken of unlit.

    The two meet in an aggregate, whose rows stay where their dialogue lies; a join would deal both out again by all keys.
    """
    kc = [*keys, "kc_id"]
    rest = [c for c in found.columns if c not in kc]
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in kc])  # null keys match nothing
    both = components.select(*kc, F.lit(1).alias("_n")).unionByName(found.filter(known), allowMissingColumns=True)
    rows = both.groupBy(*kc).agg(F.count("_n").cast("int").alias("_n"), *[F.first(c, ignorenulls=True).alias(c) for c in rest]).filter("_n > 0")
    return rows.select(*kc, *rest, F.explode(F.array_repeat(F.lit(0), F.col("_n"))).alias("_r")).drop("_r").fillna({"status": "unlit", "n_bad": 0, "n_corrected": 0})


def macros(marked: DataFrame, targets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, macro_id, n_targets, n_covered, completed): a macro is complete when all its targets were covered. targets: keys, macro_id, kc_id."""
    covered = marked.filter("mark = 'covered'").select(*keys, "kc_id").distinct().withColumn("_c", F.lit(1))
    rows = targets.join(covered, [*keys, "kc_id"], "left").groupBy(*keys, "macro_id").agg(F.count(F.lit(1)).alias("n_targets"), F.count("_c").alias("n_covered"))
    return rows.withColumn("completed", F.col("n_targets") == F.col("n_covered"))


def recorded(events: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Events once each: of repeated ids in a task the first counts."""
    place = F.struct(*order)
    rest = [c for c in events.columns if c not in (*keys, "event_id")]
    return events.groupBy(*keys, "event_id").agg(F.min_by(F.struct(*rest), place).alias("_e")).select(*keys, "event_id", "_e.*")


def coverage_gaps(turns: DataFrame, keys: Sequence[str], turn_id: str, missing: Column) -> DataFrame:
    """One gap for each turn that leaves components missing."""
    return turns.filter(F.size(missing) > 0).select(*keys, F.col(turn_id).alias("turn_id"), missing.alias("missing_kc_ids"), F.lit("open").alias("status"))


def repair_tasks(turns: DataFrame, keys: Sequence[str], order: str, turn_id: str, n_events: Column, missing: Column, detail_budget: int = 3, event_budget: int = 3) -> DataFrame:
    """Tasks that judged turns call for: hallucination before detail, with budgets; each id once."""
    tasks = F.array(
        F.when(n_events > 0, F.struct(F.lit("hallucination").alias("task_type"), F.lit(1).alias("priority"), F.lit(event_budget).alias("budget"))),
        F.when(F.size(missing) > 0, F.struct(F.lit("detail").alias("task_type"), F.lit(2).alias("priority"), F.lit(detail_budget).alias("budget"))),
    )
    rows = turns.select(*keys, F.col(order).alias("created_at"), F.col(turn_id).alias("turn_id"), F.explode(F.filter(tasks, lambda t: t.isNotNull())).alias("t")).select(*keys, "created_at", "turn_id", "t.*")
    return rows.withColumn("task_id", F.concat_ws("_", F.upper("task_type"), "turn_id")).dropDuplicates([*keys, "task_id"])


def next_pending(tasks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of each dialogue the pending task to do next: by priority, then age, then id."""
    place = F.struct("priority", "created_at", "task_id")
    rest = [c for c in tasks.columns if c not in keys]
    return tasks.filter("status = 'pending'").groupBy(*keys).agg(F.min_by(F.struct(*rest), place).alias("_t")).select(*keys, "_t.*")


def settled(attempts: Column, budget: Column, resolved: Column) -> Column:
    """What becomes of a task after a follow-up."""
    return F.when(resolved, "completed").when(attempts >= budget, "exhausted").otherwise("pending")


def thread_steps(steps: DataFrame, lit: DataFrame, keys: Sequence[str]) -> DataFrame:
    """steps with ready: whether all components that a step requires are lit or corrected. steps: keys, thread_id, step_id, required; lit: keys, kc_id, status."""
    good = lit.filter(F.col("status").isin("lit", "corrected")).groupBy(*keys).agg(F.collect_set("kc_id").alias("_lit"))  # the components of one graph
    return steps.join(good, list(keys), "left").withColumn("ready", F.coalesce(F.size(F.array_except("required", "_lit")) == 0, F.size("required") == 0)).drop("_lit")


def accepted_loop(trials: DataFrame, plan: str, order: str, accepted: Column, attempts: int = 3) -> DataFrame:
    """(plan, n_attempts, outcome) of recorded trials: accepted at the first that is, exhausted after `attempts` without, else open. Later trials do not count."""
    at = F.row_number().over(Window.partitionBy(plan).orderBy(order))
    rows = trials.withColumn("_at", at).withColumn("_ok", accepted)
    per = rows.groupBy(plan).agg(F.min(F.when(F.col("_ok") & (F.col("_at") <= attempts), F.col("_at"))).alias("_hit"), F.max("_at").alias("_n"))
    return per.select(plan, F.coalesce("_hit", F.least("_n", F.lit(attempts))).alias("n_attempts"), F.when(F.col("_hit").isNotNull(), "accepted").when(F.col("_n") >= attempts, "exhausted").otherwise("open").alias("outcome"))
