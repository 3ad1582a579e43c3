"""Bounded loops that propose, judge and try again, over written tables: many groups at once, each until its target or its pool's end.

A round takes, of every group, as many open plans in their order as acceptances are still wanting. One plan after another would come
to all of these too, since no fewer plans can bring so many acceptances; so rounds ask for nothing that a plain loop would not, and
come to its result with a round per retry instead of one per question. The driver sees counts alone.

Each round's trials lie in a folder of its number. A loop that was stopped goes on behind its last whole round.

Defined results: plans without a group or an id are left out; of plans of equal id in a group the first in order counts; ties in order go
by id; a verdict that is none of the known ones, or null, is a rejection like any other; an empty pool has no trials.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.storage import discard, written

ACCEPTED, BARRED = "accepted", "barred"


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def standing(trials: DataFrame, keys: Sequence[str], plan: str) -> DataFrame:
    """(keys, plan, n, verdict, feedback): how often each plan was tried, and what came of it last."""
    last = F.max_by(F.struct("verdict", "feedback"), "attempt").alias("_l")
    return trials.groupBy(*keys, plan).agg(F.max("attempt").alias("n"), last).select(*keys, plan, "n", "_l.*")


def next_round(plans: DataFrame, now: DataFrame, keys: Sequence[str], plan: str, order: str, target: int, attempts: int) -> DataFrame:
    """The plans that each group tries next, with attempt and feedback: the first open ones, as many as it still lacks acceptances."""
    have = now.filter(F.col("verdict") == ACCEPTED).groupBy(*keys).agg(F.count(F.lit(1)).alias("_have"))
    shut = now.filter(F.col("verdict").isin(ACCEPTED, BARRED) | (F.col("n") >= attempts)).select(*keys, plan)
    left = plans.join(shut, [*keys, plan], "left_anti")
    first = left.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(order, plan))).filter(F.col("_at") <= target)  # Spark keeps so many per group and task
    wanting = first.join(have, list(keys), "left").filter(F.col("_at") <= F.lit(target) - F.coalesce("_have", F.lit(0)))
    known = now.select(*keys, plan, "n", "feedback")
    return wanting.join(known, [*keys, plan], "left").withColumn("attempt", (F.coalesce("n", F.lit(0)) + 1).cast("int")).drop("_at", "_have", "n")


def run(plans: DataFrame, keys: Sequence[str], plan: str, order: str, judge: Callable[[DataFrame], DataFrame], store: str, target: int, attempts: int = 3) -> DataFrame:
    """(keys, plan, order, attempt, verdict, feedback, question_no) of all trials; question_no: their order in a plain loop, from 1.

    judge: given plans with attempt and feedback (of the attempt before, null at the first), adds verdict, and the feedback that the next
    attempt is to heed. `accepted` and `barred` end a plan, anything else lets it try again, up to `attempts` times.
    """
    spark = plans.sparkSession
    once = F.row_number().over(Window.partitionBy(*keys, plan).orderBy(order))
    known = [F.col(k).isNotNull() for k in (*keys, plan)]
    pool = plans
    for c in known:
        pool = pool.filter(c)
    pool = written(pool.withColumn("_once", once).filter("_once = 1").drop("_once"), "loop-pool")
    columns = [*keys, plan, order, "attempt", "verdict", "feedback"]
    schema = ", ".join(f"{c} {pool.schema[c].dataType.simpleString()}" for c in (*keys, plan, order)) + ", attempt int, verdict string, feedback string"
    at, number = f"{store}/trials", 0
    while _exists(spark, f"{at}/round={number}/_SUCCESS"):
        number += 1
    rounds = lambda: spark.read.schema(schema).parquet(*[f"{at}/round={i}" for i in range(number)]) if number else spark.createDataFrame([], schema)
    now = written(standing(rounds(), keys, plan), "loop-standing")
    while True:
        asked = next_round(pool, now, keys, plan, order, target, attempts)
        judged = judge(asked).withColumn("verdict", F.coalesce("verdict", F.lit("rejected")))
        judged.select(*columns).write.mode("overwrite").parquet(f"{at}/round={number}")
        number += 1
        fresh = spark.read.schema(schema).parquet(f"{at}/round={number - 1}")
        if fresh.isEmpty():
            break
        touched = fresh.select(*keys, plan, F.col("attempt").alias("n"), "verdict", "feedback")
        after = written(now.join(touched.select(*keys, plan), [*keys, plan], "left_anti").unionByName(touched), "loop-standing")
        discard(now)
        now = after
    discard(pool, now)
    asked_at = F.row_number().over(Window.partitionBy(*keys).orderBy(order, plan, "attempt"))
    return rounds().withColumn("question_no", asked_at)


def outcomes(trials: DataFrame, keys: Sequence[str], pool: DataFrame, target: int, attempts: int = 3) -> DataFrame:
    """(keys, n_plans, n_tried, n_accepted, n_barred, n_exhausted, n_questions, stop): why each group stopped: target_reached or pool_exhausted."""
    plan = [c for c in trials.columns if c not in (*keys, "attempt", "verdict", "feedback", "question_no")][0]
    now = standing(trials, keys, plan)
    count = lambda c: F.count_if(c)
    ended = now.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_tried"), count(F.col("verdict") == ACCEPTED).alias("n_accepted"), count(F.col("verdict") == BARRED).alias("n_barred"),
        count(~F.col("verdict").isin(ACCEPTED, BARRED) & (F.col("n") >= attempts)).alias("n_exhausted"), F.sum("n").alias("n_questions"))
    sizes = pool.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_plans"))
    out = sizes.join(ended, list(keys), "left").fillna(0, ["n_tried", "n_accepted", "n_barred", "n_exhausted", "n_questions"])
    return out.withColumn("stop", F.when(F.col("n_accepted") >= target, "target_reached").otherwise("pool_exhausted"))


def by_model(model_answer: Column) -> tuple[Column, Column]:
    """(verdict, feedback) in a judge's JSON answer: usable, matched and too_easy as the judge says them."""
    said = F.from_json(model_answer, "usable boolean, matched boolean, too_easy boolean, reason string")
    verdict = F.when(~F.coalesce(said["usable"], F.lit(False)), "unusable").when(said["matched"], ACCEPTED).when(said["too_easy"], BARRED).otherwise("too easy")
    return verdict, F.concat_ws(" ", F.concat(verdict, F.lit(":")), said["reason"])
