"""Queries for states of dialogues."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import replay as R
from quarry.storage import shared_dir
from quarry.streaming import artifacts, keyed

SQL: dict[str, str] = {}


def _marked(spark: SparkSession, d: str) -> DataFrame:
    k = (F.get_json_object("props", "$.k").cast("long") % 10).cast("string")
    mark = F.when(F.col("event_type") == "error", "bad").when(F.col("event_type") == "purchase", "covered").when(F.col("event_type") == "view", "missing")
    return spark.read.parquet(f"{d}/events.parquet").select("user_id", "ts", "event_id", k.alias("kc_id"), mark.alias("mark")).filter("mark is not null")


def state_replay(spark: SparkSession, d: str) -> DataFrame:
    return R.states(_marked(spark, d), ["user_id"], ["ts", "event_id"])


SQL["state_replay"] = """
WITH m AS (
    SELECT user_id, ts, event_id, CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS VARCHAR) AS kc_id,
        CASE event_type WHEN 'error' THEN 'bad' WHEN 'purchase' THEN 'covered' WHEN 'view' THEN 'missing' END AS mark
    FROM events WHERE event_type IN ('error', 'purchase', 'view')
), d AS (SELECT *, lag(mark) OVER w AS before, row_number() OVER (PARTITION BY user_id, kc_id ORDER BY ts DESC, event_id DESC) AS back FROM m WHERE mark <> 'missing' WINDOW w AS (PARTITION BY user_id, kc_id ORDER BY ts, event_id)),
e AS (
    SELECT user_id, kc_id, max(CASE WHEN back = 1 THEN CASE WHEN mark = 'bad' THEN 'hallucinated' WHEN before = 'bad' THEN 'corrected' ELSE 'lit' END END) AS status,
        count(*) FILTER (WHERE mark = 'bad') AS n_bad, count(*) FILTER (WHERE mark = 'covered' AND before = 'bad') AS n_corrected
    FROM d GROUP BY user_id, kc_id
)
SELECT a.user_id, a.kc_id, coalesce(status, 'missing') AS status, coalesce(n_bad, 0) AS n_bad, coalesce(n_corrected, 0) AS n_corrected
FROM (SELECT DISTINCT user_id, kc_id FROM m) a LEFT JOIN e ON a.user_id = e.user_id AND a.kc_id = e.kc_id
"""


def macro_completion(spark: SparkSession, d: str) -> DataFrame:
    marked = _marked(spark, d)
    targets = marked.select("user_id", "kc_id").distinct().withColumn("macro_id", F.concat(F.lit("M"), (F.col("kc_id").cast("int") % 3).cast("string")))
    return R.macros(marked, targets, ["user_id"])


SQL["macro_completion"] = """
WITH m AS (
    SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS kc_id, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS covered
    FROM events WHERE event_type IN ('error', 'purchase', 'view') GROUP BY 1, 2
)
SELECT user_id, 'M' || CAST(kc_id % 3 AS VARCHAR) AS macro_id, count(*) AS n_targets, CAST(sum(covered) AS BIGINT) AS n_covered, count(*) = sum(covered) AS completed FROM m GROUP BY 1, 2
"""


def repair_queue(spark: SparkSession, d: str) -> DataFrame:
    """The task each user should do next, had each error asked for a repair and each view for a detail."""
    rows = spark.read.parquet(f"{d}/events.parquet").select("user_id", "event_id", F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("turn_id"), (F.col("event_type") == "error").cast("int").alias("n"), F.when(F.col("event_type") == "view", F.array(F.lit("k"))).otherwise(F.array().cast("array<string>")).alias("missing"))
    tasks = R.repair_tasks(rows, ["user_id"], "event_id", "turn_id", F.col("n"), F.col("missing")).withColumn("status", F.lit("pending"))
    return R.next_pending(tasks, ["user_id"]).select("user_id", "task_id", "task_type", "priority", "budget")


SQL["repair_queue"] = """
WITH t AS (
    SELECT user_id, event_id, CASE event_type WHEN 'error' THEN 'hallucination' ELSE 'detail' END AS task_type, CASE event_type WHEN 'error' THEN 1 ELSE 2 END AS priority FROM events WHERE event_type IN ('error', 'view')
)
SELECT user_id, upper(task_type) || '_t' || CAST(event_id AS VARCHAR) AS task_id, task_type, priority, 3 AS budget
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY priority, event_id) AS k FROM t) WHERE k = 1
"""


def attempt_loop(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/orders.parquet")
    return R.accepted_loop(rows, "o_custkey", "o_orderkey", F.col("o_orderstatus") == "F")


SQL["attempt_loop"] = """
WITH o AS (SELECT o_custkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders),
t AS (SELECT o_custkey, min(p) FILTER (WHERE o_orderstatus = 'F' AND p <= 3) AS hit, max(p) AS n FROM o GROUP BY o_custkey)
SELECT o_custkey, CAST(coalesce(hit, least(n, 3)) AS INTEGER) AS n_attempts, CASE WHEN hit IS NOT NULL THEN 'accepted' WHEN n >= 3 THEN 'exhausted' ELSE 'open' END AS outcome FROM t
"""


def _streamed(spark: SparkSession, d: str, root: str) -> DataFrame:
    """The events as judged turns through the keyed state and its sink; changes as the sink has them."""
    own = spark.newSession()  # so that the caller's settings stay as they are
    own.conf.set(*keyed.PROVIDER)
    events = own.readStream.schema(spark.read.parquet(f"{d}/events.parquet").schema).parquet(f"{d}/events.parquet*")
    k = F.array((F.get_json_object("props", "$.k").cast("long") % 10).cast("string"))
    none, is_ = F.array().cast("array<string>"), lambda x: F.col("event_type") == x
    turns = keyed.judged(
        events.filter("event_type IN ('error', 'purchase', 'view')"), "user_id", "event_id", F.when(is_("error"), "HALLUCINATION").otherwise("CORRECT"),
        F.when(is_("view"), none).otherwise(k), F.when(is_("view"), k).otherwise(none), F.when(is_("error"), F.array(F.concat(F.lit("E"), F.col("event_id").cast("string")))).otherwise(none),
    )
    artifacts.kept(keyed.states(turns), root, "changes", f"{root}/checkpoint", mode="update").awaitTermination()
    return artifacts.stored(spark, root, "changes", f"key long, {keyed.OUT}")


def streamed_states(spark: SparkSession, d: str) -> DataFrame:
    """Components of all users as a stream leaves them, with each user's events and gaps."""
    changes = _streamed(spark, d, f"{shared_dir(spark)}/quarry-streamed-{uuid.uuid4().hex}")
    now = artifacts.latest(changes, ["key", "kind", "id"])
    users = now.filter("kind = 'dialogue'").select("key", F.col("n_bad").alias("n_events"), F.col("n_corrected").alias("n_gaps"))
    return now.filter("kind = 'component'").select("key", F.col("id").alias("kc_id"), "status", "n_bad", "n_corrected").join(users, "key").withColumnRenamed("key", "user_id")


SQL["streamed_states"] = """
WITH m AS (
    SELECT user_id, event_id, CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS VARCHAR) AS kc_id,
        CASE event_type WHEN 'error' THEN 'bad' WHEN 'purchase' THEN 'covered' ELSE 'missing' END AS mark
    FROM events WHERE event_type IN ('error', 'purchase', 'view')
), d AS (SELECT *, lag(mark) OVER w AS before, row_number() OVER (PARTITION BY user_id, kc_id ORDER BY event_id DESC) AS back FROM m WHERE mark <> 'missing' WINDOW w AS (PARTITION BY user_id, kc_id ORDER BY event_id)),
e AS (
    SELECT user_id, kc_id, max(CASE WHEN back = 1 THEN CASE WHEN mark = 'bad' THEN 'hallucinated' WHEN before = 'bad' THEN 'corrected' ELSE 'lit' END END) AS status,
        count(*) FILTER (WHERE mark = 'bad') AS n_bad, count(*) FILTER (WHERE mark = 'covered' AND before = 'bad') AS n_corrected
    FROM d GROUP BY user_id, kc_id
), u AS (SELECT user_id, count(*) FILTER (WHERE mark = 'bad') AS n_events, count(*) FILTER (WHERE mark = 'missing') AS n_gaps FROM m GROUP BY user_id)
SELECT a.user_id, a.kc_id, coalesce(status, 'missing') AS status, coalesce(n_bad, 0) AS n_bad, coalesce(n_corrected, 0) AS n_corrected, n_events, n_gaps
FROM (SELECT DISTINCT user_id, kc_id FROM m) a LEFT JOIN e ON a.user_id = e.user_id AND a.kc_id = e.kc_id JOIN u ON u.user_id = a.user_id
"""
