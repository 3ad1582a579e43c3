"""Queries for ordered sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.operators import sequences as S
from quarry.operators.metrics import ratio

SQL: dict[str, str] = {}
BY_TIME = ["ts", "event_id"]


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def next_turn(spark: SparkSession, d: str) -> DataFrame:
    return S.with_next(_t(spark, d, "conversations"), ["conv_id"], ["turn"], {"turn": "next_turn", "role": "next_role"}).select("conv_id", "turn", "role", "next_turn", "next_role")


SQL["next_turn"] = "SELECT conv_id, turn, role, lead(turn) OVER w AS next_turn, lead(role) OVER w AS next_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"


def cumulative_series(spark: SparkSession, d: str) -> DataFrame:
    rows = S.running(_t(spark, d, "events"), ["user_id"], BY_TIME, {"n_events": F.lit(True), "n_errors": F.col("event_type") == "error"}, {"n_types": "event_type"})
    return rows.select("user_id", "event_id", "n_events", "n_errors", "n_types")


SQL["cumulative_series"] = """
WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1 AS fresh FROM events)
SELECT user_id, event_id, CAST(count(*) OVER w AS BIGINT) AS n_events, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS n_errors, CAST(sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER w AS BIGINT) AS n_types
FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)
"""


def repair_tasks(spark: SparkSession, d: str) -> DataFrame:
    return S.repair_tasks(_t(spark, d, "events"), ["user_id"], BY_TIME, F.col("event_type") == "error", F.col("event_type") == "purchase")


SQL["repair_tasks"] = """
WITH o AS (
    SELECT user_id, event_type, row_number() OVER w AS p, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER w AS root_no
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)
), t AS (
    SELECT user_id, root_no, min(p) FILTER (WHERE event_type = 'error') AS s, min(p) FILTER (WHERE event_type = 'purchase') AS f, max(p) AS e FROM o WHERE root_no > 0 GROUP BY user_id, root_no
)
SELECT user_id, CAST(root_no AS BIGINT) AS root_no, CAST(coalesce(f, e) - s AS INTEGER) AS attempts, f IS NOT NULL AS succeeded, f IS NULL AND e - s >= 3 AS exhausted, CAST(coalesce(f, e) - s + 1 AS INTEGER) AS span FROM t
"""


def correction_episodes(spark: SparkSession, d: str) -> DataFrame:
    found = S.correction_episodes(_t(spark, d, "events"), ["user_id"], BY_TIME, F.col("event_type") == "error", F.col("event_type") == "purchase")
    return found.select("user_id", "n_opened", "n_fixed", F.round("rate", 9).alias("rate"), F.round("mean_delta", 9).alias("mean_delta"))


SQL["correction_episodes"] = """
WITH o AS (
    SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p,
        coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ep
    FROM events
), t AS (SELECT user_id, ep, min(p) FILTER (WHERE event_type = 'error') AS h, min(p) FILTER (WHERE event_type = 'purchase') AS c FROM o GROUP BY user_id, ep)
SELECT user_id, count(h) AS n_opened, count(*) FILTER (WHERE c > h) AS n_fixed, round(coalesce(CAST(count(*) FILTER (WHERE c > h) AS DOUBLE) / nullif(count(h), 0), 0.0), 9) AS rate,
    round(avg(CASE WHEN c > h THEN c - h END), 9) AS mean_delta
FROM t GROUP BY user_id
"""


def concordance(spark: SparkSession, d: str) -> DataFrame:
    level = F.substring("o_orderpriority", 1, 1).cast("int") - 1
    return S.concordance(_t(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], level, 5).withColumn("score", F.round("score", 9))


SQL["concordance"] = """
WITH o AS (SELECT o_custkey, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS l, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p FROM orders)
SELECT a.o_custkey, count(b.p) AS n_pairs, count(b.p) FILTER (WHERE b.l <= a.l) AS n_concordant, round(CAST(count(b.p) FILTER (WHERE b.l <= a.l) AS DOUBLE) / nullif(count(b.p), 0), 9) AS score
FROM o a LEFT JOIN o b ON a.o_custkey = b.o_custkey AND b.p < a.p GROUP BY a.o_custkey
"""


def forward_fill(spark: SparkSession, d: str) -> DataFrame:
    return S.forward_fill(_t(spark, d, "events"), ["user_id"], BY_TIME, F.col("event_type") == "signup", F.col("event_id"), "signup_event").select("user_id", "event_id", "signup_event")


SQL["forward_fill"] = """
SELECT user_id, event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS signup_event FROM events
"""


def nearby_flag(spark: SparkSession, d: str) -> DataFrame:
    rows = S.nearby(_t(spark, d, "events"), ["user_id"], BY_TIME, F.col("event_type") == "view", 3, "has_view")
    return rows.groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("n_purchases"), F.count_if((F.col("event_type") == "purchase") & ~F.col("has_view")).alias("n_unviewed"))


SQL["nearby_flag"] = """
WITH e AS (SELECT user_id, event_type, max(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS v FROM events)
SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') AS n_purchases, count(*) FILTER (WHERE event_type = 'purchase' AND v = 0) AS n_unviewed FROM e GROUP BY user_id
"""


def nearest_fill(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "events").withColumn("known", F.when(F.col("event_type") == "signup", F.col("event_id")))
    return S.nearest_fill(rows, ["user_id"], BY_TIME, "known", F.col("event_type") == "view", 5).select("user_id", "event_id", "filled")


SQL["nearest_fill"] = """
WITH e AS (SELECT *, CASE WHEN event_type = 'signup' THEN event_id END AS k FROM events)
SELECT user_id, event_id, coalesce(k, CASE WHEN event_type = 'view' THEN coalesce(lag(k, 1) OVER w, lead(k, 1) OVER w, lag(k, 2) OVER w, lead(k, 2) OVER w, lag(k, 3) OVER w, lead(k, 3) OVER w, lag(k, 4) OVER w, lead(k, 4) OVER w, lag(k, 5) OVER w, lead(k, 5) OVER w) END) AS filled
FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
"""


def islands(spark: SparkSession, d: str) -> DataFrame:
    return S.islands(_t(spark, d, "events"), ["user_id"], BY_TIME, "event_type")


SQL["islands"] = """
WITH o AS (SELECT user_id, event_type, ts, event_id, row_number() OVER w AS p, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS island FROM o)
SELECT user_id, CAST(island AS BIGINT) AS island, min(event_type) AS event_type, count(*) AS n, CAST(min(p) AS INTEGER) AS first_at, CAST(max(p) AS INTEGER) AS last_at FROM i GROUP BY user_id, island
"""


def per_group_topk(spark: SparkSession, d: str) -> DataFrame:
    return S.top_per_group(_t(spark, d, "part"), ["p_brand"], [F.desc("p_retailprice"), "p_partkey"], 3).select("p_brand", "rank", "p_partkey", "p_retailprice")


SQL["per_group_topk"] = """
SELECT * FROM (SELECT p_brand, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS INTEGER) AS rank, p_partkey, p_retailprice FROM part) WHERE rank <= 3
"""


def round_robin(spark: SparkSession, d: str) -> DataFrame:
    return S.round_robin(_t(spark, d, "documents").select("doc_id", "source"), "source", ["doc_id"], 100).select("doc_id", "source", "turn")


SQL["round_robin"] = """
SELECT doc_id, source, turn FROM (SELECT doc_id, source, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INTEGER) AS turn FROM documents) ORDER BY turn, source LIMIT 100
"""


def interleave_schedule(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "conversations").select("conv_id", "turn", "role")
    return S.scheduled(rows, ["conv_id"], F.when(F.col("role") == "assistant", 1).otherwise(0), ["turn"], 5).select("conv_id", "turn", "position", "bucket")


SQL["interleave_schedule"] = """
WITH a AS (SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 1 ELSE 0 END AS s FROM conversations),
b AS (SELECT *, row_number() OVER (PARTITION BY conv_id, s ORDER BY turn) AS t FROM a),
c AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY t, s) - 1 AS p, count(*) OVER (PARTITION BY conv_id) AS n FROM b)
SELECT conv_id, turn, CAST(p AS INTEGER) AS position, CAST(least(floor(p * 5.0 / n), 4) AS INTEGER) AS bucket FROM c
"""


def overlap_batches(spark: SparkSession, d: str) -> DataFrame:
    rows = S.overlapping_batches(_t(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"], 6, 2)
    return rows.groupBy("o_custkey", "batch").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"))


SQL["overlap_batches"] = """
WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS p, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
b AS (SELECT o_custkey, max(CASE WHEN n <= 6 THEN 0 ELSE CAST(ceil((n - 6) / 4.0) AS BIGINT) END) AS last FROM o GROUP BY o_custkey),
x AS (SELECT o_custkey, unnest(range(0, last + 1)) AS batch FROM b)
SELECT x.o_custkey, CAST(batch AS BIGINT) AS batch, count(*) AS n, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key
FROM x JOIN o ON x.o_custkey = o.o_custkey AND p >= batch * 4 AND p < batch * 4 + 6 GROUP BY x.o_custkey, batch
"""


def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    return S.running_ids(_t(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "U_%d_%03d", "unit_id").select("o_orderkey", "unit_id")


SQL["stable_ids"] = "SELECT o_orderkey, printf('U_%d_%03d', o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) AS unit_id FROM orders"


def recent_turns(spark: SparkSession, d: str) -> DataFrame:
    rows = S.recent_turns(_t(spark, d, "conversations"), ["conv_id"], ["turn"], F.concat(F.col("role"), F.lit(": "), F.substring("text", 1, 180)), 4)
    return rows.select("conv_id", "turn", F.char_length("recent").alias("n_chars"), F.sha2("recent", 256).alias("sha"))


SQL["recent_turns"] = """
WITH c AS (SELECT conv_id, turn, coalesce(string_agg(role || ': ' || substr(text, 1, 180), chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), '') AS r FROM conversations)
SELECT conv_id, turn, CAST(length(r) AS INTEGER) AS n_chars, sha256(r) AS sha FROM c
"""


def history_length(spark: SparkSession, d: str) -> DataFrame:
    """The length of all that was said before, by running sums; the text itself is recent_turns with keep=None."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    n = F.sum(F.char_length("role") + F.char_length("text") + 3).over(before)
    return _t(spark, d, "conversations").select("conv_id", "turn", F.coalesce(n, F.lit(0)).alias("history_chars"), F.round(ratio(F.coalesce(n, F.lit(0)), F.col("turn")), 9).alias("chars_per_turn"))


SQL["history_length"] = """
WITH c AS (SELECT conv_id, turn, CAST(coalesce(sum(length(role) + length(text) + 3) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS n FROM conversations)
SELECT conv_id, turn, n AS history_chars, round(CASE WHEN turn > 0 THEN CAST(n AS DOUBLE) / turn END, 9) AS chars_per_turn FROM c
"""
