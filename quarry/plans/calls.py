"""Queries that ask models, behind a stub, and drive loops over what they answer."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import calls, loops
from quarry.operators import constraints as C
from quarry.storage import shared_dir

SQL: dict[str, str] = {}


def answered_requests(spark: SparkSession, d: str) -> DataFrame:
    """Every turn of every conversation asked as a chat: repeated texts once, busy refusals again, bad requests as errors."""
    turns = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text")
    rows = turns.withColumn("request", calls.chat_request(F.lit("stub"), F.lit("Answer as offline."), F.concat_ws(": ", "role", "text")))
    done = calls.answered(rows, "request", f"{shared_dir(spark)}/quarry-answers-{uuid.uuid4().hex}", calls.Stub(), pause=0.0)
    return done.select("conv_id", "turn", "answer", "error", "attempts")


SQL["answered_requests"] = """
WITH h AS (SELECT conv_id, turn, sha256(concat_ws(': ', role, text)) AS h FROM conversations)
SELECT conv_id, turn, CASE WHEN h[1] <> '0' THEN 'offline:' || h[1:12] END AS answer, CASE WHEN h[1] = '0' THEN '400: bad request' END AS error,
    CAST(CASE WHEN h[1] IN ('1', '2', '3', '4') THEN 2 ELSE 1 END AS INTEGER) AS attempts
FROM h
"""


def question_loop(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's orders as plans: two acceptances wanted, three attempts a plan, verdicts by number; all trials in a plain loop's order."""
    plans = spark.read.parquet(f"{d}/orders.parquet").select("o_custkey", "o_orderkey", F.col("o_orderkey").alias("place"))
    score = (F.col("o_orderkey") * 7 + F.col("attempt") * 13) % 10
    verdict = F.when(score < 3, "accepted").when(score == 3, "barred").when(score < 7, "unusable").otherwise("too easy")
    judge = lambda rows: rows.withColumn("verdict", verdict).withColumn("feedback", F.concat_ws(" after ", "verdict", "feedback"))
    trials = loops.run(plans, ["o_custkey"], "o_orderkey", "place", judge, f"{shared_dir(spark)}/quarry-loop-{uuid.uuid4().hex}", target=2)
    return trials.select("o_custkey", "o_orderkey", "attempt", "verdict", "feedback", "question_no")


_TRIALS = """
WITH v AS (
    SELECT *, CASE WHEN s < 3 THEN 'accepted' WHEN s = 3 THEN 'barred' WHEN s < 7 THEN 'unusable' ELSE 'too easy' END AS verdict
    FROM (SELECT o_custkey, o_orderkey, attempt, (o_orderkey * 7 + attempt * 13) % 10 AS s FROM (SELECT o_custkey, o_orderkey, unnest([1, 2, 3]) AS attempt FROM orders))
),
e AS (SELECT *, min(CASE WHEN verdict IN ('accepted', 'barred') THEN attempt END) OVER (PARTITION BY o_orderkey) AS ended FROM v),
k AS (SELECT * FROM e WHERE attempt <= coalesce(ended, 3)),
p AS (SELECT o_custkey, o_orderkey, max(CASE WHEN verdict = 'accepted' THEN 1 ELSE 0 END) AS ok FROM k GROUP BY 1, 2),
c AS (SELECT *, coalesce(sum(ok) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS had FROM p),
t AS (SELECT k.* FROM k JOIN c USING (o_custkey, o_orderkey) WHERE had < 2)
"""

SQL["question_loop"] = f"""{_TRIALS}
SELECT o_custkey, o_orderkey, CAST(attempt AS INTEGER) AS attempt, verdict,
    concat_ws(' after ', verdict, lag(verdict) OVER (PARTITION BY o_orderkey ORDER BY attempt), lag(verdict, 2) OVER (PARTITION BY o_orderkey ORDER BY attempt)) AS feedback,
    CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, attempt) AS INTEGER) AS question_no
FROM t
"""


def group_constraints(spark: SparkSession, d: str) -> DataFrame:
    """What the line items of each order break of rules on numbers, kinds, order, distinct sources and caps, and orders that name unknown parts."""
    items = spark.read.parquet(f"{d}/lineitem.parquet")
    keys, at, place = ["l_orderkey"], F.col("l_linenumber"), F.expr("(((l_linenumber * 1000000L + l_partkey) * 10000L + l_suppkey) * 100L + CAST(l_quantity AS BIGINT)) * 128L + ascii(l_returnflag)")  # numbers repeat in some orders
    rows = C.before(items, keys, [place], "l_returnflag", "flag_before")
    rules = {
        "two to six lines": C.between(2, 6), "numbered from one": C.consecutive(at), "a bridge": C.any_of(F.col("l_suppkey") % 4 == 0), "two suppliers": C.distinct_values("l_suppkey", 2),
        "three parts": C.distinct_values("l_partkey", 3), "returned before open": C.comes_before(F.col("l_returnflag") == "R", F.col("l_linestatus") == "O", at), "begins large": C.starts_with(F.col("l_quantity") > 10, place),
        "ends small": C.ends_with(F.col("l_quantity") <= 40, place), "all discounted alike": C.all_of(F.col("l_discount") <= 0.08), "no flag twice": C.all_of(~F.col("l_returnflag").eqNullSafe(F.col("flag_before"))),
    }
    known = spark.read.parquet(f"{d}/part.parquet").filter("p_size < 45").select("p_partkey")
    return (
        C.violations(rows, keys, rules).unionByName(C.over_cap(items, keys, [F.col("l_partkey") % 5], 2, "a class of parts twice at most"))
        .unionByName(C.unknown(items.select("l_orderkey", F.array("l_partkey").alias("parts")), keys, "parts", known, "known parts"))
    )


SQL["group_constraints"] = """
WITH i AS (SELECT *, (((l_linenumber * 1000000::BIGINT + l_partkey) * 10000::BIGINT + l_suppkey) * 100::BIGINT + CAST(l_quantity AS BIGINT)) * 128::BIGINT + ascii(l_returnflag) AS place FROM lineitem),
r AS (SELECT *, lag(l_returnflag) OVER (PARTITION BY l_orderkey ORDER BY place) AS b FROM i),
g AS (
    SELECT l_orderkey, count(*) BETWEEN 2 AND 6 AS r0, min(l_linenumber) = 1 AND max(l_linenumber) = count(*) AND count(DISTINCT l_linenumber) = count(*) AS r1, bool_or(l_suppkey % 4 = 0) AS r2,
        count(DISTINCT l_suppkey) >= 2 AS r3, count(DISTINCT l_partkey) >= 3 AS r4, coalesce(max(CASE WHEN l_returnflag = 'R' THEN l_linenumber END) < min(CASE WHEN l_linestatus = 'O' THEN l_linenumber END), true) AS r5,
        arg_min(l_quantity > 10, place) AS r6, arg_max(l_quantity <= 40, place) AS r7, bool_and(l_discount <= 0.08) AS r8, bool_and(l_returnflag IS DISTINCT FROM b) AS r9
    FROM r GROUP BY l_orderkey
)
SELECT l_orderkey, rule FROM (
    SELECT l_orderkey, unnest([r0, r1, r2, r3, r4, r5, r6, r7, r8, r9]) AS ok,
        unnest(['two to six lines', 'numbered from one', 'a bridge', 'two suppliers', 'three parts', 'returned before open', 'begins large', 'ends small', 'all discounted alike', 'no flag twice']) AS rule FROM g
) WHERE NOT ok
UNION ALL SELECT DISTINCT l_orderkey, 'a class of parts twice at most' FROM (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey, l_partkey % 5 HAVING count(*) > 2)
UNION ALL SELECT DISTINCT l_orderkey, 'known parts' FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 45)
"""
