"""Queries for metrics and roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import metrics as M

SQL: dict[str, str] = {}
CATEGORIES = {"view": "engage", "click": "engage", "purchase": "convert", "error": "fail"}
LANGS = ["en", "de", "fr", "es", "it", "zh"]


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def paper_mean_vs_pooled(spark: SparkSession, d: str) -> DataFrame:
    lines = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("num"), F.count(F.lit(1)).alias("den"))
    runs = lines.join(_t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    runs = runs.join(_t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("model"), F.col("c_custkey").alias("paper"), "num", "den")
    return M.means_and_pooled(runs, "model", "paper", "num", "den").select("model", *[F.round(c, 9).alias(c) for c in ("paper_mean", "micro", "std")], "valid_papers", "valid_runs", "num_sum", "den_sum")


SQL["paper_mean_vs_pooled"] = """
WITH runs AS (
    SELECT n_name AS model, c_custkey AS paper, count(*) FILTER (WHERE l_returnflag = 'R') AS num, count(*) AS den
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    GROUP BY n_name, c_custkey, o_orderkey
), papers AS (
    SELECT model, paper, avg(CAST(num AS DOUBLE) / den) AS m, count(*) AS r, sum(num) AS num, sum(den) AS den FROM runs GROUP BY model, paper
)
SELECT model, round(avg(m), 9) AS paper_mean, round(CAST(sum(num) AS DOUBLE) / sum(den), 9) AS micro, round(stddev_samp(m), 9) AS std,
    count(m) AS valid_papers, CAST(sum(r) AS BIGINT) AS valid_runs, CAST(sum(num) AS BIGINT) AS num_sum, CAST(sum(den) AS BIGINT) AS den_sum
FROM papers GROUP BY model
"""


def _dialogues(spark: SparkSession, d: str) -> DataFrame:
    said = F.col("role") == "assistant"
    counts = _t(spark, d, "conversations").groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("turns"), F.count_if(said).alias("assistant_turns"), F.coalesce(F.sum(F.when(said, F.char_length("text"))), F.lit(0)).alias("answer_chars"))
    return counts.withColumns({"assistant_share": M.ratio("assistant_turns", "turns"), "chars_per_turn": M.ratio("answer_chars", "assistant_turns")})


def metric_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _dialogues(spark, d).select("conv_id", "turns", "assistant_turns", "answer_chars", F.round("assistant_share", 9).alias("assistant_share"), F.round("chars_per_turn", 9).alias("chars_per_turn"))


SQL["metric_pairs"] = """
SELECT conv_id, count(*) AS turns, count(*) FILTER (WHERE role = 'assistant') AS assistant_turns,
    CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS answer_chars,
    round(CAST(count(*) FILTER (WHERE role = 'assistant') AS DOUBLE) / count(*), 9) AS assistant_share,
    round(CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS DOUBLE) / nullif(count(*) FILTER (WHERE role = 'assistant'), 0), 9) AS chars_per_turn
FROM conversations GROUP BY conv_id
"""


def dimension_unpivot(spark: SparkSession, d: str) -> DataFrame:
    return M.unpivot(metric_pairs(spark, d), ["conv_id"], ["turns", "assistant_turns", "answer_chars", "assistant_share", "chars_per_turn"])


SQL["dimension_unpivot"] = f"""
WITH p AS ({SQL["metric_pairs"]})
SELECT conv_id, 'turns' AS metric, CAST(turns AS DOUBLE) AS value FROM p UNION ALL SELECT conv_id, 'assistant_turns', CAST(assistant_turns AS DOUBLE) FROM p
UNION ALL SELECT conv_id, 'answer_chars', CAST(answer_chars AS DOUBLE) FROM p UNION ALL SELECT conv_id, 'assistant_share', assistant_share FROM p
UNION ALL SELECT conv_id, 'chars_per_turn', chars_per_turn FROM p
"""


def category_pivot(spark: SparkSession, d: str) -> DataFrame:
    everyone = _t(spark, d, "customer").select(F.col("c_custkey").alias("user_id")).union(_t(spark, d, "events").select("user_id"))
    return M.category_pivot(_t(spark, d, "events"), ["user_id"], "event_type", CATEGORIES, everyone)


SQL["category_pivot"] = """
WITH everyone AS (SELECT c_custkey AS user_id FROM customer UNION SELECT user_id FROM events)
SELECT p.user_id, count(*) FILTER (WHERE event_type IN ('view', 'click')) AS engage, count(*) FILTER (WHERE event_type = 'purchase') AS convert,
    count(*) FILTER (WHERE event_type = 'error') AS fail, count(e.event_id) FILTER (WHERE event_type = 'signup') AS unmapped, count(e.event_id) AS total, true AS reconciled
FROM everyone p LEFT JOIN events e ON p.user_id = e.user_id GROUP BY p.user_id
"""


def category_paths(spark: SparkSession, d: str) -> DataFrame:
    return M.path_counts(_t(spark, d, "documents"), ["lang", "source"]).withColumn("share", F.round("share", 9))


SQL["category_paths"] = "SELECT lang, source, count(*) AS n, round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM documents), 9) AS share FROM documents GROUP BY lang, source"


def rollup_summary(spark: SparkSession, d: str) -> DataFrame:
    n = F.char_length("text")
    return M.rolled_up(_t(spark, d, "conversations"), "role", [F.count(F.lit(1)).alias("turns"), F.sum(n).alias("chars"), F.round(F.avg(n), 6).alias("avg_chars"), F.max(n).alias("most_chars")])


SQL["rollup_summary"] = """
SELECT role, count(*) AS turns, CAST(sum(length(text)) AS BIGINT) AS chars, round(avg(length(text)), 6) AS avg_chars, CAST(max(length(text)) AS INTEGER) AS most_chars, CAST(grouping(role) AS INTEGER) AS is_total
FROM conversations GROUP BY ROLLUP (role)
"""


def fixed_dim_failure(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "labels").join(_t(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return M.fixed_rates(rows, "lang", LANGS, F.col("toxic") == 1).withColumn("rate", F.round("rate", 9))


SQL["fixed_dim_failure"] = """
WITH r AS (SELECT lang, count(*) AS total, count(*) FILTER (WHERE toxic = 1) AS failed FROM labels JOIN documents USING (doc_id) GROUP BY lang)
SELECT f.lang, coalesce(total, 0) AS total, coalesce(failed, 0) AS failed, round(coalesce(CAST(failed AS DOUBLE) / total, 0.0), 9) AS rate
FROM (VALUES ('en'), ('de'), ('fr'), ('es'), ('it'), ('zh')) f(lang) LEFT JOIN r ON f.lang = r.lang
"""


def failure_by_type(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("value") < 5).alias("failed"))
    return rows.withColumn("rate", M.rate("failed", "total", 6))


SQL["failure_by_type"] = """
SELECT event_type, count(*) AS total, count(*) FILTER (WHERE value < 5) AS failed, round(CAST(count(*) FILTER (WHERE value < 5) AS DOUBLE) / count(*), 6) AS rate
FROM events GROUP BY event_type
"""


def plan_status(spark: SparkSession, d: str) -> DataFrame:
    papers = _t(spark, d, "region").select(F.col("r_name").alias("paper"))
    models = spark.createDataFrame([(x,) for x in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "6-NEVER")], "model string")
    nations = _t(spark, d, "nation").join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    own = _t(spark, d, "orders").join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    reports = own.groupBy(F.format_string("round-%02d", F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3)).alias("round"), F.col("r_name").alias("paper"), F.col("o_orderpriority").alias("model")).agg(F.count(F.lit(1)).alias("n"))
    found = M.with_status(M.plan(4, papers, models), reports, ["round", "paper", "model"], F.col("n") >= 20)
    return found.select("round", "paper", "model", "status", F.coalesce("n", F.lit(0)).alias("n"))


SQL["plan_status"] = """
WITH plan AS (
    SELECT printf('round-%02d', i) AS round, r_name AS paper, m.model FROM range(1, 5) t(i), region,
        (VALUES ('1-URGENT'), ('2-HIGH'), ('3-MEDIUM'), ('4-NOT SPECIFIED'), ('5-LOW'), ('6-NEVER')) m(model)
), reports AS (
    SELECT CASE o_orderstatus WHEN 'F' THEN 'round-01' WHEN 'O' THEN 'round-02' ELSE 'round-03' END AS round, r_name AS paper, o_orderpriority AS model, count(*) AS n
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3
)
SELECT p.round, p.paper, p.model, CASE WHEN n IS NULL THEN 'missing' WHEN n < 20 THEN 'incomplete' ELSE 'completed' END AS status, coalesce(n, 0) AS n
FROM plan p LEFT JOIN reports r ON p.round = r.round AND p.paper = r.paper AND p.model = r.model
"""


def outer_diff(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = _t(spark, d, "documents"), _t(spark, d, "labels")
    every = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    labelled = docs.join(labels.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return M.differences(every, labelled, ["source"], "n")


SQL["outer_diff"] = """
WITH a AS (SELECT source, count(*) AS n FROM documents GROUP BY source), b AS (SELECT source, count(*) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY source)
SELECT coalesce(a.source, b.source) AS source, a.n AS expected, b.n AS actual FROM a FULL OUTER JOIN b ON a.source = b.source WHERE a.n IS DISTINCT FROM b.n
"""


def json_flatten(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return _t(spark, d, "events").groupBy("event_type").agg(F.count(k).alias("n_k"), F.min(k).alias("min_k"), F.max(k).alias("max_k"), F.sum(k).alias("sum_k"), F.round(F.avg(k), 6).alias("avg_k"))


SQL["json_flatten"] = """
WITH e AS (SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_type, count(k) AS n_k, min(k) AS min_k, max(k) AS max_k, CAST(sum(k) AS BIGINT) AS sum_k, round(avg(k), 6) AS avg_k FROM e GROUP BY event_type
"""


def presence_overview(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents").select("doc_id", "source", "lang")
    marks = _t(spark, d, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("quality").alias("quality"))
    return docs.join(marks, "doc_id", "left").groupBy("source", "lang").agg(
        F.count(F.lit(1)).alias("n_docs"), F.count("quality").alias("n_annotated"), F.count_if(F.col("toxic") == 1).alias("n_toxic"), F.count_if(F.col("quality") == 1).alias("n_good"))


SQL["presence_overview"] = """
WITH m AS (SELECT doc_id, max(toxic) AS toxic, max(quality) AS quality FROM labels GROUP BY doc_id)
SELECT source, lang, count(*) AS n_docs, count(quality) AS n_annotated, count(*) FILTER (WHERE toxic = 1) AS n_toxic, count(*) FILTER (WHERE quality = 1) AS n_good
FROM documents d LEFT JOIN m ON d.doc_id = m.doc_id GROUP BY source, lang
"""
