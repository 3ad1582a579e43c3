"""Queries for planning and report groups: parts stand for knowledge components, brands for units, sizes for macros, lines for tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import planning as P
from quarry.operators import reports as R
from quarry.operators.selection import merged_sequences, stop_reason, trailing_number
from quarry.plans.metrics import _t

SQL: dict[str, str] = {}
STRENGTHS = {"ECONOMY": "strong", "SMALL": "general", "LARGE": "weak"}


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return _t(spark, d, "part").select(
        F.concat(F.lit("K"), k.cast("string")).alias("kc_id"), F.col("p_brand").alias("unit_id"), F.concat(F.lit("M"), (F.col("p_size") % 10).cast("string")).alias("macro_id"), F.col("p_retailprice").alias("score"),
        F.col("p_name").alias("claim"), F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in STRENGTHS.items() for x in kv]), F.col("p_type")), F.lit("weak")).alias("claim_strength"), (k % 9 == 0).alias("is_general"),
        F.when(k % 3 == 0, F.array(F.concat("p_name", F.lit(" never")), F.concat("p_name", F.lit(" always")))).otherwise(F.array().cast("array<string>")).alias("forbidden_claims"),
        F.when(k % 4 == 0, F.concat(F.lit("A"), (k % 20).cast("string"))).alias("asset_id"), F.when(k % 4 == 0, F.when(k % 8 == 0, "figure").otherwise("table")).alias("asset_type"),
    )


_NODES = f"""
WITH n AS MATERIALIZED (
    SELECT 'K' || CAST(p_partkey AS VARCHAR) AS kc_id, p_partkey AS k, p_brand AS unit_id, 'M' || CAST(p_size % 10 AS VARCHAR) AS macro_id, p_retailprice AS score, p_name AS claim,
        CASE {" ".join(f"WHEN p_type = '{a}' THEN '{b}'" for a, b in STRENGTHS.items())} ELSE 'weak' END AS claim_strength, p_partkey % 9 = 0 AS is_general, p_partkey % 3 = 0 AS has_forbidden,
        CASE WHEN p_partkey % 4 = 0 THEN 'A' || CAST(p_partkey % 20 AS VARCHAR) END AS asset_id, CASE WHEN p_partkey % 8 = 0 THEN 'figure' WHEN p_partkey % 4 = 0 THEN 'table' END AS asset_type
    FROM part
)
"""
#: The parts that count as active: those that some customer has returned in quantity.
_ACTIVE = "SELECT DISTINCT 'K' || CAST(l_partkey AS VARCHAR) AS kc_id FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 48"


def _active(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "lineitem").filter("l_returnflag = 'R' and l_quantity > 48").select(F.concat(F.lit("K"), F.col("l_partkey").cast("string")).alias("kc_id")).distinct()


def unit_contexts(spark: SparkSession, d: str) -> DataFrame:
    """The components of each unit in natural order, and units that are skipped as they have fewer than two. Every brand and one unknown brand are units."""
    nodes = _nodes(spark, d)
    units = nodes.select("unit_id").distinct().unionByName(spark.createDataFrame([("Brand#none",)], "unit_id string"))
    kept = P.unit_contexts(nodes, units).select("unit_id", F.size("kc_ids").cast("long").alias("n_kcs"), F.sha2(F.array_join("kc_ids", ","), 256).alias("kc_ids"))
    return kept.unionByName(P.skipped_units(units, nodes).withColumn("kc_ids", F.lit(None).cast("string")))


SQL["unit_contexts"] = f"""{_NODES}
SELECT unit_id, count(*) AS n_kcs, CASE WHEN count(*) >= 2 THEN sha256(string_agg(kc_id, ',' ORDER BY k)) END AS kc_ids FROM n GROUP BY unit_id UNION ALL SELECT 'Brand#none', 0, NULL
"""


def macro_contexts(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping batches of the components of each macro."""
    rows = P.macro_contexts(_nodes(spark, d))
    return rows.select("macro_id", "batch", F.size("kc_ids").alias("n_kcs"), F.sha2(F.array_join("kc_ids", ","), 256).alias("kc_ids"))


SQL["macro_contexts"] = f"""{_NODES},
o AS (SELECT macro_id, kc_id, row_number() OVER (PARTITION BY macro_id ORDER BY k) - 1 AS p, count(*) OVER (PARTITION BY macro_id) AS n FROM n WHERE macro_id IN (SELECT macro_id FROM n GROUP BY 1 HAVING count(*) >= 2 AND count(DISTINCT unit_id) >= 2)),
b AS (SELECT macro_id, max(CASE WHEN n <= 30 THEN 0 ELSE CAST(ceil((n - 30) / 25.0) AS BIGINT) END) AS last FROM o GROUP BY macro_id),
x AS (SELECT macro_id, unnest(range(0, last + 1)) AS batch FROM b)
SELECT x.macro_id, CAST(batch AS BIGINT) AS batch, CAST(count(*) AS INTEGER) AS n_kcs, sha256(string_agg(kc_id, ',' ORDER BY kc_id)) AS kc_ids FROM x JOIN o ON x.macro_id = o.macro_id AND p >= batch * 25 AND p < batch * 25 + 30 GROUP BY x.macro_id, batch
"""


def _macro_edges(spark: SparkSession) -> DataFrame:
    return spark.range(12).select(F.concat(F.lit("M"), F.col("id").cast("string")).alias("source"), F.concat(F.lit("M"), (F.col("id") + 1).cast("string")).alias("target"))


_EDGES = "SELECT 'M' || CAST(i AS VARCHAR) AS source, 'M' || CAST(i + 1 AS VARCHAR) AS target FROM (SELECT unnest(range(0, 12)) AS i)"


def adjacent_contexts(spark: SparkSession, d: str) -> DataFrame:
    """The best components on either side of each edge between macros, and edges that lack a side."""
    nodes, edges = _nodes(spark, d), _macro_edges(spark)
    kept = P.adjacent_contexts(edges, nodes).select("source", "target", F.array_join("source_kc_ids", ",").alias("source_kc_ids"), F.array_join("target_kc_ids", ",").alias("target_kc_ids"))
    none = F.lit(None).cast("string")
    return kept.unionByName(P.skipped_macro_edges(edges, nodes).select("source", "target", none.alias("source_kc_ids"), none.alias("target_kc_ids")))


SQL["adjacent_contexts"] = f"""{_NODES}, e AS ({_EDGES}),
t AS (SELECT macro_id, string_agg(kc_id, ',' ORDER BY kc_id) AS kcs FROM (SELECT *, row_number() OVER (PARTITION BY macro_id ORDER BY score DESC, k) AS r FROM n) WHERE r <= 12 GROUP BY macro_id)
SELECT source, target, CASE WHEN b.kcs IS NOT NULL THEN a.kcs END AS source_kc_ids, CASE WHEN a.kcs IS NOT NULL THEN b.kcs END AS target_kc_ids FROM e LEFT JOIN t a ON source = a.macro_id LEFT JOIN t b ON target = b.macro_id
"""


def macro_banks(spark: SparkSession, d: str) -> DataFrame:
    """Per macro how many components there are and how many are active; macros 10 and 11 have none and are skipped."""
    macros = spark.range(12).select(F.concat(F.lit("M"), F.col("id").cast("string")).alias("macro_id"))
    counts = P.bank_counts(macros, _nodes(spark, d), _active(spark, d))
    skipped = P.skipped_macros(macros, _nodes(spark, d)).select("macro_id", F.lit(True).alias("skipped"))
    return counts.join(skipped, "macro_id", "left").fillna(False, ["skipped"])


SQL["macro_banks"] = f"""{_NODES}, a AS ({_ACTIVE})
SELECT m.macro_id, count(kc_id) AS bank_count, count(*) FILTER (WHERE kc_id IN (SELECT kc_id FROM a)) AS active_count, count(kc_id) < 2 OR count(DISTINCT unit_id) < 2 AS skipped
FROM (SELECT 'M' || CAST(unnest(range(0, 12)) AS VARCHAR) AS macro_id) m LEFT JOIN n ON m.macro_id = n.macro_id GROUP BY m.macro_id
"""


def main_targets(spark: SparkSession, d: str) -> DataFrame:
    """Per macro its active components, or its three best."""
    return P.main_targets(_nodes(spark, d), _active(spark, d)).select("macro_id", F.size("target_kc_ids").alias("n"), F.sha2(F.array_join("target_kc_ids", ","), 256).alias("target_kc_ids"))


SQL["main_targets"] = f"""{_NODES}, a AS ({_ACTIVE}), l AS (SELECT macro_id, kc_id FROM n WHERE kc_id IN (SELECT kc_id FROM a)),
r AS (SELECT macro_id, kc_id FROM (SELECT *, row_number() OVER (PARTITION BY macro_id ORDER BY score DESC, k) AS p FROM n WHERE macro_id NOT IN (SELECT macro_id FROM l)) WHERE p <= 3)
SELECT macro_id, CAST(count(*) AS INTEGER) AS n, sha256(string_agg(kc_id, ',' ORDER BY kc_id)) AS target_kc_ids FROM (SELECT * FROM l UNION ALL SELECT * FROM r) GROUP BY macro_id
"""


def challenge_plans(spark: SparkSession, d: str) -> DataFrame:
    """Plans of three kinds, each once, dealt out in turn up to the target; a pool holds twelve of each."""
    nodes = _nodes(spark, d)
    edges = nodes.join(nodes.select(F.col("kc_id").alias("target"), "score"), "score").filter("kc_id < target").select(F.col("kc_id").alias("source"), "target", F.concat(F.lit("E"), F.regexp_extract("kc_id", r"\d+", 0)).alias("edge_id"), F.lit("equals").alias("relation"))
    edges = edges.unionByName(nodes.select(F.col("kc_id").alias("source"), F.concat(F.lit("K"), (trailing_number(F.col("kc_id")) + 1).cast("string")).alias("target"), F.concat(F.lit("E"), F.regexp_extract("kc_id", r"\d+", 0)).alias("edge_id"), F.lit("precedes").alias("relation")))
    pool = P.overclaim_plans(nodes).unionByName(P.false_premise_plans(nodes)).unionByName(P.wrong_relation_plans(edges, nodes))
    done = P.balanced(P.deduplicated(pool, ["trap"]), ["overclaim_challenge", "false_premise_challenge", "wrong_relation_challenge"], [F.array_join("kc_ids", ","), "trap"], 30)
    return done.select("challenge_plan_id", "challenge_type", F.array_join("kc_ids", ",").alias("kc_ids"), F.array_join("edge_ids", ",").alias("edge_ids"), "trap")


SQL["challenge_plans"] = f"""{_NODES},
e AS (
    SELECT a.kc_id AS source, b.kc_id AS target, 'E' || CAST(a.k AS VARCHAR) AS edge_id, a.k AS ek, 'equals' AS relation FROM n a JOIN n b ON a.score = b.score AND a.kc_id < b.kc_id
    UNION ALL SELECT a.kc_id, 'K' || CAST(a.k + 1 AS VARCHAR), 'E' || CAST(a.k AS VARCHAR), a.k, 'precedes' FROM n a WHERE a.k + 1 IN (SELECT k FROM n)
),
p AS (
    (SELECT 'overclaim_challenge' AS challenge_type, 0 AS t, kc_id AS kc_ids, '' AS edge_ids, claim AS trap FROM n WHERE claim_strength IN ('strong', 'general') OR is_general ORDER BY score DESC, k LIMIT 12)
    UNION ALL (SELECT 'false_premise_challenge', 1, kc_id, '', trap FROM (SELECT *, unnest([0, 1]) AS at_, unnest([claim || ' never', claim || ' always']) AS trap FROM n WHERE has_forbidden) ORDER BY score DESC, k, at_ LIMIT 12)
    UNION ALL (SELECT 'wrong_relation_challenge', 2, source || ',' || target, edge_id, target || ' ' || relation || ' ' || source FROM e ORDER BY ek, edge_id, relation DESC LIMIT 12)
),
q AS (SELECT DISTINCT * FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY challenge_type ORDER BY kc_ids, trap) AS turn FROM q),
s AS (SELECT *, row_number() OVER (ORDER BY turn, t) AS i FROM r)
SELECT printf('CHP_%04d', i) AS challenge_plan_id, challenge_type, kc_ids, edge_ids, trap FROM s WHERE i <= 30
"""


def thread_plans(spark: SparkSession, d: str) -> DataFrame:
    """Plans for threads, one per region and type, and the first that is neither used nor tried too often."""
    threads = _t(spark, d, "nation").select(F.concat(F.lit("RT"), F.col("n_nationkey").cast("string")).alias("thread_id"))
    plans = P.thread_plans(threads).withColumn("challenge_plan_id", F.concat_ws(":", "thread_id", "challenge_type"))
    used = plans.filter("thread_id in ('RT0', 'RT1')")
    attempts = plans.filter("thread_id = 'RT2'").select("challenge_plan_id", F.when(F.col("challenge_type") == "thread_overclaim", 2).otherwise(3).alias("n"))
    first = P.next_plan(plans, [trailing_number(F.col("thread_id")), "challenge_type"], used, attempts).select("challenge_plan_id", F.lit(True).alias("next"))
    return plans.join(first, "challenge_plan_id", "left").fillna(False, ["next"])


SQL["thread_plans"] = """
WITH t AS (SELECT n_nationkey AS k, 'RT' || CAST(n_nationkey AS VARCHAR) AS thread_id, unnest([0, 1, 2]) AS i, unnest(['thread_wrong_bridge', 'thread_overclaim', 'thread_premise_mutation']) AS challenge_type FROM nation)
SELECT thread_id, challenge_type, concat(thread_id, ':', challenge_type) AS challenge_plan_id, thread_id = 'RT2' AND challenge_type = 'thread_overclaim' AS next FROM (SELECT * FROM t ORDER BY k, i LIMIT 24)
"""


def asset_references(spark: SparkSession, d: str) -> DataFrame:
    """Assets and the components that rest on them."""
    return P.asset_references(_nodes(spark, d)).select("asset_id", "asset_type", F.size("kc_ids").alias("n"), F.sha2(F.array_join("kc_ids", ","), 256).alias("kc_ids"))


SQL["asset_references"] = f"{_NODES} SELECT asset_id, asset_type, CAST(count(*) AS INTEGER) AS n, sha256(string_agg(kc_id, ',' ORDER BY k)) AS kc_ids FROM n WHERE asset_id IS NOT NULL GROUP BY 1, 2"


def section_macros(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as sections, nations as macros whose sources name them by id, by name, or both."""
    groups = _t(spark, d, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("section_id"), F.upper("s_name").alias("section_title"))
    named = _t(spark, d, "supplier").select(F.concat(F.lit("M"), (F.col("s_suppkey") % 4).cast("string")).alias("macro_id"), F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit(" s"), F.col("s_suppkey").cast("string"))).when(F.col("s_suppkey") % 3 == 1, F.col("s_name")).alias("s"))
    more = _t(spark, d, "supplier").filter("s_suppkey % 6 = 0").select(F.lit("M9").alias("macro_id"), F.col("s_name").alias("s"))
    macros = named.unionByName(more).filter("s is not null").groupBy("macro_id").agg(F.collect_list("s").alias("source_sections"))
    return P.resolved_sections(groups, macros).select("section_id", "macro_id", "resolution")


SQL["section_macros"] = """
SELECT 'S' || CAST(s_suppkey AS VARCHAR) AS section_id, CASE WHEN s_suppkey % 3 <> 2 AND s_suppkey % 6 <> 0 THEN 'M' || CAST(s_suppkey % 4 AS VARCHAR) END AS macro_id,
    CASE WHEN s_suppkey % 3 = 2 THEN 'unresolved' WHEN s_suppkey % 6 = 0 THEN 'ambiguous' ELSE 'resolved' END AS resolution
FROM supplier
"""


def evaluation_texts(spark: SparkSession, d: str) -> DataFrame:
    """Turns of a conversation as blocks; the second and third are covered by an asset that stands in place of the second."""
    blocks = _t(spark, d, "conversations").select(F.col("conv_id").alias("paper_id"), F.col("turn").alias("block_id"), F.col("turn").alias("order"), "text")
    assets = blocks.filter("block_id = 2").select("paper_id", F.array(F.lit(2), F.lit(3)).cast("array<bigint>").alias("block_ids"), F.concat(F.lit("[asset "), F.col("paper_id").cast("string"), F.lit("]")).alias("rendered"))
    return P.evaluation_context(blocks, assets).select("paper_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text"))


SQL["evaluation_texts"] = """
WITH b AS (SELECT *, max(CASE WHEN turn = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS has FROM conversations),
s AS (SELECT conv_id, turn, CASE WHEN has = 1 AND turn = 2 THEN concat('[asset ', conv_id, ']') ELSE text END AS t FROM b WHERE NOT (has = 1 AND turn = 3)),
g AS (SELECT conv_id, string_agg(t, chr(10) || chr(10) ORDER BY turn, t) AS t FROM s GROUP BY conv_id)
SELECT conv_id AS paper_id, length(t) AS n_chars, sha256(t) AS text FROM g
"""


def _components(spark: SparkSession, d: str) -> DataFrame:
    """A component per order and part: lit where it was returned or accepted, critical in quantity, a target on odd lines."""
    rows = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("task"), F.concat(F.lit("K"), F.col("l_partkey").cast("string")).alias("kc_id")).agg(
        F.max(F.when(F.col("l_returnflag") == "R", "lit").when(F.col("l_returnflag") == "A", "corrected").otherwise("dark")).alias("status"), F.when(F.max("l_quantity") > 25, "critical").otherwise("minor").alias("importance"), (F.max("l_linenumber") % 2 == 1).alias("is_target"), F.min("l_suppkey").alias("s"))
    return rows.withColumn("macro_id", F.concat(F.lit("M"), (F.col("s") % 3).cast("string"))).drop("s")


_PARTS = """
WITH c AS MATERIALIZED (
    SELECT l_orderkey AS task, 'K' || CAST(l_partkey AS VARCHAR) AS kc_id, max(CASE l_returnflag WHEN 'R' THEN 'lit' WHEN 'A' THEN 'corrected' ELSE 'dark' END) AS status, max(l_quantity) > 25 AS critical,
        max(l_linenumber) % 2 = 1 AS is_target, 'M' || CAST(min(l_suppkey) % 3 AS VARCHAR) AS macro_id
    FROM lineitem GROUP BY 1, 2
), x AS MATERIALIZED (SELECT *, status IN ('lit', 'corrected') AS lit FROM c)
"""
_RATE = "CASE WHEN ({b}) > 0 THEN round(CAST({a} AS DOUBLE) / ({b}), 4) ELSE 0.0 END"


def report_coverage(spark: SparkSession, d: str) -> DataFrame:
    return R.coverage(_components(spark, d), ["task"])


_N = "count(*) FILTER (WHERE {})"
SQL["report_coverage"] = f"""{_PARTS}
SELECT task, {", ".join(f"{_N.format(c)} AS {g}_kc_total, {_N.format(f'{c} AND lit')} AS {g}_kc_lit_count, {_RATE.format(a=_N.format(f'{c} AND lit'), b=_N.format(c))} AS {g}_kc_coverage_rate" for g, c in (("global", "true"), ("target", "is_target"), ("critical", "critical")))} FROM x GROUP BY task
"""


def _macros(spark: SparkSession, d: str) -> DataFrame:
    rows = _components(spark, d)
    return rows.groupBy("task", "macro_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("is_target"), F.col("kc_id")))).alias("target_kc_ids"), F.array_sort(F.collect_set(F.when(F.col("status") == "lit", F.col("kc_id")))).alias("covered_kc_ids"),
        (F.count(F.lit(1)) + 2).alias("bank_count"), F.count(F.lit(1)).alias("active_count"), F.max(F.col("importance") == "critical").alias("asked"))


def report_macros(spark: SparkSession, d: str) -> DataFrame:
    """The groups on macros and on the bank of every report, in one row."""
    macros, components = _macros(spark, d), _components(spark, d)
    return R.report([R.macro_metrics(macros, components, ["task"]), R.bank_metrics(macros, components, ["task"])], ["task"])


SQL["report_macros"] = f"""{_PARTS},
m AS (SELECT task, macro_id, count(*) AS n, count(*) FILTER (WHERE is_target) AS t, count(*) FILTER (WHERE is_target AND lit) AS l, count(*) FILTER (WHERE status = 'lit') AS v, max(CASE WHEN critical THEN 1 ELSE 0 END) AS asked FROM x GROUP BY 1, 2),
g AS (SELECT task, count(*) AS macros, sum(asked) AS asked, count(*) FILTER (WHERE t > 0 AND t = l) AS done, avg(CASE WHEN t > 0 THEN least(1.0, CAST(l AS DOUBLE) / t) ELSE least(1.0, CAST(v AS DOUBLE) / n) END) AS mean, sum(n + 2) AS bank FROM m GROUP BY 1),
k AS (SELECT task, count(*) FILTER (WHERE is_target) AS active, count(*) FILTER (WHERE is_target AND lit) AS lit FROM x GROUP BY 1)
SELECT g.task, macros AS macro_total, {_RATE.format(a="asked", b="macros")} AS macro_main_question_asked_rate, {_RATE.format(a="done", b="macros")} AS macro_completion_rate, round(mean, 4) AS average_active_kc_coverage_per_macro,
    CAST(bank AS BIGINT) AS kc_bank_total, active AS active_kc_total, {_RATE.format(a="lit", b="active")} AS active_kc_coverage_rate, {_RATE.format(a="active", b="bank")} AS active_to_bank_ratio
FROM g JOIN k ON g.task = k.task
"""


def report_threads(spark: SparkSession, d: str) -> DataFrame:
    """Orders of a customer as threads: done, successful, and consistent where reviewed."""
    status = F.when(F.col("o_orderstatus") == "F", "completed_success").when(F.col("o_orderstatus") == "O", "reviewed_inconsistent").otherwise("open")
    rows = _t(spark, d, "orders").select(F.col("o_custkey").alias("task"), F.col("o_orderkey").alias("thread_id"), status.alias("status"), F.when(F.col("o_orderkey") % 4 == 0, True).alias("success"), F.when(F.col("o_orderkey") % 3 < 2, F.col("o_orderkey") % 3 == 0).alias("consistent"))
    return R.thread_metrics(rows, ["task"])


SQL["report_threads"] = f"""
SELECT o_custkey AS task, count(*) AS thread_total, {_RATE.format(a="count(*) FILTER (WHERE o_orderstatus IN ('F', 'O'))", b="count(*)")} AS thread_completion_rate,
    {_RATE.format(a="count(*) FILTER (WHERE o_orderstatus = 'F' OR o_orderkey % 4 = 0)", b="count(*)")} AS thread_success_rate,
    {_RATE.format(a="count(*) FILTER (WHERE o_orderkey % 3 = 0)", b="count(*) FILTER (WHERE o_orderkey % 3 < 2)")} AS thread_review_consistency_rate
FROM orders GROUP BY o_custkey
"""


def _told(name: str):
    return F.array_join(F.transform(F.array_sort(F.map_entries(name)), lambda x: F.concat_ws("=", x["key"], x["value"].cast("string"))), ",").alias(name)


def report_tasks(spark: SparkSession, d: str) -> DataFrame:
    """Orders as tasks and as coverage gaps of their customer: counts, rates, and counts by status and type."""
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "exhausted")
    tasks = _t(spark, d, "orders").select(F.col("o_custkey").alias("task"), status.alias("status"), F.col("o_orderpriority").alias("task_type"))
    gaps = tasks.select("task", F.when(F.col("status") == "completed", "resolved").otherwise(F.col("status")).alias("status"))
    rows = R.report([R.task_metrics(tasks, ["task"]), R.gap_metrics(gaps, ["task"])], ["task"])
    return rows.select(*[_told(c) if "_by_" in c else c for c in rows.columns])


def _map(name: str, label: str) -> str:
    return f"(SELECT string_agg(concat(k, '=', n), ',' ORDER BY k) FROM (SELECT {label} AS k, count(*) AS n FROM orders i WHERE i.o_custkey = o.o_custkey GROUP BY 1)) AS {name}"


_F, _X = "count(*) FILTER (WHERE o_orderstatus = 'F')", "count(*) FILTER (WHERE o_orderstatus = 'O')"
SQL["report_tasks"] = f"""
SELECT o_custkey AS task, count(*) AS stage_task_count, {_F} AS stage_task_completed_count, {_X} AS stage_task_exhausted_count, {_map("stage_task_by_type", "o_orderpriority")},
    {_map("stage_task_by_status", "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'exhausted' ELSE 'unknown' END")}, count(*) AS coverage_gap_count, {_F} AS coverage_gap_resolved_count, {_X} AS coverage_gap_exhausted_count,
    {_RATE.format(a=_F, b="count(*)")} AS detail_completion_rate, {_RATE.format(a=_X, b="count(*)")} AS detail_exhaustion_rate, {_map("coverage_gap_by_status", "CASE o_orderstatus WHEN 'F' THEN 'resolved' WHEN 'O' THEN 'exhausted' ELSE 'unknown' END")}
FROM orders o GROUP BY o_custkey
"""


def report_claims(spark: SparkSession, d: str) -> DataFrame:
    """Lines as verified claims of their order, and the means of all numbers over the orders of a line status."""
    label = F.when(F.col("l_returnflag") == "R", "CONTRADICTED").when(F.col("l_returnflag") == "A", "SUPPORTED").when(F.col("l_quantity") > 25, "OVERCLAIM").otherwise("NOT_ENOUGH_INFO")
    rows = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("task"), label.alias("label"), F.array(F.concat(F.lit("K"), F.col("l_suppkey").cast("string")), F.lit("K0")).alias("kc_ids"))
    found = R.claim_metrics(rows, ["task"]).withColumn("part", F.col("task") % 10)
    return R.means(found.drop("task"), ["part"]).select("part", *[F.round(c, 9).alias(c) for c in ("verified_claim_count", "contradicted_claim_count", "overclaim_count", "not_enough_info_count", "supported_kc_count", "supported_claim_rate")])


SQL["report_claims"] = f"""
WITH c AS (SELECT l_orderkey AS task, l_suppkey, CASE WHEN l_returnflag = 'R' THEN 'C' WHEN l_returnflag = 'A' THEN 'S' WHEN l_quantity > 25 THEN 'O' ELSE 'N' END AS l FROM lineitem),
g AS (
    SELECT task, count(*) AS n, count(*) FILTER (WHERE l = 'S') AS s, count(*) FILTER (WHERE l = 'C') AS c, count(*) FILTER (WHERE l = 'O') AS o, count(*) FILTER (WHERE l = 'N') AS i,
        count(DISTINCT CASE WHEN l = 'S' AND l_suppkey <> 0 THEN l_suppkey END) + max(CASE WHEN l = 'S' THEN 1 ELSE 0 END) AS k FROM c GROUP BY task
)
SELECT task % 10 AS part, round(avg(n), 9) AS verified_claim_count, round(avg(c), 9) AS contradicted_claim_count, round(avg(o), 9) AS overclaim_count, round(avg(i), 9) AS not_enough_info_count, round(avg(k), 9) AS supported_kc_count,
    round(avg(round(CAST(s AS DOUBLE) / n, 4)), 9) AS supported_claim_rate
FROM g GROUP BY 1
"""


def report_corrections(spark: SparkSession, d: str) -> DataFrame:
    """Corrections over the components of a user's events: opened by an error, closed by the next purchase."""
    from quarry.plans.states import _marked

    rows = _marked(spark, d)
    order = rows.groupBy("user_id", "ts", "event_id").agg(F.collect_list(F.struct("kc_id", "mark")).alias("m")).withColumn("turn", F.col("event_id"))
    return R.correction_metrics(order.select("user_id", "turn", F.inline("m")), ["user_id"], "turn")


SQL["report_corrections"] = """
WITH m AS (
    SELECT user_id, event_id AS turn, CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS kc, CASE event_type WHEN 'error' THEN 'bad' ELSE 'covered' END AS mark FROM events WHERE event_type IN ('error', 'purchase')
), e AS (SELECT *, coalesce(count(*) FILTER (WHERE mark = 'covered') OVER (PARTITION BY user_id, kc ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ep FROM m),
g AS (SELECT user_id, kc, ep, min(CASE WHEN mark = 'bad' THEN turn END) AS o, min(CASE WHEN mark = 'covered' THEN turn END) AS f FROM e GROUP BY 1, 2, 3)
SELECT user_id, CASE WHEN count(o) > 0 THEN round(CAST(count(*) FILTER (WHERE f > o) AS DOUBLE) / count(o), 4) ELSE 0.0 END AS self_correction_rate, round(coalesce(avg(f - o) FILTER (WHERE f > o), 0.0), 4) AS average_correction_turns FROM g GROUP BY user_id
"""


def merged_routes(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers of a customer's first and last order merged into one sequence, and why a loop over them would stop."""
    rows = _t(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("a"), F.max("o_orderkey").alias("b"), F.count(F.lit(1)).alias("n"))
    made = lambda x: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (F.col(x) * (i + 1)) % 7)
    rows = rows.withColumns({"x": made("a"), "y": made("b")})
    merged = merged_sequences("x", "y")
    return rows.select("o_custkey", F.array_join(merged.cast("array<string>"), ",").alias("merged"), stop_reason(merged, F.col("x"), F.when(F.col("n") % 2 == 0, F.col("y")).otherwise(F.array().cast("array<bigint>"))).alias("stop"))


SQL["merged_routes"] = """
WITH o AS (SELECT o_custkey, min(o_orderkey) AS a, max(o_orderkey) AS b, count(*) AS n FROM orders GROUP BY 1),
s AS (SELECT *, list_transform(range(0, 4), lambda i: (a * (i + 1)) % 7) AS x, list_transform(range(0, 4), lambda i: (b * (i + 1)) % 7) AS y FROM o),
m AS (SELECT *, list_concat(x, y) AS z FROM s),
u AS (SELECT *, list_filter(z, lambda v, i: list_position(z, v) = i) AS merged FROM m)
SELECT o_custkey, array_to_string(merged, ',') AS merged, CASE WHEN n % 2 = 0 OR len(list_filter(y, lambda v: NOT list_contains(x, v))) = 0 THEN 'pool_exhausted' END AS stop FROM u
"""
