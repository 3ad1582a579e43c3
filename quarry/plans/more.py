"""Queries for sequential fills, quotas, relations of threads, grouping sets and normal forms of claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import claim_key, nfkc
from quarry.operators import fills, planning, reports

SQL: dict[str, str] = {}


def fill_in_turn(spark: SparkSession, d: str) -> DataFrame:
    """Views and purchases of each user take the nearest signup, or what the rows before them took."""
    rows = spark.read.parquet(f"{d}/events.parquet").select("user_id", "ts", "event_id", "event_type", F.when(F.col("event_type") == "signup", F.col("event_id")).alias("known"))
    return fills.nearest_fill_in_turn(rows, ["user_id"], ["ts", "event_id"], "known", F.col("event_type").isin("view", "purchase"), 5).select("user_id", "event_id", "filled")


SQL["fill_in_turn"] = """
WITH RECURSIVE r AS (
    SELECT user_id, event_id, row_number() OVER w AS p, CASE WHEN event_type = 'signup' THEN event_id END AS v, event_type IN ('view', 'purchase') AS wanted,
        [lead(CASE WHEN event_type = 'signup' THEN event_id END, 1) OVER w, lead(CASE WHEN event_type = 'signup' THEN event_id END, 2) OVER w, lead(CASE WHEN event_type = 'signup' THEN event_id END, 3) OVER w,
            lead(CASE WHEN event_type = 'signup' THEN event_id END, 4) OVER w, lead(CASE WHEN event_type = 'signup' THEN event_id END, 5) OVER w] AS a
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
), f AS (
    SELECT user_id, event_id, p, coalesce(v, CASE WHEN wanted THEN coalesce(a[1], a[2], a[3], a[4], a[5]) END) AS filled, CAST([] AS BIGINT[]) AS b FROM r WHERE p = 1
    UNION ALL
    SELECT r.user_id, r.event_id, r.p, coalesce(r.v, CASE WHEN r.wanted THEN coalesce(n[1], r.a[1], n[2], r.a[2], n[3], r.a[3], n[4], r.a[4], n[5], r.a[5]) END), n
    FROM (SELECT user_id, p, list_prepend(filled, b)[1:5] AS n FROM f) f JOIN r ON r.user_id = f.user_id AND r.p = f.p + 1
)
SELECT user_id, event_id, filled FROM f
"""


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Parts as nodes; an edge between the parts of lines that follow each other in an order, in the brand of the first."""
    parts = spark.read.parquet(f"{d}/part.parquet").select("p_brand", F.col("p_partkey").cast("string").alias("kc_id"), "p_retailprice", "p_type", "p_size")
    lines = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.col("l_partkey").cast("string").alias("k"))
    a, b = lines.groupBy("l_orderkey", "l_linenumber").agg(F.min("k").alias("source")), lines.groupBy("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber")).agg(F.max("k").alias("target"))
    edges = a.join(b, ["l_orderkey", "l_linenumber"]).filter("source <> target").select(F.format_string("E%d", F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("edge_id"), "source", "target", "l_orderkey")
    return parts, edges.join(parts.select(F.col("kc_id").alias("source"), "p_brand"), "source")


_GRAPH_SQL = """
n AS (SELECT p_brand, CAST(p_partkey AS VARCHAR) AS kc_id, p_retailprice, p_type, p_size FROM part),
l AS (SELECT l_orderkey, l_linenumber, min(CAST(l_partkey AS VARCHAR)) AS lo, max(CAST(l_partkey AS VARCHAR)) AS hi FROM lineitem GROUP BY 1, 2),
e AS (
    SELECT p_brand, a.l_orderkey * 10 + a.l_linenumber AS no, 'E' || CAST(a.l_orderkey * 10 + a.l_linenumber AS VARCHAR) AS edge_id, a.lo AS source, b.hi AS target, a.l_orderkey
    FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 JOIN n ON n.kc_id = a.lo WHERE a.lo <> b.hi
)
"""


def quota_plans(spark: SparkSession, d: str) -> DataFrame:
    """Of each brand 40 plans: 8 economy parts first, then large parts by price, then edges that touch one."""
    parts, edges = _graph(spark, d)
    nodes = parts.filter("p_size >= 20")
    return planning.quota_first(nodes, edges.select("p_brand", "edge_id", "source", "target"), ["p_brand"], "kc_id", [F.desc("p_retailprice")], F.col("p_type") == "ECONOMY", 8, 40).select("p_brand", "place", "source", F.array_join("ids", ",").alias("ids"))


SQL["quota_plans"] = f"""
WITH {_GRAPH_SQL},
k AS (SELECT * FROM n WHERE p_size >= 20),
q AS (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type = 'ECONOMY' ORDER BY p_retailprice DESC, kc_id) AS spot FROM k),
x AS (
    SELECT p_brand, 0 AS tier, spot AS by_, 'quota' AS source, kc_id AS ids FROM q WHERE p_type = 'ECONOMY' AND spot <= 8
    UNION ALL SELECT p_brand, 1, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, kc_id), 'rank', kc_id FROM q WHERE NOT (p_type = 'ECONOMY' AND spot <= 8)
    UNION ALL SELECT p_brand, 2, no, 'edge', edge_id || ',' || source || ',' || target FROM e
        WHERE EXISTS (SELECT 1 FROM k WHERE k.p_brand = e.p_brand AND k.kc_id = e.source) OR EXISTS (SELECT 1 FROM k WHERE k.p_brand = e.p_brand AND k.kc_id = e.target)
)
SELECT p_brand, CAST(place AS INTEGER) AS place, source, ids FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY tier, by_) AS place FROM x) WHERE place <= 40
"""


def thread_relations(spark: SparkSession, d: str) -> DataFrame:
    """Orders as turns of their customers' threads, each resting on the edges between its lines; the first three of each brand and year."""
    parts, edges = _graph(spark, d)
    orders = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey", F.when(F.col("o_orderstatus") == "F", "bridge_reasoning").when(F.col("o_orderstatus") == "O", "review_consistency").otherwise("recap").alias("role"))
    named = edges.groupBy("l_orderkey", "p_brand").agg(F.reverse(F.array_sort(F.collect_list("edge_id"))).alias("supporting_edge_ids"))
    turns = named.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("p_brand", F.format_string("RT%d", "o_custkey").alias("thread_id"), F.format_string("T%d", "o_orderkey").alias("thread_turn_id"), "role", "supporting_edge_ids")
    live = parts.filter("p_size >= 10").select("p_brand", "kc_id")
    found = planning.thread_relation_plans(turns, edges.select("p_brand", "edge_id", "source", "target"), live, ["p_brand"], 30)
    return found.select("p_brand", "place", "thread_id", "thread_turn_id", F.array_join("edge_ids", ",").alias("edge_ids"), F.array_join("kc_ids", ",").alias("kc_ids"))


SQL["thread_relations"] = f"""
WITH {_GRAPH_SQL},
t AS (SELECT e.*, o_custkey, row_number() OVER (PARTITION BY p_brand, l_orderkey ORDER BY edge_id DESC) AS spot FROM e JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus IN ('F', 'O')),
u AS (SELECT p_brand, l_orderkey, min(2 * spot + side) AS first, kc FROM (SELECT *, source AS kc, 0 AS side FROM t UNION ALL SELECT *, target, 1 FROM t) x JOIN n USING (p_brand) WHERE kc = n.kc_id AND n.p_size >= 10 GROUP BY p_brand, l_orderkey, kc),
k AS (SELECT p_brand, l_orderkey, string_agg(kc, ',' ORDER BY first) AS kc_ids FROM u GROUP BY 1, 2 HAVING count(*) >= 2),
g AS (SELECT p_brand, l_orderkey, o_custkey, string_agg(edge_id, ',' ORDER BY spot) AS edge_ids FROM t GROUP BY ALL)
SELECT p_brand, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY o_custkey, l_orderkey) AS INTEGER) AS place, 'RT' || CAST(o_custkey AS VARCHAR) AS thread_id, 'T' || CAST(l_orderkey AS VARCHAR) AS thread_turn_id, edge_ids, kc_ids
FROM g JOIN k USING (p_brand, l_orderkey) QUALIFY place <= 30
"""


def challenge_breakdown(spark: SparkSession, d: str) -> DataFrame:
    """Each supplier's lines as challenges: by flag, status, tenth of discount, and flag and tenth, with what failed of each."""
    lines = spark.read.parquet(f"{d}/lineitem.parquet")
    tenth = F.floor(F.round(F.col("l_discount") * 100) / 4).cast("int")
    found = reports.challenge_breakdowns(lines, ["l_suppkey"], F.col("l_returnflag"), F.when(F.col("l_linestatus") == "O", "thread"), tenth, F.col("l_quantity") > 40)
    said = lambda c: F.array_join(F.array_sort(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))), ",")
    return found.select("l_suppkey", "n", "n_failed", "failure_rate", *[said(c).alias(c) for c in found.columns if c.startswith(("by_", "failed_by_"))])


def _counts_sql(name: str, label: str) -> str:
    return f"""{name} AS (
    SELECT s, string_agg(v || '=' || CAST(n AS VARCHAR), ',' ORDER BY v || '=' || CAST(n AS VARCHAR)) AS by_{name}, coalesce(string_agg(v || '=' || CAST(f AS VARCHAR), ',' ORDER BY v || '=' || CAST(f AS VARCHAR)) FILTER (WHERE f > 0), '') AS failed_by_{name}
    FROM (SELECT s, {label} AS v, count(*) AS n, count(*) FILTER (WHERE bad) AS f FROM l GROUP BY 1, 2) GROUP BY s
)"""


SQL["challenge_breakdown"] = f"""
WITH l AS (SELECT l_suppkey AS s, l_returnflag AS t, CASE WHEN l_linestatus = 'O' THEN 'thread' ELSE 'unknown' END AS c, CAST(CAST(floor(round(l_discount * 100) / 4) AS INTEGER) AS VARCHAR) AS m, l_quantity > 40 AS bad FROM lineitem),
{_counts_sql("type", "t")}, {_counts_sql("scope", "c")}, {_counts_sql("modality", "m")}, {_counts_sql("type_and_modality", "t || '|' || m")},
w AS (SELECT s, count(*) AS n, count(*) FILTER (WHERE bad) AS n_failed FROM l GROUP BY s)
SELECT s AS l_suppkey, n, n_failed, round(n_failed / n, 4) AS failure_rate, by_type, failed_by_type, by_scope, failed_by_scope, by_modality, failed_by_modality, by_type_and_modality, failed_by_type_and_modality
FROM w JOIN type USING (s) JOIN scope USING (s) JOIN modality USING (s) JOIN type_and_modality USING (s)
"""

_ASCII = "".join(map(chr, range(0x21, 0x7F)))
_WIDE = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F))


def wide_claims(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items and their full-width copies: equal once their compatible characters are."""
    items = spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", "text")
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    plain = items.select("item_id", claim_key(nfkc(F.col("text"))).alias("claim"), F.lit("item").alias("kind")).unionByName(docs.select(F.col("doc_id").alias("item_id"), claim_key(nfkc(F.col("text"))).alias("claim"), F.lit("document").alias("kind")))
    wide = items.select("item_id", claim_key(nfkc(F.translate("text", _ASCII, _WIDE))).alias("claim"), F.lit("wide item").alias("kind"))
    return plain.unionByName(wide).select("kind", "item_id", F.md5("claim").alias("claim_md5"))


SQL["wide_claims"] = """
WITH t AS (SELECT 'item' AS kind, item_id, text FROM benchmark UNION ALL SELECT 'wide item', item_id, text FROM benchmark UNION ALL SELECT 'document', doc_id, text FROM documents)
SELECT kind, item_id, md5(array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ')) AS claim_md5 FROM t
"""
