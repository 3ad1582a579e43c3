"""Queries for selection, sets, similarity and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import claim_key, claim_tokens, nfkc
from quarry.operators import graph as G
from quarry.operators import selection as X
from quarry.operators import similarity as D

SQL: dict[str, str] = {}


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def active_selection(spark: SparkSession, d: str) -> DataFrame:
    part = _t(spark, d, "part")
    most = part.agg(F.max("p_retailprice").alias("most"))
    scored = part.crossJoin(F.broadcast(most)).select("p_partkey", "p_brand", F.round(F.col("p_retailprice") / F.col("most"), 9).alias("score"))
    return X.active(scored, "p_brand", "score", ["p_partkey"], 0.65, 2, 60)


SQL["active_selection"] = """
WITH s AS (SELECT p_partkey, p_brand, round(p_retailprice / (SELECT max(p_retailprice) FROM part), 9) AS score FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, p_partkey) AS k FROM s),
c AS (SELECT *, k <= 2 AS locked FROM r WHERE score >= 0.65 OR k <= 2),
o AS (SELECT *, row_number() OVER (ORDER BY locked DESC, score DESC, p_partkey) AS place, count(*) FILTER (WHERE locked) OVER () AS n FROM c)
SELECT p_partkey, p_brand, score, CASE WHEN score >= 0.65 THEN 'threshold' ELSE 'minimum' END AS chosen_by FROM o WHERE locked OR place <= 60
"""


def natural_sort(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "supplier").select(F.col("s_name").alias("name")).union(_t(spark, d, "customer").select("c_name")).union(_t(spark, d, "nation").select("n_name"))
    return rows.select("name", X.trailing_number(F.col("name")).alias("trailing"), X.all_digits(F.concat(F.col("name"), F.lit("_7"))).alias("digits"))


SQL["natural_sort"] = """
WITH n AS (SELECT s_name AS name FROM supplier UNION ALL SELECT c_name FROM customer UNION ALL SELECT n_name FROM nation)
SELECT name, CAST(coalesce(try_cast(regexp_extract(name, '([0-9]+)$', 1) AS BIGINT), 1000000000) AS BIGINT) AS trailing,
    CAST(coalesce(try_cast(regexp_replace(name || '_7', '[^0-9]', '', 'g') AS BIGINT), 10000) AS BIGINT) AS digits FROM n
"""


def exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "documents").select("doc_id", claim_key(nfkc(F.col("text"))).alias("claim"))
    found = D.classes(rows, "doc_id", "claim").filter("n > 1")
    return found.select(F.col("rep").alias("first_id"), "n", "sha")


SQL["exact_duplicates"] = """
WITH t AS (SELECT doc_id, array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') AS claim FROM documents)
SELECT min(doc_id) AS first_id, count(*) AS n, sha256(claim) AS sha FROM t WHERE claim <> '' GROUP BY claim HAVING count(*) > 1
"""


def _claims(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", "lang", claim_tokens(nfkc(F.col("text"))).alias("tokens"))


def near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Pairs between representatives of equal texts; exact_duplicates has the members."""
    pairs = D.similar_pairs(_claims(spark, d), "doc_id", "tokens", ["lang"], 0.92, 5, once=True)
    return pairs.select("lang", "a", "b", F.round("jaccard", 9).alias("jaccard"))


SQL["near_duplicates"] = """
WITH t AS (SELECT doc_id, lang, array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') AS claim FROM documents),
r AS (SELECT lang, min(doc_id) AS id, claim FROM t WHERE claim <> '' GROUP BY lang, claim),
w AS (SELECT DISTINCT lang, id, unnest(string_split(claim, ' ')) AS token FROM r),
n AS (SELECT id, count(*) AS n FROM w GROUP BY id HAVING count(*) >= 5),
p AS (SELECT a.lang, a.id AS a, b.id AS b, count(*) AS shared FROM w a JOIN w b ON a.lang = b.lang AND a.token = b.token AND a.id < b.id GROUP BY a.lang, a.id, b.id)
SELECT p.lang, p.a, p.b, round(CAST(shared AS DOUBLE) / (x.n + y.n - shared), 9) AS jaccard
FROM p JOIN n x ON p.a = x.id JOIN n y ON p.b = y.id WHERE CAST(shared AS DOUBLE) / (x.n + y.n - shared) >= 0.92
"""


def duplicate_components(spark: SparkSession, d: str) -> DataFrame:
    return D.duplicate_groups(_claims(spark, d), "doc_id", "tokens", ["lang"])


SQL["duplicate_components"] = """
WITH RECURSIVE t AS (SELECT doc_id, lang, array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') AS claim FROM documents),
m AS (SELECT doc_id, lang, claim, min(doc_id) OVER (PARTITION BY claim) AS rep FROM t WHERE claim <> ''),
r AS (SELECT DISTINCT lang, rep, claim FROM m),
w AS (SELECT DISTINCT lang, rep, unnest(string_split(claim, ' ')) AS token FROM r),
n AS (SELECT lang, rep, count(*) AS n FROM w GROUP BY lang, rep HAVING count(*) >= 5),
p AS (SELECT a.lang, a.rep AS a, b.rep AS b, count(*) AS shared FROM w a JOIN w b ON a.lang = b.lang AND a.token = b.token AND a.rep < b.rep GROUP BY a.lang, a.rep, b.rep),
e AS (SELECT DISTINCT p.a, p.b FROM p JOIN n x ON p.a = x.rep AND p.lang = x.lang JOIN n y ON p.b = y.rep AND p.lang = y.lang WHERE CAST(shared AS DOUBLE) / (x.n + y.n - shared) >= 0.92),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT DISTINCT rep AS x, rep AS y FROM r UNION SELECT reach.x, s.b FROM reach JOIN s ON reach.y = s.a),
root AS (SELECT x, min(y) AS root FROM reach GROUP BY x),
g AS (SELECT m.doc_id, m.claim, root.root AS group_id FROM m JOIN root ON m.rep = root.x),
z AS (SELECT group_id, count(*) AS n_members, CASE WHEN count(DISTINCT claim) > 1 THEN 'near' ELSE 'exact' END AS kind FROM g GROUP BY group_id HAVING count(*) > 1)
SELECT g.doc_id, g.group_id, z.n_members, z.kind FROM g JOIN z ON g.group_id = z.group_id
"""


def composite_dedupe(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_quantity")
    return X.first_per_key(rows, ["l_partkey", "l_suppkey"], ["l_orderkey", "l_linenumber"])


SQL["composite_dedupe"] = """
SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber) AS k FROM lineitem) WHERE k = 1
"""


def semi_anti(spark: SparkSession, d: str) -> DataFrame:
    customers = _t(spark, d, "customer").select(F.col("c_custkey").alias("key"))
    orders = _t(spark, d, "orders")
    none = X.without(customers, orders.select(F.col("o_custkey").alias("key")), ["key"]).select("key", F.lit("no_orders").alias("kind"))
    urgent, open_ = (orders.filter(c).select(F.col("o_custkey").alias("key")) for c in ("o_orderpriority = '1-URGENT'", "o_orderstatus = 'O'"))
    return none.unionByName(X.within(X.within(customers, urgent, ["key"]), open_, ["key"]).select("key", F.lit("both").alias("kind")))


SQL["semi_anti"] = """
SELECT c_custkey AS key, 'no_orders' AS kind FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)
UNION ALL SELECT c_custkey, 'both' FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')
"""


def uncovered_keys(spark: SparkSession, d: str) -> DataFrame:
    parts = _t(spark, d, "part").select("p_partkey")
    returned = _t(spark, d, "lineitem").filter("l_returnflag = 'R' and l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    large = _t(spark, d, "lineitem").filter("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return X.uncovered(parts, returned, large, key="p_partkey")


SQL["uncovered_keys"] = "SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45 EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 49"


def review_split(spark: SparkSession, d: str) -> DataFrame:
    trials = _t(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.max((F.col("l_returnflag") == "R").cast("int")).alias("wrong"))
    per = trials.groupBy("l_partkey").agg(F.sum("wrong").alias("n_wrong"), F.count(F.lit(1)).alias("n_solvers"))
    return per.withColumn("decision", X.review(F.col("n_wrong"), F.col("n_solvers")))


SQL["review_split"] = """
WITH t AS (SELECT l_partkey, l_suppkey, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS wrong FROM lineitem GROUP BY l_partkey, l_suppkey),
p AS (SELECT l_partkey, CAST(sum(wrong) AS BIGINT) AS n_wrong, count(*) AS n_solvers FROM t GROUP BY l_partkey)
SELECT *, CASE WHEN n_wrong = 0 THEN 'reject' WHEN n_wrong = n_solvers THEN 'human_review' ELSE 'keep' END AS decision FROM p
"""


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    """The five most similar vectors of every vector whose id is divisible by 100, among all others."""
    found = D.retrieve(_t(spark, d, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 100 == 0, 5)
    return found.select("query_id", "item_id", F.round("similarity", 6).alias("similarity"), "rank")


SQL["vector_topk"] = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, i.vec_id AS item_id, list_cosine_similarity(q.e, i.e) AS s FROM v q, v i WHERE q.vec_id % 100 = 0 AND i.vec_id <> q.vec_id)
SELECT query_id, item_id, round(s, 6) AS similarity, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, item_id) AS INTEGER) AS rank FROM s) WHERE rank <= 5
"""


def vector_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """For every vector whose id is divisible by 100 the three most similar of those of label 1, as a search in another set."""
    rows = _t(spark, d, "embeddings").select("vec_id", "embedding", "label")
    found = D.retrieve(rows, "vec_id", "embedding", F.col("vec_id") % 100 == 0, 3, items=rows.filter("label = 1"))
    return found.select("query_id", "item_id", F.round("similarity", 6).alias("similarity"), "rank")


SQL["vector_retrieval"] = """
WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, i.vec_id AS item_id, list_cosine_similarity(q.e, i.e) AS s FROM v q, v i WHERE q.vec_id % 100 = 0 AND i.label = 1)
SELECT query_id, item_id, round(s, 6) AS similarity, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, item_id) AS INTEGER) AS rank FROM s) WHERE rank <= 3
"""


def evidence_quality(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    a, b = rows.filter("vec_id % 2 = 0").select("vec_id", F.col("e").alias("a")), rows.filter("vec_id % 2 = 1").select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("b"))
    return a.join(b, "vec_id").select("vec_id", D.evidence_quality(F.round(D.cosine(F.col("a"), F.col("b")), 9)).alias("quality"))


SQL["evidence_quality"] = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
SELECT a.vec_id, round(greatest(0.0, least(1.0, (round(list_cosine_similarity(a.e, b.e), 9) - 0.45) / 0.40)), 4) AS quality FROM v a JOIN v b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0
"""


def _trade(spark: SparkSession, d: str) -> DataFrame:
    """Edges from the customer's nation to the supplier's, one per line item, counted before any join that could be done later."""
    lines = _t(spark, d, "lineitem").select("l_orderkey", "l_suppkey").join(_t(spark, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    buyers = _t(spark, d, "orders").select("o_orderkey", "o_custkey").join(_t(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return lines.join(buyers, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("c_nationkey").alias("source"), F.col("s_nationkey").alias("target")).agg(F.count(F.lit(1)).alias("n"))


_TRADE = "SELECT c_nationkey AS source, s_nationkey AS target, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2"
#: A pair of nations trades heavily with this many times the lines of an average pair.
HEAVY = 1.2


def _heavy(edges: DataFrame, times: float) -> DataFrame:
    """Edges of `times` the average count or more, whatever the size of the table."""
    mean = edges.agg(F.avg("n").alias("_mean"))  # one row
    return edges.crossJoin(F.broadcast(mean)).filter(F.col("n") >= times * F.col("_mean")).drop("_mean")


def degree_centrality(spark: SparkSession, d: str) -> DataFrame:
    edges = _trade(spark, d)
    rows = G.centrality(_t(spark, d, "nation").select("n_nationkey"), edges, "n_nationkey", "source", "target")
    return rows.select("n_nationkey", "degree", *[F.round(c, 9).alias(c) for c in ("log_degree", "entropy", "centrality")])


SQL["degree_centrality"] = f"""
WITH e AS ({_TRADE}),
b AS (SELECT source AS k, target AS m FROM e UNION ALL SELECT target, source FROM e),
c AS (SELECT k, m, count(*) AS n FROM b GROUP BY k, m),
d AS (SELECT k, sum(n) AS degree, (ln(sum(n)) - sum(n * ln(n)) / sum(n)) / ln((SELECT count(*) FROM nation)) AS entropy FROM c GROUP BY k),
f AS (SELECT n_nationkey, coalesce(degree, 0) AS degree, coalesce(entropy, 0.0) AS entropy, coalesce(ln(1 + coalesce(degree, 0)) / nullif(ln(1 + (SELECT max(degree) FROM d)), 0), 0.0) AS log_degree FROM nation LEFT JOIN d ON n_nationkey = k)
SELECT n_nationkey, CAST(degree AS BIGINT) AS degree, round(log_degree, 9) AS log_degree, round(entropy, 9) AS entropy, round(0.7 * log_degree + 0.3 * entropy, 9) AS centrality FROM f
"""


def kc_connectivity(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as nodes, their nations as categories; those that deliver the same part are neighbours."""
    nodes = _t(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    sold = _t(spark, d, "lineitem").filter("l_partkey is not null").groupBy("l_partkey").agg(F.collect_set("l_suppkey").alias("by"))  # some dozens deliver a part
    rows = G.group_connectivity(nodes, sold, "by", "s_suppkey", "s_nationkey")
    return rows.select("s_suppkey", "degree", *[F.round(c, 9).alias(c) for c in ("log_degree", "entropy", "connectivity")])


SQL["kc_connectivity"] = """
WITH l AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem),
b AS (SELECT DISTINCT x.l_suppkey AS k, y.l_suppkey AS m FROM l x JOIN l y ON x.l_partkey = y.l_partkey AND x.l_suppkey <> y.l_suppkey),
c AS (SELECT k, s_nationkey AS r, count(*) AS n FROM b JOIN supplier ON m = s_suppkey GROUP BY 1, 2),
d AS (SELECT k, sum(n) AS degree, (ln(sum(n)) - sum(n * ln(n)) / sum(n)) / ln((SELECT count(DISTINCT s_nationkey) FROM supplier)) AS entropy FROM c GROUP BY k),
f AS (SELECT s_suppkey, coalesce(degree, 0) AS degree, coalesce(entropy, 0.0) AS entropy, coalesce(ln(1 + coalesce(degree, 0)) / nullif(ln(1 + (SELECT max(degree) FROM d)), 0), 0.0) AS log_degree FROM supplier LEFT JOIN d ON s_suppkey = k)
SELECT s_suppkey, CAST(degree AS BIGINT) AS degree, round(log_degree, 9) AS log_degree, round(entropy, 9) AS entropy, round(0.7 * log_degree + 0.3 * entropy, 9) AS connectivity FROM f
"""


def two_hop_paths(spark: SparkSession, d: str) -> DataFrame:
    edges = _heavy(_trade(spark, d), HEAVY).withColumn("edge", F.col("source") * 100 + F.col("target"))
    return G.two_hop_paths(edges, _t(spark, d, "nation"), "edge", "source", "target", "n_nationkey", "n_regionkey")


SQL["two_hop_paths"] = f"""
WITH t AS ({_TRADE}), e AS (SELECT source, target, source * 100 + target AS edge FROM t WHERE n >= {HEAVY} * (SELECT avg(n) FROM t))
SELECT x.source AS a, x.target AS b, y.target AS c, x.edge AS first_edge, y.edge AS second_edge, concat_ws(' > ', p.n_regionkey, q.n_regionkey, r.n_regionkey) AS pattern
FROM e x JOIN e y ON x.target = y.source JOIN nation p ON p.n_nationkey = x.source JOIN nation q ON q.n_nationkey = x.target JOIN nation r ON r.n_nationkey = y.target
WHERE x.source <> x.target AND x.target <> y.target AND x.source <> y.target AND NOT (p.n_regionkey = q.n_regionkey AND q.n_regionkey = r.n_regionkey)
"""


def edge_coverage(spark: SparkSession, d: str) -> DataFrame:
    nodes = _t(spark, d, "nation").select("n_nationkey", "n_regionkey")
    edges = G.with_endpoints(_trade(spark, d).drop("n"), nodes, "source", "target", "n_nationkey", "n_regionkey")
    return G.pair_coverage(edges, _t(spark, d, "region"), "r_regionkey")


SQL["edge_coverage"] = f"""
WITH t AS ({_TRADE}), e AS (SELECT p.n_regionkey AS s, q.n_regionkey AS t FROM t JOIN nation p ON p.n_nationkey = source JOIN nation q ON q.n_nationkey = target)
SELECT a.r_regionkey AS source_category, b.r_regionkey AS target_category, count(e.s) AS n FROM region a CROSS JOIN region b LEFT JOIN e ON e.s = a.r_regionkey AND e.t = b.r_regionkey GROUP BY 1, 2
"""


def isolated_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Customers without an order over 450,000, as nodes without an edge, and nations without heavy trade of half more than the average."""
    nations = G.isolated(_t(spark, d, "nation").select("n_nationkey"), _heavy(_trade(spark, d), 1.5), "n_nationkey", "source", "target").select(F.lit("nation").alias("kind"), F.col("n_nationkey").cast("long").alias("node"))
    bought = _t(spark, d, "orders").filter("o_totalprice > 450000").select(F.col("o_custkey").alias("source"), (F.col("o_orderkey") + 10**12).alias("target"))
    customers = G.isolated(_t(spark, d, "customer").select("c_custkey"), bought, "c_custkey", "source", "target").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("node"))
    return nations.unionByName(customers)


SQL["isolated_nodes"] = f"""
WITH t AS ({_TRADE}), h AS (SELECT * FROM t WHERE n >= 1.5 * (SELECT avg(n) FROM t))
SELECT 'nation' AS kind, CAST(n_nationkey AS BIGINT) AS node FROM nation WHERE n_nationkey NOT IN (SELECT source FROM h) AND n_nationkey NOT IN (SELECT target FROM h)
UNION ALL SELECT 'customer', c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)
"""


def row_signature(spark: SparkSession, d: str) -> DataFrame:
    """Per source a digest over all its rows in order, by way of digests of a thousand ids, of a million and of a milliard, so no source is gathered whole."""
    rows = _t(spark, d, "documents").select("source", "doc_id", F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), F.coalesce("lang", F.lit("~")), F.coalesce("text", F.lit("~"))), 256).alias("sha"))
    listed = lambda x: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(x)), lambda y: y["sha"]), ","), 256)
    parts = rows.groupBy("source", F.floor(F.col("doc_id") / 1000).alias("part")).agg(F.count(F.lit(1)).alias("n"), listed(F.struct("doc_id", "sha")).alias("sha"))
    for _ in range(2):
        parts = parts.groupBy("source", F.floor(F.col("part") / 1000).alias("_part")).agg(F.sum("n").alias("n"), listed(F.struct("part", "sha")).alias("sha")).withColumnRenamed("_part", "part")
    return parts.groupBy("source").agg(F.sum("n").alias("n"), listed(F.struct("part", "sha")).alias("signature"))


SQL["row_signature"] = """
WITH r AS (SELECT source, doc_id, sha256(concat_ws('|', CAST(doc_id AS VARCHAR), coalesce(lang, '~'), coalesce(text, '~'))) AS sha FROM documents),
p AS (SELECT source, doc_id // 1000 AS part, count(*) AS n, sha256(string_agg(sha, ',' ORDER BY doc_id, sha)) AS sha FROM r GROUP BY 1, 2),
q AS (SELECT source, part // 1000 AS part, sum(n) AS n, sha256(string_agg(sha, ',' ORDER BY p.part, sha)) AS sha FROM p GROUP BY 1, 2),
z AS (SELECT source, part // 1000 AS part, sum(n) AS n, sha256(string_agg(sha, ',' ORDER BY q.part, sha)) AS sha FROM q GROUP BY 1, 2)
SELECT source, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(sha, ',' ORDER BY part, sha)) AS signature FROM z GROUP BY source
"""
