"""The registered queries of the corpus operators, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import ann, chat, clusters, decontaminate, langid, phrases, pieces, quality, secrets, sharding, simhash, topk, urls
from quarry.llm.common import written


def op1_balanced_shards(spark: SparkSession, d: str) -> DataFrame:
    placed = sharding.assign(spark.read.parquet(f"{d}/documents.parquet"), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def remainder(id: str, n: int) -> Column:
    return F.crc32(F.col(id).cast("string")) % n


def op2_language_id(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fit(docs.filter(remainder("doc_id", 4) != 2))
    held = docs.select("doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "text")
    return langid.identify(held, model).drop("text")


def op3_sentencepiece(spark: SparkSession, d: str) -> DataFrame:
    return pieces.encode(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")).drop("text")


def op4_exact_top_k(spark: SparkSession, d: str) -> DataFrame:
    vectors = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", topk.scaled(F.col("embedding")).alias("v"))
    return topk.search(vectors, "vec_id", "v", F.col("vec_id") % 20 == 0, k=20)


def op5_benchmark_decontamination(spark: SparkSession, d: str) -> DataFrame:
    postings = decontaminate.index(spark.read.parquet(f"{d}/documents.parquet"))
    found = decontaminate.judged(decontaminate.search(postings, spark.read.parquet(f"{d}/benchmark.parquet")))
    return found.select(F.col("id").cast("long").alias("doc_id"), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


#: The contract's rules.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op6_url_filter(spark: SparkSession, d: str) -> DataFrame:
    return urls.judge(spark.read.parquet(f"{d}/pages.parquet"), URL_RULES)


def op7_chat_format(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    rows = rows.unionByName(spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema))
    done = chat.formatted(chat.visited(rows.withColumn("parts", chat.text_parts(F.col("text")))))
    turns = F.transform("read", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n")))
    done = done.withColumns({"read": chat.read_back(), "learnt": chat.under_loss()})
    return done.select("conv_id", F.size("read").cast("long").alias("n_turns"), F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"), F.char_length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))


def op8_secret_scan(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "source")
    slim = written(secrets.with_candidates(docs).select(F.monotonically_increasing_id().alias("uid"), "doc_id", "source", "found"), "op8")
    per = secrets.digest(written(secrets.spans(slim), "op8-spans"))
    return slim.select("uid", "doc_id").join(per, "uid", "left").select(
        "doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in secrets.BASE],
        F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"),
    )  # fmt: skip


def op9_simhash_near_dedup(spark: SparkSession, d: str) -> DataFrame:
    prints = written(simhash.fingerprints(spark.read.parquet(f"{d}/documents.parquet")), "op9")
    found = simhash.near_duplicates(prints)
    return prints.join(found.select("fingerprint", "component_id"), "fingerprint").select(F.col("id").alias("doc_id"), simhash.as_hex().alias("fingerprint"), "component_id")


def op10_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    rows = written(quality.with_statistics(docs).select("doc_id", *quality.STATISTICS), "op10")
    labels = quality.agreed(spark.read.parquet(f"{d}/labels.parquet"))
    labelled = rows.filter(remainder("doc_id", 5) != 0).join(labels, rows["doc_id"] == labels["id"])
    ensemble = quality.fit(labelled)
    scored = rows.select("doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), quality.score(ensemble).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.3, 1).otherwise(0))


def op11_centroid_clustering(spark: SparkSession, d: str) -> DataFrame:
    done = clusters.fit(spark.read.parquet(f"{d}/embeddings.parquet"), "vec_id", "embedding", dim=64, k=8, rounds=10, by=1024, seed=3)
    return clusters.assigned(done).withColumnRenamed("id", "vec_id")


def op12_phrase_collocations(spark: SparkSession, d: str) -> DataFrame:
    return phrases.mine(spark.read.parquet(f"{d}/documents.parquet").select("lang", "text"), longest=4, least=30, most=2000)


def op13_nearest_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return ann.search(spark.read.parquet(f"{d}/embeddings.parquet"), "vec_id", "embedding", F.col("id") % 100 == 0, k=10)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


OP4_SQL = """
WITH v AS (
    SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
    FROM v q JOIN v c ON q.r <> c.r AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0
), t AS (SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM t WHERE rank <= 20
"""


def _op6_sql() -> str:
    """The rules, the graph, and the rounds of propagation one after another, as urls.judge makes them."""
    low = lambda x: f"translate({x}, '{urls.UPPER}', '{urls.LOWER}')"  # noqa: E731
    text = lambda p: "'" + p.replace("'", "''") + "'"  # noqa: E731
    ordered = sorted(URL_RULES, key=lambda r: -len(r[1] + r[2]))
    pick = lambda i: "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h + p if i else v}'" for v, h, p in ordered) + " ELSE NULL END"  # noqa: E731
    back = lambda i: f"SELECT kind, host, CAST(floor(({urls.TOTAL} - coalesce((SELECT sum(mass) FROM s{i} WHERE s{i}.kind = f.kind), 0)) * part) AS BIGINT) AS mass FROM f"  # noqa: E731
    rounds = ["s0 AS MATERIALIZED (SELECT '' AS kind, '' AS host, CAST(0 AS BIGINT) AS mass WHERE false)"]
    for i in range(urls.ROUNDS + 1):
        rounds.append(f"m{i} AS MATERIALIZED (SELECT kind, host, CAST(sum(mass) AS BIGINT) AS mass FROM (SELECT * FROM s{i} UNION ALL {back(i)}) GROUP BY kind, host)")
        if i < urls.ROUNDS:
            rounds.append(f"s{i + 1} AS MATERIALIZED (SELECT kind, \"to\" AS host, CAST(sum(CAST(floor({urls.DAMPING} * (mass * share)) AS BIGINT)) AS BIGINT) AS mass FROM w JOIN m{i} USING (kind, host) GROUP BY 1, 2)")
    return f"""
WITH p AS MATERIALIZED (
    SELECT page_id, coalesce(html, '') AS h, {low("regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1)")} AS host, regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages
),
r AS MATERIALIZED (SELECT page_id, host, path, {pick(1)} AS rule, {pick(0)} AS said FROM p),
hosts AS MATERIALIZED (SELECT host, count(*) AS pages FROM p WHERE host <> '' GROUP BY host),
x AS MATERIALIZED (
    SELECT host, list_distinct(list_transform(regexp_extract_all(h, {text(urls.LINK)}, 1), lambda y: {low("y")})) AS linked,
        list_distinct(list_transform(list_filter(regexp_extract_all(h, {text(urls.NAMED)}), lambda y: contains(y, '.') AND NOT regexp_matches(y, '[@/:]')), lambda y: trim({low("y")}, '.-_'))) AS named,
        len(list_filter(regexp_extract_all(h, {text(urls.ADDRESS)}, 1), lambda y: NOT regexp_matches(y, {text(urls.ELSEWHERE)}))) > 0 AS within
    FROM p WHERE host <> ''
),
j AS (
    SELECT host AS source, unnest(linked) AS target, 'link' AS how FROM x
    UNION ALL SELECT host, unnest(list_filter(named, lambda y: NOT list_contains(linked, y))), 'name' FROM x UNION ALL SELECT host, host, 'own' FROM x WHERE within
),
k AS MATERIALIZED (SELECT source, target, how, count(*) AS pages FROM j WHERE target <> '' AND (source <> target OR how = 'own') AND (how <> 'name' OR target IN (SELECT host FROM hosts)) GROUP BY ALL),
targets AS MATERIALIZED (SELECT target AS host, sum(pages) AS pages FROM k WHERE how = 'link' GROUP BY 1),
known AS (SELECT host, sum(pages) AS pages, string_split(host, '.') AS l FROM (SELECT * FROM hosts UNION ALL SELECT * FROM targets) GROUP BY host),
steps AS (
    SELECT pages, array_to_string(l[i:], '.') AS below, array_to_string(l[i + 1 :], '.') AS above
    FROM (SELECT pages, l, unnest(range(1, len(l))) AS i FROM known WHERE length(host) <= {urls.LONGEST} AND len(l) > 2 AND NOT list_contains(l, '') AND NOT regexp_matches(l[-1], '^[0-9]*$'))
),
up AS (SELECT below, above, sum(pages) AS pages FROM steps WHERE contains(above, '.') GROUP BY 1, 2),
links AS MATERIALIZED (
    SELECT source, target, CAST(sum(pages) AS BIGINT) AS pages
    FROM (SELECT source, target, pages FROM k UNION ALL SELECT below, above, pages FROM up UNION ALL SELECT above, below, pages FROM up) GROUP BY 1, 2
),
w AS MATERIALIZED (
    SELECT 'trust' AS kind, source AS host, target AS "to", pages / sum(pages) OVER (PARTITION BY source) AS share FROM links
    UNION ALL SELECT 'distrust', target, source, pages / sum(pages) OVER (PARTITION BY target) FROM links
),
given AS (
    SELECT host, said, 1 AS pages FROM r WHERE host <> '' AND rule IS NOT NULL
    UNION ALL SELECT host, {pick(0)}, pages FROM (SELECT *, '/' AS path FROM targets WHERE host NOT IN (SELECT host FROM hosts)) WHERE {pick(0)} IS NOT NULL
),
seeds AS (SELECT CASE said WHEN 'allow' THEN 'trust' ELSE 'distrust' END AS kind, host, sum(pages) AS n FROM given GROUP BY 1, 2),
f AS MATERIALIZED (SELECT kind, host, n / sum(n) OVER (PARTITION BY kind) AS part FROM seeds),
{", ".join(rounds)},
masses AS (
    SELECT host, CAST(sum(CASE kind WHEN 'trust' THEN mass ELSE 0 END) AS BIGINT) AS trust, CAST(sum(CASE kind WHEN 'distrust' THEN mass ELSE 0 END) AS BIGINT) AS distrust FROM m{urls.ROUNDS} GROUP BY host
),
judged AS (SELECT host, trust, distrust, distrust > trust AS bad FROM hosts JOIN masses USING (host))
SELECT page_id, r.host, path, rule, CASE WHEN rule IS NOT NULL THEN said WHEN bad THEN 'block' ELSE 'allow' END AS verdict, coalesce(trust, 0) AS trust, coalesce(distrust, 0) AS distrust
FROM r LEFT JOIN judged ON r.host = judged.host
"""


OP6_SQL = _op6_sql()


OP7_SQL = r"""
WITH c AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
    SELECT *, length(text) + length(role) + 4 * (length(text) - length(replace(text, '&', '')) + length(role) - length(replace(role, '&', '')))
        + 3 * (length(text) - length(replace(replace(text, '<', ''), '>', '')) + length(role) - length(replace(replace(role, '<', ''), '>', ''))) + 15 AS n
    FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
    sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
    CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP5_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
s AS (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM i WHERE len(w) > 0),
g AS (SELECT DISTINCT item_id, n, array_to_string(w[p : p + n - 1], ' ') AS gram FROM s),
l AS (SELECT DISTINCT n FROM g),
q AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, l WHERE len(w) >= n),
h AS (SELECT q.r, q.p, q.n, g.item_id FROM q JOIN g ON q.n = g.n AND array_to_string(q.w[q.p : q.p + q.n - 1], ' ') = g.gram),
c AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS x FROM h) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS names FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS k FROM h WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c ON d.r = c.r LEFT JOIN t ON d.r = t.r
"""


def _found_sql(kind: str, pattern: str, group: int, keep: str) -> str:
    p = "'" + pattern.replace("'", "''") + "'"
    return f"""
SELECT r, owner, '{kind}' AS kind, CAST(e - length(m[k]) AS BIGINT) AS a, CAST(e AS BIGINT) AS e, v[k] AS value FROM (
    SELECT *, list_sum(list_transform(s[1:k], lambda x: length(x))) + list_sum(list_transform(m[1:k], lambda x: length(x))) AS e FROM (
        SELECT *, unnest(range(1, len(m) + 1)) AS k FROM (
            SELECT r, owner, regexp_extract_all(t, {p}) AS m, regexp_extract_all(t, {p}, {group}) AS v, regexp_split_to_array(t, {p}) AS s FROM d WHERE regexp_matches(t, {p})
        )
    )
) WHERE {keep}"""


OP8_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS owner, coalesce(text, '') AS t FROM documents),
f AS ({_found_sql("assign", secrets.ASSIGN, 2, "length(v[k]) >= 6")} UNION ALL {_found_sql("access", secrets.ACCESS, 0, "length(v[k]) >= 20")}
    UNION ALL {_found_sql("hex", secrets.HEX, 0, "true")} UNION ALL {_found_sql("token", secrets.TOKEN, 0, "regexp_matches(v[k], '[A-Z]') AND regexp_matches(v[k], '[a-z]') AND regexp_matches(v[k], '[0-9]')")}),
n AS (SELECT value, count(DISTINCT owner) AS owners FROM f GROUP BY value),
j AS (SELECT f.*, owners, CASE WHEN owners >= 3 OR len(list_distinct(string_split(f.value, ''))) < 6 THEN 'example' ELSE 'live' END AS verdict FROM f JOIN n ON f.value = n.value),
o AS (SELECT * FROM j WHERE kind <> 'token' OR (owners = 1 AND verdict = 'live')),
x AS (SELECT r, kind, a, e FROM o UNION ALL SELECT DISTINCT r, verdict, e - length(value), e FROM o),
y AS (SELECT r, kind, a, e, list_position(['assign', 'access', 'hex', 'token', 'live', 'example'], kind) AS k, kind || ':' || CAST(a AS VARCHAR) || ':' || CAST(e AS VARCHAR) AS say FROM x),
z AS (
    SELECT r, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
        string_agg(say, ',' ORDER BY a, k, e) FILTER (WHERE k <= 3) AS base, string_agg(say, ',' ORDER BY a, k, e) AS spans FROM y GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN z ON d.r = z.r
"""


def _op11_sql(rounds: int = 10) -> str:
    """The rounds one after another. Products of whole numbers of this size are exact in doubles."""
    far = "CAST(list_inner_product(v, v) + list_inner_product(c, c) - 2 * list_inner_product(v, c) AS BIGINT)"
    pick = lambda i: f"a{i} AS MATERIALIZED (SELECT r, k, d FROM (SELECT r, k, {far} AS d FROM v, c{i}) QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, k) = 1)"  # noqa: E731
    steps = [pick(0)]
    for i in range(rounds):
        steps.append(f"m{i} AS MATERIALIZED (SELECT k, j, CAST(sum(x) AS HUGEINT) AS s, count(*) AS n FROM (SELECT k, unnest(range(1, 65)) AS j, unnest(v) AS x FROM a{i} JOIN v USING (r)) GROUP BY k, j)")
        steps.append(f"c{i + 1} AS MATERIALIZED (SELECT k, coalesce(u, c) AS c FROM c{i} LEFT JOIN (SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY j) AS u FROM m{i} GROUP BY k) USING (k))")
        steps.append(pick(i + 1))
    return f"""
WITH v AS MATERIALIZED (
    SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v
    FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || CAST(vec_id AS VARCHAR)), v) - 1 AS k, v AS c FROM v QUALIFY k < 8),
{", ".join(steps)},
t AS (SELECT k, CAST(sum(d) AS BIGINT) AS per FROM a{rounds} GROUP BY k),
h AS (SELECT k, sha256(array_to_string(list_transform(c, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS said FROM c{rounds})
SELECT vec_id, CAST(k AS INTEGER) AS cluster, d AS distance, per AS cluster_inertia, CAST((SELECT sum(per) FROM t) AS BIGINT) AS inertia, said AS centroid_sha256
FROM a{rounds} JOIN v USING (r) JOIN t USING (k) JOIN h USING (k)
"""


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents WHERE text IS NOT NULL),
p AS (SELECT r, lang, unnest(string_split_regex(t, '[.,;:!?
-]')) AS t FROM d),
w AS (SELECT lang, regexp_extract_all(t, '[^ 	]+') AS w FROM p),
n AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
s AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k),
f AS MATERIALIZED (SELECT lang, w[i : i + k - 1] AS g, k, count(*) AS a FROM s GROUP BY ALL HAVING count(*) >= 30),
c AS MATERIALIZED (SELECT * FROM f WHERE k > 1),
x AS (
    SELECT c.lang, c.g, c.a, cut, l.a AS l, r.a AS r, CAST((2000000 * CAST(c.a AS HUGEINT)) // (l.a + r.a) AS BIGINT) AS score
    FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) c JOIN f l ON l.lang = c.lang AND l.g = c.g[1 : cut] JOIN f r ON r.lang = c.lang AND r.g = c.g[cut + 1 :]
),
b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
o AS (SELECT lang, g[i : i + m - 1] AS g, max(a) AS longer FROM (SELECT lang, g, a, m, unnest(range(1, k - m + 2)) AS i FROM c, (SELECT unnest([2, 3]) AS m) WHERE m < k) GROUP BY 1, 2),
q AS (SELECT b.*, array_to_string(b.g, ' ') AS phrase FROM b LEFT JOIN o ON o.lang = b.lang AND o.g = b.g WHERE longer IS NULL OR 100 * CAST(longer AS HUGEINT) < 80 * CAST(b.a AS HUGEINT))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score
FROM q JOIN n USING (lang) QUALIFY rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_centroid_clustering": _op11_sql(), "op12_phrase_collocations": OP12_SQL, "op4_exact_top_k": OP4_SQL, "op5_benchmark_decontamination": OP5_SQL, "op6_url_filter": OP6_SQL, "op7_chat_format": OP7_SQL, "op8_secret_scan": OP8_SQL}
