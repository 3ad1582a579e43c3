"""Queries for text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.functions.blocks import Blocks, Chunks, Windows
from quarry.functions.claims import (
    CLAIM_WORDS, MAJOR, MECHANISM_WORDS, NEW_DATASET, OLD_DATASETS, OLD_SECTION, OTHER_TYPE, ROLE_TYPES, SECTION_WORDS, SHORT, TIE_ORDER, claim_type, macro_of, sections,
)
from quarry.functions.tables import grid_latex, grid_markdown, table_grid
from quarry.operators.sequences import top_per_group
from quarry.storage import written

SQL: dict[str, str] = {}


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def keyword_frequency(spark: SparkSession, d: str) -> DataFrame:
    words = _t(spark, d, "documents").select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z][a-z\-]{2,}"), F.lit(0))).alias("word"))
    counts = words.filter(~F.col("word").isin(*T.STOP_WORDS)).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    return top_per_group(counts, ["lang"], [F.desc("n"), "word"], 20)


_STOPS = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
SQL["keyword_frequency"] = f"""
WITH w AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z][a-z\\-]{{2,}}')) AS word FROM documents),
c AS (SELECT lang, word, count(*) AS n FROM w WHERE word NOT IN ({_STOPS}) GROUP BY lang, word)
SELECT lang, word, n, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS INTEGER) AS rank FROM c) WHERE rank <= 20
"""


def sentence_score(spark: SparkSession, d: str) -> DataFrame:
    """Scores of sentences per source; sentences are cut at a stop and a blank, which both engines' patterns can say."""
    parts = _t(spark, d, "documents").select("source", F.explode(F.split("text", r"[.!?]\s+")).alias("s")).filter("trim(s) <> ''")
    return parts.groupBy("source", T.sentence_score(F.col("s")).alias("score")).agg(F.count(F.lit(1)).alias("n"))


_TERMS = " + ".join(f"CASE WHEN contains(lower(s), '{t}') THEN 2 ELSE 0 END" for t in T.SIGNAL_TERMS)
SQL["sentence_score"] = f"""
WITH p AS (SELECT source, unnest(regexp_split_to_array(text, '[.!?]\\s+')) AS s FROM documents),
q AS (SELECT source, s, len(list_filter(regexp_split_to_array(s, '\\s+'), lambda x: x <> '')) AS n FROM p WHERE trim(s, ' ') <> '')
SELECT source, {_TERMS} + CASE WHEN n BETWEEN 8 AND 45 THEN 2 WHEN n BETWEEN 46 AND 70 THEN 1 ELSE 0 END + CASE WHEN regexp_matches(s, '[0-9]') THEN 1 ELSE 0 END AS score, count(*) AS n
FROM q GROUP BY 1, 2
"""


def markdown_clean(spark: SparkSession, d: str) -> DataFrame:
    t = T.html_text(F.col("html"))
    return _t(spark, d, "pages").select("page_id", F.char_length(t).alias("n_chars"), F.sha2(t, 256).alias("sha"))


_HTML = r"regexp_replace(regexp_replace(html, '(?is)<(script|style)\b.*?</(script|style)>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"
for _entity, _char in T.ENTITIES:
    _HTML = f"replace({_HTML}, '{_entity}', '{_char.replace(chr(39), chr(39) * 2)}')"
SQL["markdown_clean"] = rf"""
WITH t AS (SELECT page_id, trim(regexp_replace({_HTML}, '\s+', ' ', 'g'), ' ') AS t FROM pages)
SELECT page_id, CAST(length(t) AS INTEGER) AS n_chars, sha256(t) AS sha FROM t
"""


def containment(spark: SparkSession, d: str, most_sent: int = 100_000, block: int = 1000) -> DataFrame:
    """Which benchmark texts stand in which documents, white space apart.

    A document word at either end of a text may carry more than the text's own, so its inner words decide: candidates share the
    second to seventh word of a text of eight or more, by a hash of six words in a row. Those hashes are sent to the documents where
    they are few, so no run is shuffled, and each candidate is checked where it is found. Shorter texts are looked for in blocks.
    """
    docs = _t(spark, d, "documents").select("doc_id", T.squeezed(F.col("text")).alias("hay"))
    items = _t(spark, d, "benchmark").select("item_id", T.squeezed(F.col("text")).alias("needle")).filter("needle <> ''").withColumn("w", F.transform(F.split("needle", " "), lambda x: F.xxhash64(x)))
    key = lambda w, i: F.xxhash64(*[F.get(w, i + j) for j in range(6)])
    long = written(items.filter(F.size("w") >= 8).select("item_id", "needle", key(F.col("w"), F.lit(1)).alias("key")), "needles")
    short = written(items.filter(F.size("w") < 8).select("item_id", "needle", F.pmod(F.xxhash64("needle"), F.lit(1 << 30)).alias("h")), "short-needles")
    w = F.transform(F.split("hay", " "), lambda x: F.xxhash64(x))
    runs = docs.withColumn("w", w).filter(F.size("w") >= 6).select("doc_id", "hay", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("w") - 6), lambda i: key(F.col("w"), i)))).alias("key"))
    if long.count() <= most_sent:
        found = runs.join(F.broadcast(long), "key").filter(F.contains("hay", F.col("needle"))).select("doc_id", "item_id")
    else:
        near = runs.drop("hay").join(long, "key").select("doc_id", "item_id", "needle").distinct()
        found = near.join(docs, "doc_id").filter(F.contains("hay", F.col("needle"))).select("doc_id", "item_id")
    blocks = -(-short.count() // block)
    for b in range(blocks):
        few = short.filter(F.col("h") % blocks == b).agg(F.collect_list(F.struct("item_id", "needle")).alias("few")).first()["few"]  # about `block` short texts
        said = F.array(*[F.when(F.contains("hay", F.lit(x["needle"])), F.lit(x["item_id"])) for x in few]) if few else F.array().cast("array<bigint>")
        found = found.unionByName(docs.select("doc_id", F.explode(F.array_compact(said)).alias("item_id")))
    return found


SQL["containment"] = r"""
WITH h AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g'), ' ') AS hay FROM documents), n AS (SELECT item_id, trim(regexp_replace(text, '\s+', ' ', 'g'), ' ') AS needle FROM benchmark)
SELECT doc_id, item_id FROM h JOIN n ON contains(hay, needle) WHERE needle <> ''
"""


def csv_guard(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "documents").select("source", F.explode(F.split("text", "\n")).alias("line"))
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(T.csv_guarded(F.col("line")) != F.col("line")).alias("n_guarded"))


SQL["csv_guard"] = r"""
WITH l AS (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT source, count(*) AS n_lines, count(*) FILTER (WHERE regexp_matches(line, '^[\s]*[=+@-]')) AS n_guarded FROM l GROUP BY source
"""


def labels_and_terms(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "benchmark").select("item_id", T.short_label(F.col("text")).alias("label"), T.compact(F.col("text"), 60).alias("compact"), T.safe_id(F.col("text")).alias("safe"), F.size(T.paragraphs(F.col("text"))).alias("n_paragraphs"))


SQL["labels_and_terms"] = r"""
WITH b AS (SELECT item_id, text, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w, trim(regexp_replace(text, '\s+', ' ', 'g'), ' ') AS s FROM benchmark)
SELECT item_id, CASE WHEN len(w) > 10 THEN array_to_string(w[1:10], ' ') || '...' ELSE array_to_string(w, ' ') END AS label,
    CASE WHEN length(s) <= 60 THEN s ELSE rtrim(substr(s, 1, 57), ' ') || '...' END AS compact,
    regexp_replace(regexp_replace(text, '[^A-Za-z0-9_]+', '_', 'g'), '^_+|_+$', '', 'g') AS safe,
    CAST(len(list_filter(regexp_split_to_array(text, '\n\s*\n'), lambda p: trim(p, ' ') <> '')) AS INTEGER) AS n_paragraphs
FROM b
"""


def _papers(spark: SparkSession, d: str) -> DataFrame:
    """Documents as papers in Markdown: a title, lines on authors, an abstract, furniture, the text, and references."""
    parts = ["# Title\nUniversity of T\nshort line\nwritten at @home by one\nA line that is kept here\n## Abstract\n", F.col("text"), "\n<div class=\"a\">x\ny</div><table><tr>1</tr></table>![i](p.png) <img src=\"q\">\nFigure 3: a caption\nand Table 2. another one\nCode: here\nsee GitHub.com/x\n\n\n\n### 2. Introduction\nend  of\ttext\n## References\n[1] gone"]
    return _t(spark, d, "documents").filter("text is not null").select("doc_id", F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts]).alias("md"))


_PAPERS = r"""
WITH p AS (
    SELECT doc_id, concat('# Title' || chr(10) || 'University of T' || chr(10) || 'short line' || chr(10) || 'written at @home by one' || chr(10) || 'A line that is kept here' || chr(10) || '## Abstract' || chr(10), text,
        replace('~<div class="a">x~y</div><table><tr>1</tr></table>![i](p.png) <img src="q">~Figure 3: a caption~and Table 2. another one~Code: here~see GitHub.com/x~~~~### 2. Introduction~end  of' || chr(9) || 'text~## References~[1] gone', '~', chr(10))) AS md
    FROM documents WHERE text IS NOT NULL
)
"""


def paper_clean(spark: SparkSession, d: str) -> DataFrame:
    """Papers without furniture, authors, references and code links."""
    both = T.bound(T.markdown_text(F.col("md")), lambda t: F.struct(F.char_length(t).alias("n_chars"), F.sha2(t, 256).alias("sha")))
    return _papers(spark, d).select("doc_id", both.alias("of")).select("doc_id", "of.n_chars", "of.sha")


_CLEAN = "md"
for _pattern in T.FURNITURE:
    _CLEAN = f"regexp_replace({_CLEAN}, '{_pattern.replace('(?id)', '(?i)')}', ' ', 'g')"
_LINE = "lower(trim({}, ' '))"
_X = _LINE.format("x")
_AUTHORS = f"regexp_matches({_X}, '{T.AUTHOR_LINE}') OR regexp_matches({_X}, '{'|'.join(T.AUTHOR_MARKS)}') OR len(list_filter(regexp_split_to_array({_X}, '\\s+'), lambda w: w <> '')) <= 2"
SQL["paper_clean"] = rf"""{_PAPERS},
a AS (SELECT doc_id, string_split({_CLEAN}, chr(10)) AS l FROM p),
b AS (SELECT doc_id, l, list_position(list_transform(l, lambda x: regexp_matches({_X}, '{T.BODY_OPENS}')), true) AS body FROM a),
c AS (SELECT doc_id, CASE WHEN body > 2 THEN array_to_string(list_filter(l, lambda x, i: i = 1 OR i >= body OR NOT ({_AUTHORS})), chr(10)) ELSE array_to_string(l, chr(10)) END AS t FROM b),
e AS (SELECT doc_id, array_to_string(list_filter(string_split(trim(regexp_replace(t, '{T.TAIL}', ''), ' '), chr(10)), lambda x: NOT regexp_matches({_X}, '{T.CODE_LINE}')), chr(10)) AS t FROM c),
g AS (SELECT doc_id, trim(regexp_replace(regexp_replace(t, '\n{{3,}}', chr(10) || chr(10), 'g'), '[ \t]+', ' ', 'g'), ' ') AS t FROM e)
SELECT doc_id, CAST(length(t) AS INTEGER) AS n_chars, sha256(t) AS sha FROM g
"""


def paper_sections(spark: SparkSession, d: str) -> DataFrame:
    """Sections of the papers, short ones joined to the one before."""
    rows = sections(_papers(spark, d), "doc_id", "md")
    return rows.select("doc_id", "section_id", "title", F.sha2("text", 256).alias("text"))


SQL["paper_sections"] = rf"""{_PAPERS},
l AS (SELECT doc_id, unnest(string_split(md, chr(10))) AS line, unnest(range(1, len(string_split(md, chr(10))) + 1)) AS i FROM p),
h AS (SELECT *, trim(regexp_extract(line, '^\s{{0,3}}#{{1,6}}\s+(.+?)\s*$', 1), ' ') AS title FROM l),
k AS (SELECT *, sum(CASE WHEN title <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM h WHERE NOT (title <> '' AND (regexp_matches(lower(title), '^page\s+\d+\b') OR lower(title) IN ('acknowledgments', 'acknowledgements')))),
s AS (SELECT doc_id, n, coalesce(max(CASE WHEN title <> '' THEN title END), 'Preamble') AS title, regexp_replace(coalesce(string_agg(CASE WHEN title = '' THEN line END, chr(10) ORDER BY i), ''), '^\s+|\s+$', '', 'g') AS body FROM k GROUP BY 1, 2),
m AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY doc_id ORDER BY n) = 1 OR length(body) >= {SHORT} OR regexp_matches(lower(title), '^(\d+(\.\d+)*)\s+') OR lower(title) IN ({", ".join(f"'{x}'" for x in MAJOR)}) THEN 1 ELSE 0 END AS lead FROM s WHERE body <> ''),
g AS (SELECT *, sum(lead) OVER (PARTITION BY doc_id ORDER BY n) AS k FROM m)
SELECT doc_id, concat('S', CAST(k AS BIGINT)) AS section_id, arg_min(title, n) AS title, sha256(string_agg(body, chr(10) || chr(10) ORDER BY n)) AS text FROM g GROUP BY doc_id, k
"""


def claim_places(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark texts as claims: their macro and type under titles and roles that go round, and the words that key them."""
    k = (F.col("item_id") % 6 + 1).cast("int")
    titles, roles = ("1 Introduction", "3 Method", "Experiments", "Conclusion", "Video Fact-Checking Datasets", None), ("problem", "Method module", "result", "dataset", None, "other")
    at = lambda names: F.element_at(F.array(*[F.lit(x) for x in names]), k)
    claim = F.concat("text", F.when(F.col("item_id") % 4 == 0, " we propose a dataset, checked by a module; accuracy remains.").otherwise(" limitation of the existing framework"))
    return _t(spark, d, "benchmark").select("item_id", macro_of(claim, at(titles)).alias("macro"), claim_type(claim, at(roles)).alias("type"), F.array_join(T.key_terms(claim), ",").alias("terms"), T.as_claim(F.concat(F.lit("- "), F.lower("text"))).alias("claim"))


def _any_sql(text: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


_SCORES = {m: f"CASE WHEN {_any_sql('s', names)} THEN {weight} ELSE 0 END + " + " + ".join(f"CASE WHEN contains(c, '{w}') THEN 2 ELSE 0 END" for w in CLAIM_WORDS[m]) for m, (weight, names) in SECTION_WORDS.items()}
_OLD = f"(contains(s, '{OLD_SECTION}') AND {_any_sql('c', OLD_DATASETS)})"
_SCORES["M1"] += f" + CASE WHEN {_OLD} THEN 5 ELSE 0 END"
_SCORES["M2"] += f" - CASE WHEN {_OLD} THEN 3 ELSE 0 END + CASE WHEN contains(c, 'dataset') AND {_any_sql('c', NEW_DATASET)} THEN 2 ELSE 0 END"
_KINDS = " ".join(f"WHEN {_any_sql('r', words)} THEN '{kind}'" for kind, words in ROLE_TYPES.items())
SQL["claim_places"] = rf"""
WITH b AS (
    SELECT item_id, text, text || CASE WHEN item_id % 4 = 0 THEN ' we propose a dataset, checked by a module; accuracy remains.' ELSE ' limitation of the existing framework' END AS t,
        lower(CASE item_id % 6 WHEN 0 THEN '1 Introduction' WHEN 1 THEN '3 Method' WHEN 2 THEN 'Experiments' WHEN 3 THEN 'Conclusion' WHEN 4 THEN 'Video Fact-Checking Datasets' ELSE '' END) AS s,
        lower(CASE item_id % 6 WHEN 0 THEN 'problem' WHEN 1 THEN 'Method module' WHEN 2 THEN 'result' WHEN 3 THEN 'dataset' WHEN 4 THEN '' ELSE 'other' END) AS r
    FROM benchmark
),
c AS (SELECT *, lower(t) AS c FROM b), m AS (SELECT *, {", ".join(f"{x} AS {m}" for m, x in _SCORES.items())}, CASE {_KINDS} ELSE '{OTHER_TYPE}' END AS k FROM c),
w AS (SELECT item_id, list_filter(regexp_extract_all(t, '[A-Za-z][A-Za-z\-]{{3,}}'), lambda x: NOT list_contains([{", ".join(f"'{x}'" for x in T.TERM_STOPS)}], lower(x))) AS w FROM b),
u AS (SELECT item_id, list_filter(w, lambda x, i: list_position(list_transform(w, lambda y: lower(y)), lower(x)) = i)[1:6] AS w FROM w),
q AS (SELECT item_id, trim(regexp_replace(regexp_replace(trim('- ' || lower(text), ' '), '^[-*]+|[-*]+$', '', 'g'), '\s+', ' ', 'g'), ' ') AS q FROM b),
v AS (SELECT item_id, CASE WHEN regexp_matches(q, '[.!?。！？]$') OR q = '' THEN q ELSE q || '.' END AS q FROM q)
SELECT m.item_id, CASE greatest(M1, M2, M3, M4) {" ".join(f"WHEN {x} THEN '{x}'" for x in TIE_ORDER)} END AS macro, CASE WHEN k = 'method' AND {_any_sql("c", MECHANISM_WORDS)} THEN 'mechanism' ELSE k END AS type,
    array_to_string(u.w, ',') AS terms, upper(substr(v.q, 1, 1)) || substr(v.q, 2) AS claim
FROM m JOIN u ON m.item_id = u.item_id JOIN v ON m.item_id = v.item_id
"""


def text_helpers(spark: SparkSession, d: str) -> DataFrame:
    """Small functions of texts and numbers, over parts."""
    k, name, kind = F.col("p_partkey"), F.col("p_name"), F.col("p_type")
    given = F.array(F.concat(name, F.lit(" ")), F.lit(" "), kind, name, F.col("p_brand"))
    joined = lambda x: F.array_join(x, "|")
    return _t(spark, d, "part").select(
        "p_partkey", T.safe_path_component(F.concat(F.lit("../"), name, F.lit("/"), F.col("p_brand"), F.lit("."))).alias("path"), joined(T.panel_labels(F.concat(F.lit("(A) "), name, F.lit(" (b), (a) and ("), F.substring(kind, 1, 1), F.lit(")")))).alias("panels"),
        T.trailing_int(F.col("p_brand")).alias("number"), joined(T.deduped(given)).alias("deduped"), joined(T.bounded(given, F.array(kind, F.col("p_brand")))).alias("bounded"), T.truncated(F.concat(name, F.lit("   x")), 12).alias("truncated"),
        T.rendered("{a}-{b}-{a}{c}", a=name, b=F.lit("{a}"), c=F.when(k % 2 == 0, kind)).alias("rendered"), joined(T.id_list(F.concat(name, F.lit(",, "), kind, F.lit(" "), name))).alias("ids"), T.confidence((k / 100 - 0.5).cast("string")).alias("confidence"),
        T.leaks_labels(F.concat(name, F.when(k % 3 == 0, " KC12").otherwise(" KCs"))).alias("leaks"), T.caption(F.concat(F.when(k % 3 == 0, "Fig. ").when(k % 3 == 1, " TABLE ").otherwise("see "), k.cast("string"))).getField("kind").alias("caption"),
        F.array_join(F.map_values(F.map_from_entries(F.array_sort(F.map_entries(T.merged_scope(F.create_map(F.lit("x"), name, F.lit("y"), F.lit(" ")), {"y": "default", "z": "last"}))))), "|").alias("scope"),
        T.paragraph_range(T.paragraphs(F.concat_ws("\n\n", name, kind, F.col("p_brand"))), F.array(F.lit("P2"), F.lit("odd"), F.concat(F.lit("P"), (k % 4 + 1).cast("string")))).alias("cited"),
    )


SQL["text_helpers"] = r"""
WITH p AS (SELECT *, lower(substr(p_type, 1, 1)) AS first, [concat(p_name, ' '), ' ', p_type, p_name, p_brand] AS given, least(2, p_partkey % 4 + 1) AS low, least(3, greatest(2, p_partkey % 4 + 1)) AS high, [p_name, p_type, p_brand] AS ps FROM part)
SELECT p_partkey, regexp_replace(regexp_replace('../' || p_name || '/' || p_brand || '.', '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') AS path, CASE WHEN first IN ('a', 'b') THEN 'a|b' ELSE 'a|b|' || first END AS panels,
    CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS BIGINT) AS number, concat_ws('|', p_name, p_type, p_brand) AS deduped, concat_ws('|', p_type, p_brand) AS bounded, rtrim(substr(p_name || '   x', 1, 12), ' ') AS truncated,
    p_name || '-{a}-' || p_name || CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE '' END AS rendered, array_to_string(list_filter(list_concat(string_split(p_name, ' '), CASE WHEN list_contains(string_split(p_name, ' '), p_type) THEN [] ELSE [p_type] END), lambda x, i: x <> '' AND list_position(list_concat(string_split(p_name, ' '), [p_type]), x) = i), '|') AS ids,
    round(greatest(0.0, least(1.0, p_partkey / 100 - 0.5)), 4) AS confidence, p_partkey % 3 = 0 AS leaks, CASE p_partkey % 3 WHEN 0 THEN 'figure' WHEN 1 THEN 'table' END AS caption, concat_ws('|', p_name, 'default', 'last') AS scope,
    array_to_string(ps[low:high], chr(10) || chr(10)) AS cited
FROM p
"""


def blocks(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of blocks per page, from a table function."""
    pages = _t(spark, d, "pages").select("page_id", F.regexp_replace("html", "(?i)<(p|h1|article|footer|nav|ul|li)\\b", "\n\n<$1").alias("text"))
    rows = pages.lateralJoin(Blocks(F.col("text").outer()))
    return rows.groupBy("page_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length(rows["image"])).alias("image_chars"))


def chunks(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents").select("doc_id", "text")
    rows = docs.select("doc_id", F.col("text").alias("body")).lateralJoin(Chunks(F.col("body").outer(), F.lit(7000), F.lit(600)))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.max(F.char_length("text")).alias("longest"))


def packed_windows(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents").select("doc_id", F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n")).alias("body"))
    rows = docs.lateralJoin(Windows(F.col("body").outer(), F.lit(4000), F.lit(1)))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_windows"), F.max(F.char_length("text")).alias("longest"))


def table_grids(spark: SparkSession, d: str) -> DataFrame:
    """Tables built from the rows of pages' lists: pages themselves hold none."""
    cells = F.transform(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit("<li>(.*?)</li>"), F.lit(1)), lambda x: F.concat(F.lit("<td>"), x, F.lit("</td>")))
    html = F.concat(F.lit("<table><tr><th colspan=2>links</th></tr><tr>"), F.array_join(cells, "</tr><tr>"), F.lit("</tr></table>"))
    grid = _t(spark, d, "pages").select("page_id", table_grid(html).alias("grid"))
    return grid.select("page_id", F.size("grid").alias("n_rows"), F.size(F.element_at("grid", 1)).alias("n_columns"), F.sha2(grid_markdown(F.col("grid")), 256).alias("markdown"), F.sha2(grid_latex(F.col("grid")), 256).alias("latex"))


SQL["table_grids"] = r"""
WITH c AS (
    SELECT page_id, list_transform(regexp_extract_all(coalesce(html, ''), '<li>(.*?)</li>', 1), lambda x: trim(regexp_replace(replace(replace(replace(replace(
        regexp_replace(x, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g'))) AS found FROM pages
),
g AS (SELECT page_id, CASE WHEN len(found) > 0 THEN found ELSE [''] END AS cells FROM c),
t AS (
    SELECT page_id, cells, list_transform(cells, lambda x: array_to_string(list_transform(string_split(x, ''), lambda y: CASE
        WHEN y = '\' THEN '\textbackslash{}' WHEN y = '~' THEN '\textasciitilde{}' WHEN y = '^' THEN '\textasciicircum{}'
        WHEN y IN ('&', '%', '$', '#', '_', '{', '}') THEN '\' || y ELSE y END), '')) AS escaped FROM g
)
SELECT page_id, CAST(len(cells) + 1 AS INTEGER) AS n_rows, CAST(2 AS INTEGER) AS n_columns,
    sha256('| links | links |' || chr(10) || '| --- | --- |' || chr(10) || array_to_string(list_transform(cells, lambda x: '| ' || replace(x, '|', '\|') || ' |  |'), chr(10))) AS markdown,
    sha256('\begin{tabular}{ll}' || chr(10) || 'links & links \\' || chr(10) || array_to_string(list_transform(escaped, lambda x: x || ' &  \\'), chr(10)) || chr(10) || '\end{tabular}') AS latex
FROM t
"""
