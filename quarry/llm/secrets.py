"""Secret scans by corpus-wide ownership frequency, in DataFrame functions alone.

Candidates come from patterns. The hash of each candidate's value is counted over the whole corpus by distinct
repository and owner: a value that many owners carry is a copied example, a value of one owner that looks random is live.

Defined results: a null text counts as empty and holds no candidate; repeated rows are each scanned; an empty table gives an
empty result; a null repository or owner counts as one owner of its own; columns besides the named ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The base patterns of the contract, with the group that holds the value and the least length of what must be long enough.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
BASE = ("assign", "access", "hex")
#: Long mixed runs that no keyword announces; they count only where one owner alone has them.
TOKEN = r"[A-Za-z0-9+/_-]{32,}"
KINDS = (*BASE, "token", "live", "example")


def _matches(text: Column, kind: str, pattern: str, group: int) -> Column:
    """All matches of a kind as an array of (kind, at, gap, size, value); gap: code points between the match before and this one."""
    whole, value, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.split(text, pattern, -1)
    each = F.transform(
        F.arrays_zip(whole.alias("w"), value.alias("v"), F.slice(gaps, 1, F.size(whole)).alias("g")),
        lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("at"), F.char_length(x["g"]).alias("gap"), F.char_length(x["w"]).alias("size"), x["v"].alias("value")),
    )
    return F.when(text.rlike(pattern), each).otherwise(F.expr("cast(array() as array<struct<kind:string,at:int,gap:int,size:int,value:string>>)"))


def with_candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the array column `found`: every match of every kind, before any is dropped."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumn("found", F.concat(_matches(t, "assign", ASSIGN, 2), _matches(t, "access", ACCESS, 0), _matches(t, "hex", HEX, 0), _matches(t, "token", TOKEN, 0)))


def spans(docs: DataFrame, uid: str = "uid", repository: str = "source", owner: str = "source", copied_by: int = 3, least_variety: int = 6) -> DataFrame:
    """One row per candidate: uid, kind, start, end, value_start, value_hash, n_repositories, n_owners, verdict.

    docs has `found` and a unique uid. Offsets are code points, end exclusive. verdict is `example` where at least
    copied_by owners have the value or it has fewer than least_variety different characters, else `live`.
    """
    rows = docs.filter(F.size("found") > 0).select(F.col(uid).alias("uid"), F.coalesce(repository, F.lit("")).alias("repository"), F.coalesce(owner, F.lit("")).alias("owner"), F.explode("found").alias("f")).select("uid", "repository", "owner", "f.*")
    so_far = Window.partitionBy("uid", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(so_far)).withColumn("start", F.col("end") - F.col("size"))
    long_enough = F.when(F.col("kind") == "assign", F.char_length("value") >= 6).when(F.col("kind") == "access", F.col("size") >= 20).when(F.col("kind") == "token", F.col("value").rlike("[A-Z]") & F.col("value").rlike("[a-z]") & F.col("value").rlike("[0-9]")).otherwise(True)
    rows = rows.filter(long_enough).select("uid", "repository", "owner", "kind", "start", "end", (F.col("end") - F.char_length("value")).alias("value_start"), F.sha2("value", 256).alias("value_hash"), (F.size(F.array_distinct(F.split("value", ""))) >= least_variety).alias("varied"))
    each = rows.groupBy("value_hash", "repository", "owner").agg(F.count(F.lit(1)).alias("n"))
    seen = each.groupBy("value_hash").agg(F.countDistinct("repository").alias("n_repositories"), F.countDistinct("owner").alias("n_owners"), F.sum("n").alias("n_seen"))
    judged = rows.join(seen, "value_hash").withColumn("verdict", F.when((F.col("n_owners") >= copied_by) | ~F.col("varied"), "example").otherwise("live"))
    return judged.filter((F.col("kind") != "token") | ((F.col("n_owners") == 1) & (F.col("verdict") == "live"))).select("uid", "kind", "start", "end", "value_start", "value_hash", "n_repositories", "n_owners", "n_seen", "verdict")


def digest(found: DataFrame) -> DataFrame:
    """Per uid the counts, the digest of the base spans, and all spans as text; the verdicts are spans over the values."""
    order = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    own = found.select("uid", "kind", "start", "end")
    verdict = found.select("uid", F.col("verdict").alias("kind"), F.col("value_start").alias("start"), "end").distinct()
    rows = own.unionByName(verdict).withColumn("s", F.struct("start", order[F.col("kind")].alias("o"), "end", F.concat_ws(":", "kind", "start", "end").alias("say")))
    per = rows.groupBy("uid").agg(*[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in BASE], F.array_sort(F.collect_list("s")).alias("s"))
    said = lambda x: F.array_join(F.transform(x, lambda y: y["say"]), ",")
    return per.select("uid", *[f"n_{k}" for k in BASE], F.sha2(said(F.filter("s", lambda y: y["o"] < len(BASE))), 256).alias("base_sha256"), said(F.col("s")).alias("spans"))


def cuts(found: DataFrame) -> DataFrame:
    """(uid, cuts): what to mask of each text, as (a, b, from): the stretch from a to b, and where the kept text before it begins.

    Overlapping values of live credentials are one stretch, from the first start to the last end.
    """
    live = found.filter(F.col("verdict") == "live").select("uid", F.col("value_start").alias("a"), F.col("end").alias("b"))
    before = Window.partitionBy("uid").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    live = live.withColumn("new", F.coalesce((F.col("a") > F.max("b").over(before)).cast("int"), F.lit(1)))
    live = live.withColumn("run", F.sum("new").over(Window.partitionBy("uid").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, 0)))
    runs = live.groupBy("uid", "run").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    runs = runs.withColumn("from", F.coalesce(F.lag("b").over(Window.partitionBy("uid").orderBy("a")), F.lit(0)))
    return runs.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("a", "b", "from"))).alias("cuts"))


def masked(text: Column, cut: Column, mask: str = "<secret>") -> Column:
    """The text with its stretches masked; null cuts leave it as it is."""
    kept = F.array_join(F.transform(cut, lambda c: F.concat(text.substr(c["from"].cast("int") + F.lit(1), (c["a"] - c["from"]).cast("int")), F.lit(mask))), "")
    rest = text.substr(F.element_at(cut, -1)["b"].cast("int") + F.lit(1), F.char_length(text))
    return F.when(cut.isNull(), text).otherwise(F.concat(kept, rest))
