"""URL filters: fixed rules first, then trust and distrust propagated over the graph of hosts.

Hosts that allow rules cover are trusted seeds, those that block rules cover are blocked seeds, weighted by their pages; a host
that is only linked to is a seed where a rule covers it as a whole, weighted by the pages that link to it. Trust is a
personalised PageRank along links; distrust runs the same way along reversed links, so a host that links to bad ones is
distrusted. Mass that finds no link returns to the seeds, as the restart does.

The edges between hosts are absolute links, redirects, hosts of pages that a text names, relative links (a host's edge to
itself), and those that names give: a host and its parent domain are linked both ways, weighted by the pages below it.

A host is blocked where its distrust exceeds `ratio` times its trust; a host that no rule covers is so judged by those it is
linked with, and if nothing else by its domain.
Rounds are a parameter: after `rounds` of them at most damping ** rounds of the mass, 4 % here, could still go elsewhere.

Masses are whole numbers: a share sent along an edge is cut to one, and sums do not depend on their order.
Defined results: a null url, or one without `://`, has an empty host and path, no rule and, like every host outside the graph,
the verdict allow; a null html has no links; a host of over 253 characters, which no name server knows, has no parents; repeated
rows are pages of their own; without seeds of a kind there is no mass of it; empty tables give empty results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quarry.llm.common import discard, written

TOTAL = 1 << 50
ROUNDS, DAMPING = 20, 0.85
LONGEST = 253
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Patterns of one character class at a time: they take one pass and no stack, however long a text is.
#: Hosts that a page links to by an address with a host; attributes may be in either case.
LINK = r"""(?:[Hh][Rr][Ee][Ff]|[Ss][Rr][Cc]|[Uu][Rr][Ll])[\t\n\f\r ]*=[\t\n\f\r ]*["']?(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#"'\t\n\f\r >]+)"""
#: All addresses; what has neither a scheme nor a host is relative.
ADDRESS = r"""(?:[Hh][Rr][Ee][Ff]|[Ss][Rr][Cc])[\t\n\f\r ]*=[\t\n\f\r ]*["']?([^"'\t\n\f\r >]+)"""
ELSEWHERE = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:|//|#)"
#: What may be a host named in a text.
NAMED = r"[A-Za-z0-9@._/:-]+"

#: (verdict, host, path): a rule covers the host, its subdomains, and paths that start with its own.
Rule = tuple[str, str, str]


def with_host(pages: DataFrame, url: str = "url") -> DataFrame:
    u = F.coalesce(F.col(url), F.lit(""))
    return pages.withColumns({"host": F.translate(F.regexp_extract(u, "://([^/?#]*)", 1), UPPER, LOWER), "path": F.regexp_extract(u, "://[^/?#]*([^?#]*)", 1)})


def with_rule(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """pages with rule (host and path of the longest rule that fits, or null) and rule_verdict. Rules are a short list, compiled into one expression."""
    assert len(rules) <= 1000, "longer lists belong into a table, joined on the suffixes of hosts"
    fits = lambda h, p: ((F.col("host") == h) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(p)
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    pick = lambda i: reduce(lambda rest, r: F.when(fits(r[1], r[2]), r[1] + r[2] if i else r[0]).otherwise(rest), reversed(ordered), F.lit(None).cast("string"))
    return pages.withColumns({"rule": pick(1), "rule_verdict": pick(0)})


def mentions(pages: DataFrame, html: str = "html") -> DataFrame:
    """(source, target, how, pages): how many pages of a host link to a host, name it, or link within their own. Targets that are named may be no hosts."""
    h = F.coalesce(F.col(html), F.lit(""))
    low = lambda x: F.translate(x, UPPER, LOWER)
    linked = F.transform(F.regexp_extract_all(h, F.lit(LINK), F.lit(1)), low)
    named = F.transform(F.filter(F.regexp_extract_all(h, F.lit(NAMED), F.lit(0)), lambda x: F.contains(x, F.lit(".")) & ~x.rlike("[@/:]")), lambda x: F.trim(low(x), F.lit(".-_")))
    inner = F.exists(F.regexp_extract_all(h, F.lit(ADDRESS), F.lit(1)), lambda x: ~x.rlike(ELSEWHERE))
    said = lambda how, x: F.transform(F.array_distinct(x), lambda t: F.struct(F.lit(how).alias("how"), t.alias("target")))
    found = F.concat(said("link", linked), said("name", F.array_except(named, linked)), F.when(inner, said("own", F.array("host"))).otherwise(said("own", F.array().cast("array<string>"))))
    rows = pages.filter("host <> ''").select(F.col("host").alias("source"), F.explode(found).alias("f")).select("source", "f.target", "f.how")
    return rows.filter("target <> '' and (source <> target or how = 'own')").groupBy("source", "target", "how").agg(F.count(F.lit(1)).alias("pages"))


def parents(hosts: DataFrame) -> DataFrame:
    """(source, target, pages): each host and its parent domain, up to those of two labels, both ways. hosts: host, pages."""
    labels = F.split("host", r"\.")
    proper = (F.length("host") <= LONGEST) & (F.size(labels) > 2) & ~F.array_contains(labels, "") & ~F.element_at(labels, -1).rlike("^[0-9]*$")
    chain = F.transform(F.sequence(F.lit(1), F.size("l") - 1), lambda i: F.struct(F.array_join(F.slice("l", i, F.size("l")), ".").alias("below"), F.array_join(F.slice("l", i + 1, F.size("l")), ".").alias("above")))
    steps = hosts.filter(proper).select("pages", labels.alias("l")).select("pages", F.explode(F.filter(chain, lambda x: F.contains(x["above"], F.lit(".")))).alias("x"))
    per = steps.groupBy(F.col("x.below").alias("below"), F.col("x.above").alias("above")).agg(F.sum("pages").alias("pages"))
    return per.select(F.explode(F.array(F.struct(F.col("below").alias("source"), F.col("above").alias("target")), F.struct(F.col("above").alias("source"), F.col("below").alias("target")))).alias("e"), "pages").select("e.source", "e.target", "pages")


def edges(ruled: DataFrame, html: str = "html") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The graph of the pages with hosts: hosts (host, pages), links (source, target, pages) and what is linked to (host, pages); written."""
    hosts = written(ruled.filter("host <> ''").groupBy("host").agg(F.count(F.lit(1)).alias("pages")), "url-hosts")
    found = written(mentions(ruled, html), "url-mentions")
    named = found.filter("how = 'name'").join(hosts.select(F.col("host").alias("target")), "target", "left_semi")
    told = found.filter("how <> 'name'").unionByName(named).select("source", "target", "pages")
    targets = written(found.filter("how = 'link'").groupBy(F.col("target").alias("host")).agg(F.sum("pages").alias("pages")), "url-targets")
    known = hosts.unionByName(targets).groupBy("host").agg(F.sum("pages").alias("pages"))
    links = written(told.unionByName(parents(known)).groupBy("source", "target").agg(F.sum("pages").alias("pages")), "url-links")
    discard(found)
    return hosts, links, targets


def seeds_of(ruled: DataFrame, hosts: DataFrame, targets: DataFrame, rules: list[Rule]) -> DataFrame:
    """(host, allowed, blocked): counts of pages that rules cover, and of pages that link to hosts without pages which rules cover as a whole; written."""
    count = lambda v: F.sum(F.when(F.col("rule_verdict") == v, F.col("pages")).otherwise(0))
    own = ruled.filter("host <> '' and rule is not null").select("host", "rule_verdict", F.lit(1).cast("long").alias("pages"))
    other = with_rule(targets.join(hosts, "host", "left_anti").withColumn("path", F.lit("/")), rules).filter("rule is not null").select("host", "rule_verdict", "pages")
    return written(own.unionByName(other).groupBy("host").agg(count("allow").alias("allowed"), count("block").alias("blocked")), "url-seeds")


def propagated(links: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """(host, trust, distrust) for every host reached; written. links: source, target, pages; seeds: host, allowed, blocked (counts of pages); both written."""
    out = links.groupBy("source").agg(F.sum("pages").alias("total"))
    back = links.groupBy("target").agg(F.sum("pages").alias("total"))
    share = (F.col("pages") / F.col("total")).alias("share")
    forward = links.join(out, "source").select(F.lit("trust").alias("kind"), F.col("source").alias("at"), F.col("target").alias("to"), share)
    reverse = links.join(back, "target").select(F.lit("distrust").alias("kind"), F.col("target").alias("at"), F.col("source").alias("to"), share)
    ways = written(forward.unionByName(reverse), "url-ways")
    sums = seeds.agg(F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked")).first()
    of = lambda kind, column: seeds.filter(F.col(column) > 0).select(F.lit(kind).alias("kind"), "host", (F.col(column) / F.lit(sums[column] or 1)).alias("part"))
    start = written(of("trust", "allowed").unionByName(of("distrust", "blocked")), "url-start")
    sent, away = None, {"trust": 0, "distrust": 0}
    for i in range(rounds + 1):
        left = F.when(F.col("kind") == "trust", TOTAL - away["trust"]).otherwise(TOTAL - away["distrust"])  # what found no link, and what starts anew
        mass = start.select("kind", "host", F.floor(left * F.col("part")).alias("mass"))
        if sent is not None:
            mass = sent.unionByName(mass).groupBy("kind", "host").agg(F.sum("mass").alias("mass"))
        if i == rounds:
            break
        step = ways.join(mass.withColumnRenamed("host", "at"), ["kind", "at"]).groupBy("kind", F.col("to").alias("host")).agg(F.sum(F.floor(damping * (F.col("mass") * F.col("share")))).alias("mass"))
        moved = Observation()
        step = step.observe(moved, *[F.sum(F.when(F.col("kind") == k, F.col("mass"))).alias(k) for k in away])
        before, sent = sent, written(step, "url-mass")
        away = {k: moved.get[k] or 0 for k in away}
        if before is not None:
            discard(before)
    got = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("mass")).otherwise(0)).alias(kind)
    done = written(mass.groupBy("host").agg(got("trust"), got("distrust")), "url-masses")
    discard(ways, start, *([sent] if sent is not None else []))
    return done


def blocked(ratio: float = 1.0) -> Column:
    return F.col("distrust") > ratio * F.col("trust")


def judge(pages: DataFrame, rules: list[Rule], id: str = "page_id", url: str = "url", html: str = "html", rounds: int = ROUNDS, ratio: float = 1.0) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, trust and distrust of its host (TOTAL is all there is)."""
    ruled = with_rule(with_host(pages.select(id, url, html), url), rules)
    hosts, links, targets = edges(ruled, html)
    seeds = seeds_of(ruled, hosts, targets, rules)
    found = propagated(links, seeds, rounds)
    judged = written(hosts.join(found, "host").select(F.col("host").alias("_host"), "trust", "distrust", F.when(blocked(ratio), "block").otherwise("allow").alias("_verdict")), "url-judged")
    discard(hosts, links, targets, seeds, found)
    return ruled.select(id, "host", "path", "rule", "rule_verdict").join(judged, F.col("host") == F.col("_host"), "left").select(
        id, "host", "path", "rule", F.coalesce("rule_verdict", "_verdict", F.lit("allow")).alias("verdict"), F.coalesce("trust", F.lit(0)).alias("trust"), F.coalesce("distrust", F.lit(0)).alias("distrust"))
