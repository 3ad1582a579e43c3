import math
import os
import re
from collections import Counter, defaultdict

import pytest

from quarry.llm import queries, urls

DIR = os.environ.get("QUARRY_TEST_DIR", "/root/testdata/sf0.001")

PAGES = [
    (1, "http://A.Example.NET/en/x?y", '<a href="https://good.org/z">g</a>'), (2, "http://a.example.net/de/", "c www.mid.com, x@no.com"), (3, "http://good.org/fr/1", "<a href='//rel'>see Mid.com.</a>"),
    (4, "http://mid.com/", '<a href="http://bad.net/">'), (5, "http://farm.com/x", '<img src="http://bad.net/i"><a href="http://bad.net">'), (6, "http://bad.net/", None), (7, None, None), (8, "no scheme", "mid.com"),
    (9, "x://y://z.net/p#q", ""), (10, "http://net", ""), (11, "http://sub.example.com/de/x", ""), (12, "http://notexample.com/de/x", "good.org"), (13, "http://net/", ""), (14, "", ""), (5, "http://farm.com/x", ""),
    (15, "http://good.org/en/", "mid.com"), (16, "http://Example.com?/de/", ""),
]


def brute(pages, rules, rounds=urls.ROUNDS):
    low = lambda x: re.sub("[A-Z]", lambda y: y[0].lower(), x)
    rule_of = lambda host, path: max((r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])), key=lambda r: len(r[1] + r[2]), default=None)
    split = []
    for i, u, h in pages:
        m = re.search(r"://([^/?#]*)([^?#]*)", u or "")
        host, path = (low(m[1]), m[2]) if m else ("", "")
        split.append((i, host, path, rule_of(host, path), h or ""))
    own = Counter(host for _, host, *_ in split if host)
    links, targets, seeds = Counter(), Counter(), {"trust": Counter(), "distrust": Counter()}
    kind = lambda rule: "trust" if rule[0] == "allow" else "distrust"
    for _, host, _, fit, h in split:
        if host:
            linked = {low(x) for x in re.findall(urls.LINK, h)}
            named = {low(x).strip(".-_") for x in re.findall(urls.NAMED, h) if "." in x and not re.search("[@/:]", x)} - linked
            for t in (linked | (named & set(own))) - {host, ""}:
                links[host, t] += 1
            targets.update(linked - {host, ""})
            if any(not re.search(urls.ELSEWHERE, x) for x in re.findall(urls.ADDRESS, h)):
                links[host, host] += 1
            if fit:
                seeds[kind(fit)][host] += 1
    for t, n in targets.items():
        if t not in own and (fit := rule_of(t, "/")):
            seeds[kind(fit)][t] += n
    for host, n in (own + targets).items():
        labels = host.split(".")
        if len(host) <= urls.LONGEST and "" not in labels and not re.fullmatch("[0-9]*", labels[-1]):
            for i in range(len(labels) - 2):
                below, above = ".".join(labels[i:]), ".".join(labels[i + 1 :])
                links[below, above] += n
                links[above, below] += n
    mass = {}
    for kind_, start in seeds.items():
        way = {(a, b) if kind_ == "trust" else (b, a): n for (a, b), n in links.items()}
        out = Counter()
        for (a, _), n in way.items():
            out[a] += n
        part = {h: n / sum(start.values()) for h, n in start.items()}
        sent = {}
        for i in range(rounds + 1):
            left = urls.TOTAL - sum(sent.values())
            now = defaultdict(int, sent)
            for h, x in part.items():
                now[h] += math.floor(left * x)
            if i < rounds:
                sent = defaultdict(int)
                for (a, b), n in way.items():
                    if a in now:
                        sent[b] += math.floor(urls.DAMPING * (now[a] * (n / out[a])))
        mass[kind_] = now
    out = []
    for i, host, path, fit, _ in split:
        t, d = (mass[k].get(host, 0) for k in ("trust", "distrust"))
        bad = host and d > t
        out.append((i, host, path, fit and fit[1] + fit[2], fit[0] if fit else ("block" if bad else "allow"), t if host else 0, d if host else 0))
    return sorted(out, key=str)


def found(spark, path, pages):
    spark.createDataFrame([(*p, "extra") for p in pages], "page_id long, url string, html string, host string").write.parquet(f"{path}/pages.parquet")
    return sorted((tuple(r) for r in queries.op6_url_filter(spark, str(path)).collect()), key=str)


def test_query_matches_brute_force(spark, tmp_path):
    got = found(spark, tmp_path, PAGES)
    assert got == brute(PAGES, queries.URL_RULES)
    assert {(r[1], r[4]) for r in got} >= {("farm.com", "block"), ("mid.com", "allow")}


def test_hosts_only_linked_to_are_seeds_and_long_hosts_are_taken(spark, tmp_path):
    pages = [(1, "http://leads.com/", "<a href=//far.away.net/>"), (2, "http://leads.com/x", '<meta content="0; URL=http://far.away.net">'), (3, "http://calm.com/", '<a href="/in">')]
    pages += [(4 + i, f"http://calm{i}.com/", "") for i in range(6)]
    many = "a." * 200_000 + "zz"
    got = found(spark, tmp_path, [*pages, (20, f"http://{many}/", f"{many} {'b' * 300_000} href={' ' * 200_000}x"), (21, "http://10.0.0.1/", "")])
    assert got == brute([*pages, (20, f"http://{many}/", f"{many} {'b' * 300_000} href={' ' * 200_000}x"), (21, "http://10.0.0.1/", "")], queries.URL_RULES)
    assert {r[0] for r in got if r[4] == "block"} == {1, 2}


def test_attributes_in_upper_case_are_links(spark, tmp_path):
    pages = [(1, "http://loud.com/", '<A HREF="http://bad.net/x">'), (2, "http://still.com/", '<META CONTENT="0;URL=http://bad.net">'), (3, "http://calm.com/", '<A HREF="/in">'), (4, "http://x.bad.net/", "")]
    pages += [(5, "http://seen.com/", '<IMG Src="//bad.net/i">'), (6, "http://good.org/fr/", "")]
    got = found(spark, tmp_path, pages)
    assert got == brute(pages, queries.URL_RULES)
    assert {r[0] for r in got if r[4] == "block"} == {1, 2, 4, 5}


@pytest.mark.skipif(not os.path.isdir(DIR), reason="the tables are not here")
def test_propagation_decides_on_the_given_pages(spark):
    pages = [tuple(r) for r in spark.read.parquet(f"{DIR}/pages.parquet").select("page_id", "url", "html").collect()]
    got = sorted((tuple(r) for r in queries.op6_url_filter(spark, DIR).collect()), key=str)
    assert got == brute(pages, queries.URL_RULES)
    seeds_alone = brute(pages, queries.URL_RULES, rounds=0)
    assert any(a[4] != b[4] for a, b in zip(got, seeds_alone, strict=True))


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert queries.op6_url_filter(spark, str(tmp_path)).count() == 0
