import random

from pyspark.sql import functions as F

from galleon.llm import queries, url_filter as op

URLS = [
    "https://A.Example.org/es/1?x#y", "http://example.org/en/17", "http://www.example.org/en", "ftp://x.com/fr/", "x.com/de/", "http://y.com/de/?a://b.org/",
    "http://com/fr/1", "http://org", "http://org/", "http://notexample.org/es/", None, "", "://", "http://u:p@h.com:80/fr/a", "http://é.Org/Ä", "http://a.net#/b", "http://spam-farm.example.net/a\nb",
]


def brute(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    path = rest[cut:]
    return host, path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]


def test_rules_against_brute_force(spark):
    rows = list(enumerate(URLS + URLS[:2]))
    pages = spark.createDataFrame([(i, u, None, "h") for i, u in rows], "page_id long, url string, html string, host string")
    sites = pages.select(op.site_of(op.host_of(F.col("url"))))
    listed = spark.createDataFrame([(s,) for s in queries.LISTED_SITES], "key string")
    found = {r.page_id: r for r in op.judge(pages, queries.URL_RULES, op.Cascade.build(listed, sites)).collect()}
    assert len(found) == len(rows)
    for i, u in rows:
        host, path = brute(u)
        fit = [r for r in queries.URL_RULES if (("." + host).endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
        rule = max(fit, key=len, default=None)
        site = ".".join(host.split(".")[-3:])
        want = queries.URL_RULES[rule] if rule else "block" if site in queries.LISTED_SITES else "allow"
        assert (found[i].host, found[i].path, found[i].rule, found[i].verdict) == (host, path, rule, want)


def test_cascade_is_exact(spark):
    r = random.Random(0)
    keys = [f"k{i}" for i in range(3000)]
    listed = r.sample(keys, 400)
    universe = spark.createDataFrame([(k,) for k in keys + keys[:5] + [None]], "key string")
    cascade = op.Cascade.build(spark.createDataFrame([(k,) for k in listed + [None, "elsewhere"]], "key string"), universe)
    assert len(cascade.levels) > 1
    found = {x.key: x.hit for x in universe.select("key", cascade.contains(F.col("key")).alias("hit")).collect()}
    assert {k for k, hit in found.items() if hit} == set(listed)


def test_empty_list_and_empty_table(spark):
    none = spark.createDataFrame([], "key string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    cascade = op.Cascade.build(none, none)
    assert op.judge(pages, {}, cascade).collect() == []
