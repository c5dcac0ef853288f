"""Cascades against sets, judgements against every rule in turn."""

import random

from sitelight.llm import urlfilter
from sitelight.llm.common import Scratch
from sitelight.llm.queries import URL_RULES

URLS = [
    "http://a.com/", "https://A.Example.COM/en/x?y#z", "http://www.example.com/en/", "http://xwww.example.com/en/", "http://b.www.example.com/en/1",
    "http://n.net/es/", "http://net/fr/1", "http://net", "http://com", "http://com?x", "no scheme /en/", None, "", "http://", "ftp://h.net/ES/", "x://a.net://b/es/",
    "http://a.net:80/es/", "http://a.net./es/", "http://..com/", "http://a.com/\n/en", "http://example.com/en", "http://example.com/en/#a", "http://a.net/es/" + "p" * 5000,
]


def expected(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [(len(h + p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, "allow", None))
    return host, path, best[3], best[2]


def judged(spark, urls, rules):
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "page_id long, url string, host string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    rows = urlfilter.judge(pages, table).orderBy("page_id").collect()
    return [(r.host, r.path, r.rule, r.verdict) for r in rows]


def test_rules_of_the_query(spark):
    assert judged(spark, URLS, URL_RULES) == [expected(u, URL_RULES) for u in URLS]


def test_random_rules_with_ties_and_copies(spark):
    draw = random.Random(4)
    hosts, paths = ["com", "a.com", "b.a.com", "net", ""], ["", "/", "/x", "/x/", "/xy"]
    rules = [(draw.choice(hosts), draw.choice(paths), draw.choice(["allow", "block"])) for _ in range(12)]
    urls = [f"http://{draw.choice(['', 'c.', 'b.', 'b.a.'])}{draw.choice(['com', 'a.com', 'net'])}{draw.choice(['', '/', '/x', '/x/y', '/xyz'])}" for _ in range(200)]
    assert judged(spark, urls, [*rules, *rules, (None, "/", "block"), ("com", None, "block"), ("com", "/", None)]) == [expected(u, rules) for u in urls]


def test_empty_tables(spark):
    assert judged(spark, [], URL_RULES) == []
    assert judged(spark, ["http://a.com/"], []) == [("a.com", "/", None, "allow")]


def test_cascade_is_exact_over_its_universe(spark):
    keys = [f"host{i}.com/" for i in range(3000)]
    universe = spark.createDataFrame([(k,) for k in keys], "key string")
    inside = keys[::17]
    cascade = urlfilter.build_cascade(universe, spark.createDataFrame([(k,) for k in inside], "key string"), Scratch(spark), "test")
    assert len(cascade) > 1
    assert urlfilter.listed(cascade, keys).tolist() == [k in set(inside) for k in keys]
    bits = sum(level[0] for level in cascade)
    assert bits < 1.44 * len(inside) * 10
