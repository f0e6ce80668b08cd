"""URL filter against a plain reading of the rules."""

import itertools

import pytest

from tidemark.llm import urls

URLS = [None, "", "no scheme", "http://", "http://NET", "http://net/", "http://a.net/x", "http://anet/x", "https://Ex.Example.NET/en/",
        "https://example.net/en", "https://example.net/en/x?y#z", "https://example.net?/en/", "ftp://example.com/de/1", "x://b.example.com/DE/",
        "http://org/fr/", "http://w.org/fr", "http://user@w.org:80/fr/", "http://.net/", "http://net./", "a://b://net/en/", "http://é.ORG/fr/É",
        "http://" + "a." * 3000 + "net/" + "p/" * 3000, "http://example.com/den/x", "http://org\n.net/fr/\n"]


def plain(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        n = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:n])
        m = next((i for i, c in enumerate(rest[n:]) if c in "?#"), len(rest) - n)
        path = rest[n:n + m]
    fits = [(len(h) + len(p), len(h), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, default, None))
    return host, path, best[3], best[2]


@pytest.mark.parametrize("rules", [urls.RULES, [], [("allow", "net", "/"), ("block", "net", "/")],
                                   [("block", "net", "/e"), ("allow", "example.net", ""), ("block", "com", "/de"), ("allow", "org", "/fr/\n")]])
def test_trie_and_join_against_plain_rules(spark, rules):
    pages = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(URLS + URLS)], "page_id long, url string, host string, rule int")
    for limit in (1 << 20, -1):
        got = {r.page_id: tuple(r)[1:] for r in urls.judge(pages, rules, max_rules_bytes=limit).collect()}
        assert got == {i: plain(u, rules) for i, u in enumerate(URLS + URLS)}


def test_every_small_path(spark):
    rules = [("block", "a", "/x"), ("allow", "a", "/x/"), ("block", "b.a", "/"), ("allow", "b.a", "/x/y")]
    hosts = ["a", "b.a", "ba", "c.b.a"]
    paths = ["".join(p) for n in range(5) for p in itertools.product("/xy", repeat=n)]
    all_urls = [f"s://{h}{p}" for h in hosts for p in paths]
    pages = spark.createDataFrame(list(enumerate(all_urls)), "page_id long, url string")
    got = {r.page_id: tuple(r)[1:] for r in urls.judge(pages, rules).collect()}
    assert got == {i: plain(u, rules) for i, u in enumerate(all_urls)}
    assert urls.judge(pages.limit(0), rules).count() == 0
