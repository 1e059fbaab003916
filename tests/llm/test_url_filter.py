from pyspark.sql import functions as F

from graphloom.llm import url_filter as U

RULES = [("a.com", "/", "block"), ("b.a.com", "/x/", "allow"), ("org", "", "block"), ("A.com", "/", "allow"), (None, "/", "block")]
URLS = {
    "http://a.com/q": ("a.com", "/q", "a.com/", "block"), "http://B.a.com/x/y?z#w": ("b.a.com", "/x/y", "b.a.com/x/", "allow"), "http://b.a.com/xy": ("b.a.com", "/xy", "a.com/", "block"),
    "http://ba.com/": ("ba.com", "/", None, "allow"), "http://a.com": ("a.com", "", None, "allow"), "x://v.org": ("v.org", "", "org", "block"), None: ("", "", None, "allow"), "": ("", "", None, "allow"),
    "a.com/q": ("", "", None, "allow"), "http://a.com.net//l/?b=2&a=1&utm_x=3#f": ("a.com.net", "//l/", None, "block"), "https://A.com.net:443/l?a=1&b=2": ("a.com.net:443", "/l", None, "block"),
    "https://a.com.net/l?a=1": ("a.com.net", "/l", None, "allow"), "://": ("", "", None, "allow"), "http://?x": ("", "", None, "allow"),
}


def test_rules_and_list(spark):
    rows = [(i, u, "clash", "clash") for i, u in enumerate(URLS)] + [(0, "http://a.com/q", None, "x"), (None, "http://a.com/q", None, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, listed string")
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    listed = spark.createDataFrame([("http://a.com.net/l/?b=2&a=1",), (None,), ("no url",)], "url string")
    got = U.filter_urls(pages, rules, listed).collect()
    assert len(got) == len(rows)
    want = list(URLS.values())
    for r in got:
        i = 0 if r.page_id is None else r.page_id
        assert (r.host, r.path, r.rule, r.verdict) == want[i], list(URLS)[i]
    none = U.filter_urls(pages, rules.limit(0), listed.limit(0)).collect()
    assert len(none) == len(rows) and {r.verdict for r in none} == {"allow"} and {r.listed for r in none} == {False}
    assert U.filter_urls(pages.limit(0), rules, listed).count() == 0


def brute(url):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    host = rest[: min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))]
    tail = rest[len(host) :]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    best = max((((len(h + p), len(h)), h + p, a) for a, h, p in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)), default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_against_brute_force(spark):
    hosts = ["com", "example.com", "EXAMPLE.com", "www.example.com", "a.www.example.com", "xexample.com", "net", "a.net", "spam-farm.example.org", "x.spam-farm.example.net", "örg.ORG", ""]
    urls = [f"http://{h}{p}" for h in hosts for p in ("", "/", "/en/1x", "/en", "/es/", "/fr/x?a=/en/#b", "?q=/en/", "#/en/", "/EN/")] + [None, "", "no scheme", "://", "http://a.com://b.net/es/"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    rules = spark.createDataFrame([(h, p, a) for a, h, p in U.RULES], "host string, path string, action string")
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in U.filter_urls(pages, rules, U.listed_urls(spark)).collect())
    assert got == sorted((i, *brute(u)) for i, u in enumerate(urls))


def test_canonical(spark):
    urls = {"HTTP://Ex.COM:80//a//b/?z=1&y=2&utm_s=q#f": "ex.com/a/b?y=2&z=1", "https://ex.com": "ex.com/", "https://ex.com/?": "ex.com/", "ftp://ex.com/A": "ex.com/A", "ex.com/a": None, "x:///p": None}
    rows = spark.createDataFrame([(u,) for u in urls], "u string")
    assert {r.u: r.c for r in rows.select("u", U.canonical_url(F.col("u")).alias("c")).collect()} == urls


def test_filter_passes_all_listed_and_few_others(spark):
    listed = spark.range(20_000).select(F.concat(F.lit("h.com/"), F.col("id").cast("string")).alias("key"))
    others = spark.range(20_000, 60_000).select(F.concat(F.lit("h.com/"), F.col("id").cast("string")).alias("key"))
    assert U.build_filter(listed, 625).count() == 625  # all blocks in use
    assert U.possible(listed, listed, 20_000).count() == 20_000
    assert 0 < U.possible(others, listed, 20_000).count() < 0.02 * 40_000
