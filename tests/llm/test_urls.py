import re

from corpusbench.llm import urls

URLS = [
    None, "", "no scheme", "http://", "HTTP://A.NET/x", "https://www.example.net/en/1?x#y", "https://example.net/en",
    "http://example.net/EN/1", "http://shop.example.com/de/1", "http://badexample.com/de/1", "http://a.org/fr/",
    "http://a.org/fr", "http://a.b.org?fr/", "http://net", "http://net/", "http://xnet/", "http://a.net#/",
    "https://free-bets.example.com/en/1", "http://a.com/my-CASINO/x", "http://a.com/casinos", "http://a.com/q?casino",
    "ftp://u@poker.de:80/", "http://a.com/é/xxx", "a://b://net/", "http://casino.example.net/en/", "http://a.net/\nx",
]


def expected(url):
    m = re.search("://", url or "")
    rest = url[m.end() :] if m else ""
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for text, verdict in (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")):
        h, p = text.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (not best or len(text) > len(best[0])):
            best = (text, verdict)
    words = re.findall("[a-z0-9]+", (host + path).lower())
    spam = any(w in {p.text.strip("^") for p in urls.PATTERNS} for w in words)
    return host, path, best and best[0], best[1] if best else "block" if spam else "allow"


def test_verdicts(spark):
    pages = spark.createDataFrame([(k, u, "h", "p") for k, u in enumerate(URLS * 2)], "page_id long, url string, host string, rule string")
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages).collect()}
    assert found == {k: expected(u) for k, u in enumerate(URLS * 2)}


def test_index_by_the_rarest_token(spark):
    rules = (*urls.SITES, urls.PatternRule("^buy*now^"), urls.PatternRule("pills"), urls.SiteRule("a.com/de", "block"))
    assert [urls.literal_tokens(r) for r in rules] == [
        ["net"], ["en", "example", "net"], ["com", "de", "example"], ["fr", "org"], [], [], ["a", "com"],
    ]
    index, always = urls.rule_index(rules, {"net": 9, "en": 5, "example": 9, "com": 3, "de": 3, "fr": 1, "org": 7, "a": 0})
    assert index == {"net": [0], "en": [1], "com": [2], "fr": [3], "a": [6]} and always == [4, 5]
    pages = spark.createDataFrame([(1, "http://x/buy-it-now"), (2, "http://x/spills"), (3, "http://a.com/dex")], "page_id long, url string")
    got = {r.page_id: (r.rule, r.pattern) for r in urls.judge(pages, rules[6:], rules[4:6]).collect()}
    assert got == {1: (None, "^buy*now^"), 2: (None, "pills"), 3: ("a.com/de", None)}


def test_empty_table(spark):
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0
