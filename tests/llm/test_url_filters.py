import re

from daymosaic.llm import url_filters as U

URLS = ["https://a.example.com/en/1", "http://WWW.Example.com/en/x?q#f", "https://x.net/es/", "https://net/fr/1", "https://fnet/es/",
        "https://example.com:8080/en/", "https://example.com", "https://example.com?/en/", "ftp://b.net/ES/", None, "", "nourl",
        "a://b://c.com/", "://.net/es/z", "https://m.ads-track.example.org/q", "https://x.org/doubleclick/1",
        "https://x.org/popunder", "https://x.org/popunders", "https://x.org/robots.txt", "https://adserver.org/",
        "http://x.com/\nen/", "https://É.com/a", "https://x.com/" + "a" * 50000]


def plain(url):
    """Every rule on every url."""
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in re.split(r"[/?#]", rest)[0])
    path = re.split(r"[?#]", rest[len(host):])[0]
    best = None
    for action, rule in U.SITE_RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = (action, rule)
    if best:
        return host, path, best[1], best[0]
    fit = [r for r in U.make_rules([], U.PATTERN_RULES) if re.search(r.regex, host + path, re.S)]
    fit.sort(key=lambda r: (-len(r.text), r.text))
    return host, path, None, fit[0].action if fit else "allow"


def test_judge_equals_all_rules_on_all_urls(spark):
    df = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(URLS)], "page_id long, url string, host string, rule string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in U.judge(df).collect()}
    assert got == {i: plain(u) for i, u in enumerate(URLS)}


def test_rules_meet_urls_by_their_rarest_token(spark):
    rules = U.make_rules([("block", f"site{i}.org/x/") for i in range(500)], [("block", "tail*xyz|"), ("block", "*")])
    df = spark.createDataFrame([(1, "http://a.site7.org/x/y"), (2, "http://o.org/tail/aaxyz"), (3, "http://o.org/")],
                               "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["pattern"], r["verdict"]) for r in U.judge(df, rules=rules).collect()}
    assert got == {1: ("site7.org/x/", None, "block"), 2: (None, "tail*xyz|", "block"), 3: (None, "*", "block")}
    assert U.make_rule("block", "tail*xyz|", False).tokens == ()
    assert U.make_rule("block", "||a.b/c", False).tokens == ("a", "b")


def test_empty_table_null_ids_and_repeated_rows(spark):
    assert U.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0
    df = spark.createDataFrame([(None, "http://x.com/"), (1, None), (1, None)], "page_id long, url string")
    assert U.judge(df).count() == 3
