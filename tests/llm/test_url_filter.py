import random

from cohortry.llm import url_filter
from cohortry.llm.queries import URL_RULES
from cohortry.llm.url_filter import Rule


def brute(url, rules, default="allow"):
    if url is None or "://" not in url:
        return "", "", None, default
    rest = url.split("://", 1)[1]
    cuts = [rest.find(c) for c in "/?#" if c in rest]
    host = rest[: min(cuts)] if cuts else rest
    path = rest[len(host) :]
    for c in "?#":
        path = path.split(c)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fitting = [
        r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)
    ]
    if not fitting:
        return host, path, None, default
    best = max(fitting, key=lambda r: (len(r.host.split(".")), len(r.path), r.verdict))
    return host, path, best.place, best.verdict


def frame(spark, urls):
    return spark.createDataFrame(
        [(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string"
    )


def test_trie_and_join_agree_with_brute_force(spark):
    draw = random.Random(1)
    hosts = ["com", "a.com", "www.a.com", "A.Com", "acom", "net", "b.net", ".com", "com.", "a..com", ""]
    paths = ["", "/", "/en/", "/en", "/english", "/en/x", "//", "/en//", "/es/?q=/en/", "/fr/#/es/", "?x/en/"]
    urls = [f"{draw.choice(['http', 'HTTPS'])}://{h}{p}" for h in hosts for p in paths]
    urls += [None, "", "no scheme", "://", "http://a.com/\n/en/", "a://b://c.com/", "http://" + "x" * 50_000]
    rules = [
        Rule.of("allow", "com/"), Rule.of("block", "a.com/en"), Rule.of("allow", "a.com/en/"),
        Rule.of("block", "A.com/en/"), Rule.of("block", "net"), Rule.of("allow", "b.net//"), *URL_RULES,
    ]
    pages = frame(spark, urls)
    expected = {i: brute(u, rules) for i, u in enumerate(urls)}
    for judged in (
        url_filter.judge(pages, rules, ["page_id"]),
        url_filter.judge(pages, rules, ["page_id"], most_broadcast_rules=2),
    ):
        found = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in judged.collect()}
        assert found == expected


def test_empty_table_and_repeated_rows(spark):
    assert url_filter.judge(frame(spark, ["x"]).where("false"), URL_RULES, ["page_id"]).count() == 0
    pages = frame(spark, ["http://example.com/en/"])
    rows = url_filter.judge(pages.union(pages), URL_RULES, ["page_id"]).collect()
    assert [r["verdict"] for r in rows] == ["block", "block"]


def test_a_rule_needs_a_host():
    for place in ("", "/en/"):
        try:
            Rule.of("block", place)
        except ValueError:
            continue
        raise AssertionError(place)
