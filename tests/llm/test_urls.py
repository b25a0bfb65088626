"""URL rules against a scan of all rules."""

import random

import pytest
from pyspark.sql import functions as F

from timbre.llm.query_urls import HOST_RULES, PATTERNS
from timbre.llm.urls import Rule, RuleIndex, judge_urls, split_url

RULES = [*HOST_RULES, *PATTERNS]


def plain(url, rules):
    """No index, no regular expressions."""
    text = url or ""
    host = path = ""
    if "://" in text:
        rest = text.split("://", 1)[1]
        end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, rest = "".join(c.lower() if c.isascii() else c for c in rest[:end]), rest[end:]
        path = rest[: min((rest.find(c) for c in "?#" if c in rest), default=len(rest))]
    fits = []
    for rule in rules:
        if not rule.pattern and host:
            own, slash, own_path = rule.text.partition("/")
            if (host == own or host.endswith("." + own)) and path.startswith(slash + own_path) and (slash or path[:1] in ("", "/")):
                fits.append(rule)
    if fits:
        best = min(fits, key=lambda r: (-len(r.text), r.text))
        return host, path, best.text, best.verdict
    return host, path, None, None


ODD = [
    None, "", "example.org/es/", "http://", "://", "http://example.org", "http://EXAMPLE.org/es/", "http://xexample.org/es/", "http://a.b.example.org/en/12?x#y",
    "http://example.org/en/1", "http://org/", "http://.org/x", "https://example.org?/es/", "https://example.org#/es/", "http://x.com/fr/", "http://x.com/FR/", "http://x.com/de/y\nz",
    "http://x.com:80/fr/", "http://user@x.com/fr/1", "http://a/http://example.org/es/", "http://www.cheap-pills.example.com/en/", "http://cheap-pillsx.net/", "ftp://É.ORG/ß", "http://x.net/" + "a/" * 50_000,
]


@pytest.mark.parametrize("url", ODD)
def test_split_and_rules(url):
    index = RuleIndex(RULES)
    host, path, rule, verdict = index.judge(url)
    assert (host, path) == split_url(url) == plain(url, RULES)[:2]
    assert rule == plain(url, RULES)[2] and (rule is None or verdict == plain(url, RULES)[3])


def test_patterns():
    index = RuleIndex(RULES)
    verdict = lambda u: index.judge(u)[3]
    assert verdict("http://www.Cheap-Pills.example.com/en/1") == "block" and verdict("http://cheap-pillsx.example.com/en/1") == "allow"
    assert verdict("http://x.net/wp-login.php") == "block" and verdict("http://x.net/wp-login.phpx") == "allow"
    assert verdict("http://a.example.net/x?sessionid=3") == "block" and verdict("http://a.net/x?sessionid=3") == "allow"
    assert index.judge("http://spam-farm.example.org/en/728")[2:] == ("org/", "allow")


def test_random_rules_and_urls_by_any_counts():
    draw = random.Random(3)
    labels, parts = ["a", "b1", "co", "org", "x-y"], ["", "en", "e", "1", "12", "fr", "x-y"]
    rules = [Rule(draw.choice(["allow", "block"]), ".".join(draw.choices(labels, k=draw.randint(1, 3))) + draw.choice(["", "/"]) + "/".join(draw.choices(parts, k=draw.randint(0, 2)))) for _ in range(60)]
    rules = [r for r in rules if "/" in r.text or not r.text.endswith("-")]
    rules = list({r.text: r for r in rules}.values())
    urls = ["http://" + ".".join(draw.choices(labels, k=draw.randint(1, 4))) + draw.choice(["", "/", "?q", "#f"]) + "/".join(draw.choices(parts, k=draw.randint(0, 3))) for _ in range(400)]
    for counts in ({}, {t: draw.randint(0, 9) for t in ["a", "b1", "co", "org", "x", "y", "en", "e", "1", "12", "fr"]}):
        index = RuleIndex(rules, counts)
        for url in urls:
            want = plain(url, rules)
            got = index.judge(url)
            assert got[:3] == want[:3], url
            assert want[2] is None or got[3] == want[3]


def test_only_fetched_rules_run():
    index = RuleIndex([Rule("block", "example.org/es/"), Rule("block", "*x*", pattern=True)], {"example": 90, "org": 50, "es": 2})
    assert list(index.filed) == ["es"] and len(index.always) == 1


def test_table(spark):
    rows = [(k, u, f"v{k}", "r") for k, u in enumerate(ODD)] + [(0, None, "again", "r"), (None, "http://x.com/fr/", None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, verdict string, `odd.name` string")
    found = judge_urls(pages, RULES)
    assert found.columns == ["page_id", "url", "odd.name", "host", "path", "rule", "verdict"]
    index = RuleIndex(RULES)
    got = sorted(map(repr, ((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in found.collect())))
    assert got == sorted(map(repr, ((p, *index.judge(u)) for p, u, *_ in rows)))
    assert judge_urls(pages.filter(F.lit(False)), RULES).collect() == []
    assert {r.verdict for r in judge_urls(pages, []).collect()} == {"allow"}
