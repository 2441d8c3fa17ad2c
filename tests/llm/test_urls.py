import re

from pyspark.sql import functions as F

from tests.llm.helpers import clashing
from veilspark.llm.queries import URL_RULES
from veilspark.llm.urls import Rule, judge, prefix_rule, rarest_tokens

URLS = [
    None, "", "no scheme", "http://", "http://org", "http://ORG/", "https://a.example.org/es/x?y=/en/1", "http://example.org/en/12#x", "http://example.org/en/2",
    "http://notexample.org/es/", "http://x.com/fr/1", "http://x.com/de/", "http://com.x/de/", "http://a.com:80/de/", "x://y://z.com/de/", "http://x.com?/de/", "http://É.com/de/é", "http://x.com/DE/", "http://x.com/de/" + "a" * 100_000,
]


def plain(url):
    i = (url or "").find("://")
    rest = url[i + 3 :] if i >= 0 else ""
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fit)[1], max(fit)[2]) if fit else (host, path, None, "allow")


def test_against_brute_force(spark):
    rows = [(i, u) for i, u in enumerate(URLS + URLS[-3:])]
    got = judge(clashing(spark.createDataFrame(rows, "page_id long, url string"), "id", "host", "path", "rule", "t", "a_b"), [prefix_rule(*r) for r in URL_RULES])
    for r in got.collect():
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == plain(rows[r["page_id"]][1]), rows[r["page_id"]]
    assert judge(spark.createDataFrame([], "page_id long, url string"), [prefix_rule(*r) for r in URL_RULES]).count() == 0
    assert judge(spark.createDataFrame(rows, "page_id long, url string"), [], otherwise="block").filter("verdict = 'block' and rule is null").count() == len(rows)


def test_rules_are_filed_under_their_rarest_token(spark):
    pages = spark.createDataFrame([(f"http://a{i}.example.org/es/",) for i in range(9)] + [("http://rare.example.org/fr/",)], "url string")
    rules = [prefix_rule("block", "rare.example.org", "/es/"), Rule("ads", "block", r"/ad[s0-9]*/", ("p:es", "h:example"))]
    from veilspark.llm.urls import _tokens, url_host, url_path

    rare = rarest_tokens(pages, _tokens(url_host(F.col("url")), url_path(F.col("url"))), rules)
    assert rare == {"rare.example.org/es/": "h:rare", "ads": "p:es"}


def test_many_rules(spark):
    rules = [prefix_rule("block" if i % 2 else "allow", f"s{i}.example.com", f"/p{i % 7}/") for i in range(800)]
    rows = [(i, f"http://s{i}.example.com/p{i % 7}/x") for i in range(0, 800, 37)] + [(999, "http://s1.example.com/other")]
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in judge(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    for i in range(0, 800, 37):
        assert got[i] == (f"s{i}.example.com/p{i % 7}/", "block" if i % 2 else "allow")
    assert got[999] == (None, "allow")


def test_plan_has_no_python_and_no_shuffle(spark):
    plan = judge(spark.createDataFrame([("http://a.org/",)], "url string"), [prefix_rule(*r) for r in URL_RULES])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_rules_without_tokens_run_for_every_url(spark):
    rules = [prefix_rule("block", "example.org", "/a/"), Rule("digits", "block", r"^[^/]*/[0-9]+$"), Rule("x", "allow", "never")]
    urls = ["http://example.org/a/b", "http://example.com/123", "http://example.com/12x", None, ""]
    got = {r["url"]: (r["rule"], r["verdict"]) for r in judge(spark.createDataFrame([(u,) for u in urls], "url string"), rules).collect()}
    assert got["http://example.org/a/b"] == ("example.org/a/", "block") and got["http://example.com/123"] == ("digits", "block")
    assert got["http://example.com/12x"] == got[None] == got[""] == (None, "allow")
    only = judge(spark.createDataFrame([(u,) for u in urls], "url string"), rules[1:]).filter("rule = 'digits'")
    assert only.count() == 1
