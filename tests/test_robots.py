import random
import re

import pytest

from webledger.operators import robots
from webledger.params import ROBOTS_CAPTURES


def allowed(spark, text, urls, agent="*", status=200, error=None, hot_rows=1_000_000):
    captured = spark.createDataFrame([("example.com", status, text, error)], ROBOTS_CAPTURES)
    asked = spark.createDataFrame([(u,) for u in urls], "url string")
    rows = robots.robots_allows(asked, captured, agent, hot_rows=hot_rows).collect()
    by_url = {r.url: r.allowed for r in rows}
    return [by_url[u] for u in urls]


def on(*paths):
    return [f"https://example.com{p}" for p in paths]


CASES = [
    ("User-agent: *\nDisallow: /private", ["/private", "/public"], [False, True]),
    ("User-agent: *\nDisallow: /*q=", ["/search?q=x", "/about"], [False, True]),
    ("User-agent: *\nDisallow: /search$", ["/search", "/search/x"], [False, True]),
    ("User-agent: *\nDisallow: /*/*/pulse", ["/a/b/pulse", "/a/pulse"], [False, True]),
    ("User-agent: *\nDisallow: /*.gif$", ["/a.gif", "/a.gif?x", "/a.gif.gif"], [False, True, False]),
    ("User-agent: *\nDisallow: /p\nAllow: /p/open", ["/p/x", "/p/open/1"], [False, True]),
    ("User-agent: *\nDisallow: /same\nAllow: /same", ["/same"], [True]),
    ("User-agent: *\nDisallow:", ["/x"], [True]),
    ("Disallow: /x\nUser-agent: *\nDisallow: /y # why", ["/x", "/y"], [True, False]),
    ("user-agent: a\nuser-agent: *\r\nDISALLOW : /z\n\nUser-agent: b\nDisallow: /", ["/z", "/x"], [False, True]),
    ("User-agent: *\nSitemap: https://e/s.xml\nDisallow: /z", ["/z"], [False]),
    ("User-agent: *\nDisallow: /a.b(c)", ["/a.b(c)", "/aXb(c)"], [False, True]),
    ("User-agent: *\nDisallow: /*é", ["/caf%C3%A9"], [False]),
    ("", ["/x"], [True]),
]


@pytest.mark.parametrize(("text", "paths", "wanted"), CASES)
def test_rules(spark, text, paths, wanted):
    assert allowed(spark, text, on(*paths)) == wanted


def test_many_wildcards_do_not_backtrack(spark):
    text = "User-agent: *\nDisallow: /" + "*a" * 40 + "b"
    assert allowed(spark, text, on("/" + "a" * 5000)) == [True]


def test_own_group_before_the_common_one(spark):
    text = "User-agent: *\nDisallow: /\n\nUser-agent: Probe\nDisallow: /x\n\nUser-agent: probe\nDisallow: /y"
    assert allowed(spark, text, on("/x", "/y", "/z"), agent="Probe/1.0") == [False, False, True]
    assert allowed(spark, text, on("/z"), agent="other") == [False]


@pytest.mark.parametrize(
    ("status", "text", "error", "wanted"),
    [(404, None, None, True), (500, "User-agent: *", None, False), (None, None, "refused", False),
     (200, None, None, True), (301, "User-agent: *\nDisallow: /", None, True)],
)
def test_host_states(spark, status, text, error, wanted):
    assert allowed(spark, text, on("/private"), status=status, error=error) == [wanted]


def test_hosts_without_capture_and_salted_hosts(spark):
    urls = on(*[f"/private/{i}" for i in range(20)]) + ["https://unknown.com/private"]
    got = allowed(spark, "User-agent: *\nDisallow: /private/1", urls, hot_rows=3)
    assert got == [f"/{i}".startswith("/1") is False for i in range(20)] + [True]


def test_rules_as_a_table(spark):
    text = "User-agent: a\nUser-agent: *\nAllow: /x\nDisallow: /y\nDisallow:\nUser-agent: c\nDisallow: /"
    rules = robots.parse_robots(spark.createDataFrame([("h", 200, text, None)], ROBOTS_CAPTURES))
    rows = sorted((r.agent, r.allow, r.pattern, r.pattern_len) for r in rules.collect())
    assert rows == [("*", False, "/y", 2), ("*", True, "/x", 2), ("a", False, "/y", 2), ("a", True, "/x", 2), ("c", False, "/", 1)]
    assert {r.agent for r in robots.select_group(rules, "c").collect()} == {"c"}
    assert {r.agent for r in robots.select_group(rules, "zzz").collect()} == {"*"}


def plain_fit(pattern, target):
    """Rules of RFC 9309, one pattern and one path."""
    anchored = pattern.endswith("$")
    pieces = (pattern[:-1] if anchored else pattern).split("*")
    return re.match("".join([".*".join(map(re.escape, pieces)), "$" if anchored else ""]), target, re.DOTALL) is not None


@pytest.mark.parametrize("hot_rows", [1_000_000, 50])
def test_thousands_of_rules_on_one_host(spark, hot_rows):
    rng = random.Random(6)

    def path():
        return "/" + "/".join(rng.choice(["a", "b", "item", "x1", "new"]) for _ in range(rng.randrange(1, 5)))

    rules = [(rng.random() < 0.4, path()[: rng.randrange(1, 14)]) for _ in range(4990)]
    rules += [(True, "/*/item$"), (False, "/a*b"), (False, "/*"), (True, "/x1/*/new"), (False, "/b/item?q=*$"), (True, "/b/item?q="),
              (False, "/new/new/new$"), (True, "/item/*$"), (False, "/*a$"), (True, "/x1")]
    paths = sorted({path() for _ in range(150)} | {"/b/item?q=1", "/zzz", "/", "/x1/a/b/new/a"})
    text = "User-agent: *\n" + "\n".join(f"{'Allow' if allow else 'Disallow'}: {p}" for allow, p in rules)

    def decided(target):
        fitting = [(len(p), allow) for allow, p in rules if plain_fit(p, target)]
        return max(fitting)[1] if fitting else True

    assert allowed(spark, text, on(*paths), hot_rows=hot_rows) == [decided(p) for p in paths]
    table = spark.createDataFrame([("example.com", *r) for r in rules], "host string, allow boolean, pattern string")
    asked = spark.createDataFrame([(u,) for u in on(*paths)], "url string")
    got = {r.url: r.matches for r in robots.match_rule_rows(asked, robots.rule_rows(table)).collect()}
    assert [got.get(u, 0) for u in on(*paths)] == [sum(plain_fit(p, t) for _, p in rules) for t in paths]


def test_few_rules_stay_packed_beside_many(spark):
    many = "User-agent: *\n" + "\n".join(f"Disallow: /{i}/" for i in range(robots.PACKED_RULES + 1))
    captured = spark.createDataFrame([("many.test", 200, many, None), ("few.test", 200, "User-agent: *\nDisallow: /7", None),
                                      ("down.test", 503, None, None)], ROBOTS_CAPTURES)
    urls = ["https://many.test/7/x", "https://many.test/7", "https://few.test/7/x", "https://few.test/8", "https://down.test/", "https://none.test/7"]
    asked = spark.createDataFrame([(u,) for u in urls], "url string")
    by_url = {r.url: r.allowed for r in robots.robots_allows(asked, captured).collect()}
    assert [by_url[u] for u in urls] == [False, True, False, True, False, True]
    assert robots.wide_rules(robots.robots_hosts(captured)).select("host").distinct().count() == 1


def test_rules_of_one_prefix_are_told_apart_by_their_ends_and_counted_once(spark):
    rules = [(i % 2 == 0, f"/*-{i}.html$") for i in range(300)] + [(i == 7, "/en") for i in range(300)]
    rules += [(False, "/en/a$"), (True, "/*$"), (True, "/e*n/a$"), (False, "/*/a*$"), (False, "/$x$"), (True, "/en/a$"), (False, "/*n/*a$")]
    table = spark.createDataFrame([("one.test", *r) for r in rules], "host string, allow boolean, pattern string")
    by_ends = robots._by_ends(robots.rule_rows(table))
    lists = {(r.prefix, r.suffix): r["_rules"] for r in by_ends.collect()}
    # no list grows with the rules that begin alike
    assert max(map(len, lists.values())) == 2 and [(r.copies, r.allow) for r in lists["/en", ""]] == [(300, True)]
    paths = ["/x-3.html", "/x-4.html", "/en/y-123.html", "/en", "/en/a", "/e", "/enn/a", "/$x", "/a", "/en/a/n/a", "/-7.html"]
    asked = spark.createDataFrame([(f"https://one.test{p}",) for p in paths], "url string")
    got = {r.url: (r.matches, r.allow) for r in robots.match_rule_rows(asked, robots.rule_rows(table)).collect()}
    for p in paths:
        fitting = [(len(q), allow) for allow, q in rules if plain_fit(q, p)]
        want = (len(fitting), max(fitting)[1]) if fitting else None
        assert got.get(f"https://one.test{p}") == want, p
