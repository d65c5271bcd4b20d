import random

import pytest
from pyspark.sql import functions as F

from webledger.functions import html, punycode
from webledger.functions import urls as rules
from webledger.operators import urls

# Own cases for each rule; dots and escapes after the examples of RFC 3986, sections 5.2.4 and 6.2.2.
CANONICAL = [
    ("https://shop.test/item#reviews", "https://shop.test/item"),
    ("https://shop.test/find?size=9&brand=x&colour=red", "https://shop.test/find?brand=x&colour=red&size=9"),
    ("HTTP://Shop.TEST/Item/ABC", "http://shop.test/Item/ABC"),
    ("https://shop.test:443", "https://shop.test/"),
    ("http://shop.test:80/?q=1", "http://shop.test/?q=1"),
    ("http://shop.test:443/", "http://shop.test:443/"),
    ("https://shop.test/i?gclid=7&n=2&utm_medium=mail&utm_term=", "https://shop.test/i?n=2"),
    ("https://shop.test/i?Utm_Medium=mail&GCLID=7", "https://shop.test/i?GCLID=7&Utm_Medium=mail"),
    ("https://shop.test/i?fbclid=Z#f", "https://shop.test/i"),
    ("https://shop.test/i?sale&n=", "https://shop.test/i?n=&sale="),
    ("https://shop.test/a/b/c/./../../g", "https://shop.test/a/g"),
    ("https://shop.test/mid/content=5/../6", "https://shop.test/mid/6"),
    ("https://shop.test/../g/..", "https://shop.test/"),
    ("https://shop.test//a///b", "https://shop.test/a/b"),
    ("https://shop.test/two words", "https://shop.test/two%20words"),
    ("shop.test/i", "https://shop.test/i"),
    ("localhost:81/i", "https://localhost:81/i"),
    ("//Static.shop.test/i", "https://static.shop.test/i"),
    ("https://shop.test/i?", "https://shop.test/i"),
    ("https://shop.test/i/", "https://shop.test/i/"),
    ("https://shop.test/%7Esmith/%e2%82%ac", "https://shop.test/~smith/%E2%82%AC"),
    ("https://shop.test/\u20ac%2f+%q", "https://shop.test/%E2%82%AC%2F+%25q"),
    ("https://shop.test/i?x=a+b&x=%7E*/&=y&&z", "https://shop.test/i?=y&x=a%20b&x=~%2A%2F&z="),
    ("https://shop.test/i?k=\u00e9&k=z&k=a%20b&k=a-b", "https://shop.test/i?k=a%20b&k=a-b&k=z&k=%C3%A9"),
    ("https://shop.test/i?a!=1&a=2&x=%26%3D", "https://shop.test/i?a=2&a%21=1&x=%26%3D"),
    ("  https://example.com/a\n", "https://example.com/a"),
    ("https://example.com/a\n", "https://example.com/a"),
    ("https://user@Example.com", "https://user@example.com/"),
    ("http://[::1]:8080/x", "http://[::1]:8080/x"),
    ("http://[::ffff:1.2.3.4]/", "http://[::ffff:1.2.3.4]/"),
    ("http://[::1", None),
    ("http://a]b/", None),
    ("http://[zz]/", None),
    ("http://[1:2:3:4:5:6:7:8:9]/", None),
    ("https://B\u00dccher.test:443/\u00fc", "https://xn--bcher-kva.test/%C3%BC"),
    ("http://me@\u65e5\u672c\u3002m\u00fcnchen.test:8080", "http://me@xn--wgv71a.xn--mnchen-3ya.test:8080/"),
    ("https://XN--BCHER-KVA.test/", "https://xn--bcher-kva.test/"),
    ("mailto:a@b.com", "mailto:a@b.com"),
    ("tel:911", "tel:911"),
    ("", ""),
]


def test_canonical_forms_and_idempotence(spark):
    df = spark.createDataFrame(CANONICAL, "url string, wanted string")
    once = rules.canonicalize(df)
    twice = rules.canonicalize(once, "url_norm", "again").collect()
    assert [(r.url, r.url_norm) for r in twice] == CANONICAL
    assert [r.again for r in twice] == [r.url_norm for r in twice]


def test_the_host_of_a_canonical_url(spark):
    df = rules.canonicalize(spark.createDataFrame(CANONICAL, "url string, wanted string"))
    http = df.where("url_norm like 'http%'")
    both = http.select(rules.host_of(F.col("url_norm")).alias("a"), rules.canonical_host(F.col("url_norm")).alias("b"))
    assert all(r.a == r.b for r in both.collect())


def test_a_filter_on_the_canonical_form_does_not_repeat_its_stages(spark):
    df = rules.canonicalize(spark.createDataFrame(CANONICAL, "url string, wanted string"))
    plan = df.where("url_norm like 'https%'")._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 200_000
    assert df.where("url_norm like 'http:%'").count() == sum((wanted or "").startswith("http:") for _, wanted in CANONICAL)


def test_punycode_is_that_of_the_standard_library(spark):
    rng = random.Random(3)
    letters = "abc-z09\u00e4\u00f6\u00fc\u00df\u00e9\u03b1\u03b2\u0436\u044f\u65e5\u672c\ud55c\U0001f600\U00010348"
    labels = {"".join(rng.choice(letters) for _ in range(rng.randrange(1, 24))) for _ in range(600)} | {"\U0010ffff" * 60, "\u00fc" + "a" * 62}
    labels = sorted(label for label in labels if not label.isascii())
    df = spark.createDataFrame([(label,) for label in labels], "label string")
    code = punycode.encode_label(F.col("label"))
    for r in df.select("label", code.alias("code"), punycode.decode_label(code).alias("again")).collect():
        assert r.code == r.label.encode("punycode").decode() and r.again == r.label


def test_texts_that_are_no_punycode(spark):
    def plain(code):
        try:
            label = code.encode("ascii").decode("punycode")
            return label if label.encode() is not None else None
        except UnicodeError:
            return None

    rng = random.Random(4)
    codes = ["".join(rng.choice("abcxyz019-") for _ in range(rng.randrange(0, 14))) for _ in range(800)] + ["", "-", "a-", "999999999", "caf\u00e9-1"]
    df = spark.createDataFrame([(code,) for code in codes], "code string")
    got = {r.code: r.label for r in df.select("code", punycode.decode_label(F.col("code")).alias("label")).collect()}
    assert {c: got[c] for c in codes if c not in ("-", "") and not c.startswith("-")} == {c: plain(c) for c in codes if c not in ("-", "") and not c.startswith("-")}
    hosts = spark.createDataFrame([("xn--bcher-kva.xn--9.test",), ("plain.test",)], "host string")
    assert [r.h for r in hosts.select(punycode.host_to_unicode(F.col("host")).alias("h")).collect()] == ["b\u00fccher.xn--9.test", "plain.test"]


def test_character_references_are_those_of_the_standard_library(spark):
    from html import unescape
    from html.entities import html5

    rng = random.Random(5)
    bits = ["&amp;", "&amp", "&copy", "&notit;", "&not", "&NotEqualTilde;", "&#150;", "&#x80", "&#x41;", "&#0;", "&#xD800;", "&zzz;", "&", "a", "=", ";", "\u00e9"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 8))) for _ in range(600)] + ["&" + name for name in html5]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", html.unescaped(F.col("t")).alias("u")).collect():
        assert r.u == unescape(r.t), r.t


@pytest.mark.parametrize("canonical", [False, True])
def test_crawlable(spark, canonical):
    cases = [
        ("http://shop.test/cart?id=1#x", True), ("https://shop.test", True), ("sms:+15550100", False),
        ("javascript:alert('http://shop.test')", False), ("blob:https://shop.test/1", False), ("ws://shop.test/feed", False),
        ("mailto:team@shop.test", False), ("cart/http://shop.test", False), ("?page=https", False), ("", False),
    ]
    df = spark.createDataFrame(cases, "url string, wanted boolean")
    kept = {r.url for r in urls.crawlable(df).collect()}
    assert kept == {url for url, wanted in cases if wanted}


def test_same_host(spark):
    cases = [
        ("https://shop.test/1?x", "https://shop.test/2#y", True), ("https://m.shop.test/", "https://shop.test/", False),
        ("http://shop.test:81/", "https://SHOP.test/", True), ("https://shop.test.example/", "https://shop.test/", False),
        ("https://shop.test@else.test/", "https://shop.test/", False), ("tel:1", "tel:1", False), ("1", "1", False),
        ("http://u:p@[::1]:80/", "https://[::1]/", True),
    ]
    df = spark.createDataFrame(cases, "a string, b string, wanted boolean")
    for row in df.withColumn("got", rules.same_host(F.col("a"), F.col("b"))).collect():
        assert row.got == row.wanted, row


BASE = "https://e.com/shelf/book/page.html"
# The first two lines after the examples of RFC 3986, section 5.4.
HREFS = [
    "g:h", "g", "./g", "g/", "/g", "//g", "?y", "g?y", "#s", "g#s", "g?y#s", ";x", "g;x", "g;x?y#s", "", "..", "../", "../g", "../..", "../../g",
    "../../../g", "/./g", "/../g", "g.", ".g", "g..", "..g", "./../g", "./g/.", "g/./h", "g/../h", "g;x=1/./y", "g?y/./x", "g#s/../x", "?", "#", " /a", "/a\nb", "/a\n", "/a ", "https:foo", "http:foo", "a//b", "/a//b",
    "../../../../x", "./", "..", ".", "/../x", "/a/./b/..", "x/../y?z#w", "https://e.com", "HTTPS://E.com/Q?",
    "///p", "//", "a b", "/x?y=/../z", "javascript:void(0)", "a/", "/", "b//", " ", "//[::1]/x", "é/ü", "x:y",
    "//[zz]/", "/.hidden/a", "a;b", "?a=b#c", "https:/x", "https://e.com/a/../b",
]


def test_links_resolve_as_the_standard_library_does(spark):
    from urllib.parse import urljoin

    rows = []
    for base in (BASE, "https://e.com/", "http://e.com:81/a/b/?x=1", "https://e.com/d//e"):
        for href in HREFS:
            try:
                wanted = urljoin(base, href)
            except ValueError:
                wanted = href
            rows.append((base, href, wanted))
    df = spark.createDataFrame(rows, "source_url string, href_raw string, wanted string")
    for row in urls.resolve_links(df).collect():
        assert row.url == row.wanted, row


def links_of(spark, text, base=BASE):
    page = spark.createDataFrame([(base, base, text)], "url string, final_url string, text string")
    return [r.url for r in urls.extract_links(page).orderBy("pos").collect()]


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ('<a href="/a">1</a><a href="/a">2</a>', ["https://e.com/a", "https://e.com/a"]),
        ('<a href="/a">1<a href="/b">2<a href="/c">', ["https://e.com/a", "https://e.com/b", "https://e.com/c"]),
        ('<a href="">x</a><a href>x</a><a href= >x</a>', []),
        ("<a>x</a>", []),
        ("<p>no links", []),
        ("", []),
        (None, []),
        ('<a href="http://[::1">x</a><a href="/after">y</a>', ["http://[::1", "https://e.com/after"]),
        ('<!-- <a href="/c"> --><a data-href=/n HREF=\'/d\'>', ["https://e.com/d"]),
        ('<script>"<a href=/s>"</script><a title="a > b" href=/e><abbr href=/no>', ["https://e.com/e"]),
        ("<title><a href=/t></title><textarea><a href=/u></textarea><XMP><a href=/v></xmp><a href=/w><iframe><a href=/i>", ["https://e.com/w"]),
        ('<a href="/x?a=1&amp;b=2&#x2F;&#233;">', ["https://e.com/x?a=1&b=2/é"]),
        ('<a href="&amp;lt;&#38;lt;">', ["https://e.com/shelf/book/&lt;&lt;"]),
        ('<a href="/&eacute;&eacute&eacutes&copy=1&copy;=&sol;&nosuch;&not&#x96;">', ["https://e.com/\u00e9\u00e9&eacutes&copy=1\u00a9=/&nosuch;\u00ac\u2013"]),
    ],
)
def test_extracted_links(spark, text, wanted):
    assert links_of(spark, text) == wanted


def test_a_hostile_tag_costs_no_stack(spark):
    many = " ".join(f'a{i}="v"' for i in range(20_000))
    assert links_of(spark, f"<a {many} href=/deep>") == ["https://e.com/deep"]


def test_pages_are_read_once_and_not_shuffled(spark):
    pages = spark.createDataFrame([(BASE, BASE, "<a href=/a>")], "url string, final_url string, text string")
    plan = urls.canonicalize(urls.extract_links(pages))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert plan.count("array_remove(regexp_extract_all") == 1


def test_inlinks_dedupe_hosts_malformed(spark):
    rows = [("p1", 0, "https://e.com/a#x"), ("p1", 1, "https://e.com/a"), ("p2", 0, "https://e.com/a"), ("p2", 1, "http://[")]
    links = spark.createDataFrame(rows, "source_url string, pos int, url string")
    counted = urls.inlinks(links).where("url_norm is not null").collect()
    assert [(r.url_norm, r.links, r.pages) for r in counted] == [("https://e.com/a", 3, 2)]
    assert [r.pos for r in urls.dedupe_urls(links, pick="pos").collect()] == [0]
    assert urls.dedupe_urls(links).count() == 1
    assert [r.host for r in urls.hosts(links).collect()] == ["e.com"]
    assert [r.url for r in urls.malformed_urls(links).collect()] == ["http://["]
