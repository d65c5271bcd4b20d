import gzip
import random
import zlib

import pytest

from webledger.operators import checks, joins
from webledger.params import RAW_CAPTURES, RESPONSES
from webledger.sources import captures

HTML = "<p>café</p>"


@pytest.mark.parametrize(
    ("content_type", "body", "wanted"),
    [
        ("text/html; charset=utf-8", HTML.encode(), HTML), ('text/html;CHARSET="latin1"', HTML.encode("latin-1"), HTML),
        ("TEXT/plain;q=1", b"one\ntwo\n", "one\ntwo\n"), ("text/html", b"na\xefve \xff", "na\ufffdve \ufffd"),
        ("text/html; charset=no-such-name", HTML.encode(), HTML), ("text/html; charset=UTF-16", HTML.encode("utf-16"), HTML),
        ("text/html; charset=utf-16le", "ab\u00e9".encode("utf-16-le")[:-1], "ab\ufffd"),
        ("text/html; charset=utf-16be", b"\xd8\x00\x00a", "\ufffd" + "a"), ("text/html; charset=us-ascii", b"a\xe9\x80", "a\ufffd\ufffd"),
        ("text/html; charset=windows-1252", b"\x80\x93\x81\xe9", "\u20ac\u201c\ufffd\u00e9"),
        ("text/html; charset=Shift_JIS", "\u65e5\u672c".encode("shift_jis"), "\u65e5\u672c"),
        ("text/html; charset=gbk", "\u4e2d\u6587".encode("gbk") + b"\x81", "\u4e2d\u6587\ufffd"),
        ("text/html; charset=koi8-r", "\u043c\u0438\u0440".encode("koi8-r"), "\u043c\u0438\u0440"), ("text/html; charset=hex", b"6", "6"),
        ("video/mp4", b"text/html", None), ("font/woff2", b"", None), ("", b"<p>", None), (None, b"<p>", None),
        ("text/html", b"y" * 4097, None), ("text/html", b"y" * 4096, "y" * 4096),
    ],
)
def test_bodies(spark, content_type, body, wanted):
    headers = {"Content-Type": content_type} if content_type else {}
    raw = spark.createDataFrame([("s", "e.com/a", "https://e.com/a#x", 200, headers, body, 5.0, None)], RAW_CAPTURES)
    (row,) = captures.ingest_captures(raw, 4096).collect()
    assert (row.url, row.final_url, row.status, row.text) == ("https://e.com/a", "https://e.com/a", 200, wanted)
    assert row.content_type == (content_type or "")


def test_declared_length_deadline_and_lost_urls(spark):
    def raw(url, final, headers, ms):
        return ("s", url, final, 200, {"content-type": "text/html", **headers}, b"<p>", ms, None)

    rows = [
        raw("https://e.com/1", None, {"Content-Length": "10737418240"}, 1.0), raw("https://e.com/2", None, {"content-length": "-5"}, 1.0),
        raw("https://e.com/3", None, {}, 200.1), raw("https://e.com/4", "http://[", {}, 1.0),
        raw("https://e.com/5", None, {"content-length": "9" * 40}, 1.0),
    ]
    taken = captures.ingest_captures(spark.createDataFrame(rows, RAW_CAPTURES), 4096, 0.2)
    got = {r.url[-1]: (r.status, r.text, r.fetch_error, r.body_state) for r in taken.collect()}
    assert got["1"] == (200, None, None, "declared_too_long")
    assert got["2"] == (200, "<p>", None, "text")
    assert got["3"] == (None, None, "timeout", None)
    assert got["4"][:3] == (None, None, "malformed final url")
    assert got["5"][3] == "declared_too_long"
    with pytest.raises(ValueError):
        captures.ingest_captures(spark.createDataFrame(rows, RAW_CAPTURES), 0)


def encoded(spark, body, coding, cap=4096, kind="text/html"):
    raw = spark.createDataFrame([("s", "https://e.com/a", None, 200, {"content-type": kind, "Content-Encoding": coding}, body, 5.0, None)], RAW_CAPTURES)
    (row,) = captures.ingest_captures(raw, cap).collect()
    return row.text, row.status, row.body_state, row.fetch_error


def test_encoded_bodies(spark):
    plain, bare = HTML.encode(), zlib.compressobj(wbits=-15)
    raw = bare.compress(plain) + bare.flush()
    for body, coding in [(gzip.compress(plain), "GZIP"), (zlib.compress(plain), "deflate"), (raw, "Deflate"), (gzip.compress(zlib.compress(plain)), "deflate, gzip"),
                         (plain, "identity"), (plain, "br"), (gzip.compress(plain) + b"more", "identity,gzip")]:
        assert encoded(spark, body, coding) == (HTML, 200, "text", None), coding
    # in a charset that only Python knows
    assert encoded(spark, gzip.compress("\u043c\u0438\u0440".encode("koi8-r")), "gzip", kind="text/html; charset=koi8-r")[0] == "\u043c\u0438\u0440"
    # small on the wire, over the cap; just at the cap
    assert encoded(spark, gzip.compress(b"y" * 4097), "gzip") == (None, 200, "too_long", None)
    assert encoded(spark, gzip.compress(b"y" * 4096), "gzip")[0] == "y" * 4096
    # cut, and not what the header says
    assert encoded(spark, gzip.compress(b"y" * 90, 0)[:45], "gzip") == ("y" * 30, 200, "text", None)
    assert encoded(spark, b"<p>", "gzip") == (None, None, None, "undecodable body")
    assert encoded(spark, b"", "gzip")[0] == "" and encoded(spark, b"<p>", "gzip", kind="image/png") == (None, 200, "not_text", None)


def test_inflation_stops_at_the_cap():
    made = []
    bomb = gzip.compress(bytes(50_000_000))
    decoder = captures._Deflated("gzip")
    for piece in decoder.pieces(iter([bomb])):
        made.append(len(piece))
        if sum(made) > 200_000:
            break
    assert max(made) <= captures._PIECE and captures.inflated(bomb, ["gzip"], 100_000) is None
    rng = random.Random(1)
    for n in (0, 1, 65_535, 65_536, 65_537, 300_000):
        body = rng.randbytes(n)
        assert captures.inflated(gzip.compress(body), ["gzip"], n) == body


def test_only_rare_bodies_are_handed_to_python(spark, tmp_path):
    spark.createDataFrame([], RAW_CAPTURES).write.parquet(str(tmp_path / "raw"))
    plan = captures.ingest_captures(spark.read.parquet(str(tmp_path / "raw")))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("FileScan") == 2
    # one of two branches; its rows are filtered before they cross
    assert plan.count("MapInArrow") == 1
    assert "Filter" in plan[plan.index("MapInArrow") :]


def test_reading(spark, tmp_path):
    rows = [("s", "u", "u", 200, 1.0, None, "t", None)]
    spark.createDataFrame(rows, RESPONSES).write.parquet(str(tmp_path / "r"))
    (row,) = captures.read_responses(spark, str(tmp_path / "r")).collect()
    assert row.content_type == ""
    with pytest.raises(ValueError):
        captures.read_responses(spark, str(tmp_path / "r"), "csv")


def test_visit_and_lookup(spark):
    known = spark.createDataFrame(
        [("s", "u", None, 200, 1.0, None, "t", None), ("s", "f", None, None, None, "", None, "refused")], RESPONSES
    )
    asked = spark.createDataFrame([("s", "u", 1), ("s", "f", 2), ("s", "gone", 3)], "site_id string, url string, n int")
    for join in (joins.visit, joins.lookup):
        got = {r.url: (r.status, r.content_type, r.final_url, r.text) for r in join(asked, known).collect()}
        assert got == {"u": (200, "", "u", "t"), "f": (None, "", "f", None), "gone": (404, "", "gone", None)}


def test_redirect_chains(spark):
    def hop(a, b, status=301):
        return (f"https://e.com/{a}", f"/{b}", status)

    rows = [hop(0, 1), hop(1, 2), hop("x", "y"), hop("y", "x"), hop("n", "m", 200), hop("self", "self")]
    rows += [hop(f"l{i}", f"l{i + 1}") for i in range(30)] + [hop(f"in{i}", 0) for i in range(9)]
    hops = spark.createDataFrame(rows, "url string, location string, status int")
    for hot_rows in (1_000_000, 3):
        chains = checks.redirect_chains(hops, hot_rows=hot_rows)
        got = {r.url[14:]: (r.hops, r.final_url and r.final_url[14:], r.loop, r.over_limit) for r in chains.collect()}
        assert got["0"] == (2, "2", False, False) and got["1"] == (1, "2", False, False) and got["in3"] == (3, "2", False, False)
        assert got["x"] == got["y"] == got["self"] == (None, None, True, True)
        assert got["l10"] == (20, "l30", False, False) and got["l0"] == (30, "l30", False, True)
        assert "n" not in got
    loops = checks.check_redirects(chains, min_hops=31).collect()
    assert sorted((r.page_url[14:], r.message) for r in loops) == [(u, "redirect loop") for u in ("self", "x", "y")]
    found = checks.check_redirects(chains, min_hops=3).where("page_url like '%in0'").collect()
    assert [(r.severity, r.message) for r in found] == [("warning", "redirect chain length 3")]


PAGES = [
    ('<title> A &amp; B </title><meta content="d" name="description"><link href="/p" rel="nofollow canonical"><h1>x</h1>', []),
    ("<title></title><meta name=description content=''><link rel=canonical href=/q><h1>",
     ["canonical differs", "description empty", "title empty"]),
    ("", ["canonical missing", "description missing", "h1 count 0", "title missing"]),
    ('<!-- <title>no</title> --><img src="http://i.e/x"><img src="https://i.e/y"><a href="http://a.e/"><a href="http://a.e/">'
     "<script src=http://s.e/></script>",
     ["canonical missing", "description missing", "h1 count 0", "mixed content", "mixed content", "mixed content", "title missing"]),
]


def test_page_checks(spark):
    rows = [("s", f"https://e.com/{i}", "https://e.com/p", text) for i, (text, _) in enumerate(PAGES)]
    pages = spark.createDataFrame(rows, "site_id string, url string, final_url string, text string")
    found = checks.page_findings(pages).collect()
    for i, (_, wanted) in enumerate(PAGES):
        assert sorted(r.message for r in found if r.page_url.endswith(f"/{i}")) == wanted
    assert {r.severity for r in found} == {"warning"}
    single = [checks.check_title, checks.check_description, checks.check_canonical, checks.check_h1, checks.check_mixed]
    assert sum(c(pages).count() for c in single) == len(found)
    with pytest.raises(ValueError):
        checks.page_findings(pages, ("nonsense",))
    with pytest.raises(ValueError):
        checks.finding("x", "fatal", "m")
    with pytest.raises(ValueError):
        checks.run_checks(pages, [checks.Check("a", checks.check_h1), checks.Check("a", checks.check_title)])
