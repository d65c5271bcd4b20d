import random
from collections import Counter, deque
from datetime import datetime

import pytest

from webledger.operators.checks import Check, finding
from webledger.params import RESPONSES, SITES
from webledger.plans.audit import audit
from webledger.plans.crawl import crawl
from webledger.plans.report import build_report, summary
from webledger.sources import captures

SEED = "https://e.com/0"


def web(edges, also=()):
    """Pages of one host from pairs (page, linked page), by number or path; ``also``: pages without links."""
    out = {}
    for page, target in edges:
        out.setdefault(page, []).append(f"<p><a href='/{target}'>to {target}</a>")
    bodies = {page: "".join(links) for page, links in out.items()}
    for page in (*[t for _, t in edges], *also):
        bodies.setdefault(page, "")
    return {f"https://e.com/{page}": body for page, body in bodies.items()}


def line(n):
    return web([(i, i + 1) for i in range(n - 1)], also=[0])


def captured(site, pages, ms=None):
    return [
        (site, url, None, 200, float((ms or {}).get(url, 10.0)), "text/html", text, None) for url, text in pages.items()
    ]


# The counters of each case follow from the rules of a crawl.
GOLDEN = {
    "c3": (line(3), 3, 20, dict(pages_crawled=3, completed=True)),
    "c1": (line(1), 3, 20, dict(pages_crawled=1, links_found=0, completed=True, fetch_errors=0, skipped_robots=0)),
    "deep": (line(20), 3, 20, dict(pages_crawled=4, links_found=4, completed=True)),
    "budget": (line(20), 10, 3, dict(pages_crawled=3, links_found=3, completed=False)),
    "off": (
        {SEED: "<ul><li><a href='https://shop.test/cart'>cart</a><li><a href='news'>news</a></ul>", "https://e.com/news": "<p>nothing new"}, 3, 20,
        dict(pages_crawled=2, skipped_off_host=1, links_found=2, completed=True),
    ),
    "diamond": (
        web([(0, "left"), (0, "mid"), (0, "right"), ("left", "end"), ("mid", "end"), ("right", "end")]), 3, 20,
        dict(pages_crawled=5, completed=True),
    ),
    "missing": (
        {u: b for u, b in web([(0, "a"), (0, "gone"), (0, "z")]).items() if "gone" not in u}, 3, 20,
        dict(pages_crawled=4, status_counts={200: 3, 404: 1}, links_found=3, completed=True),
    ),
    "broken": (
        {u: b for u, b in web([(0, "a"), (0, "fails"), (0, "z")]).items() if "fails" not in u}, 3, 20,
        dict(pages_crawled=3, fetch_errors=1, status_counts={200: 3}, completed=True),
    ),
    "denied": (
        web([(0, "open"), (0, "shut")]), 3, 20, dict(pages_crawled=2, skipped_robots=1, links_found=2, status_counts={200: 2}, completed=True),
    ),
    "malformed": (
        {SEED: "<p>see <a href=about>us</a> and <a href='https://[1:2'>them</a>", "https://e.com/about": "<a href=/about/team>team</a>",
         "https://e.com/about/team": "<h1>team</h1>"}, 3, 500,
        dict(pages_crawled=3, links_found=3),
    ),
    "fan": (web([(0, i) for i in range(1, 26)]), 3, 500, dict(pages_crawled=26)),
    "moved": (
        {"https://www.e.com/terms": "<p>terms", "https://www.e.com/help": "<a href='./0#top'>back</a>"}, 3, 500, dict(pages_crawled=3, skipped_off_host=0),
    ),
}


@pytest.fixture(scope="module")
def golden(spark):
    rows, sites = [], []
    for site, (pages, depth, budget, _) in GOLDEN.items():
        ms = {url: float(n) for n, url in enumerate(pages)} if site == "fan" else None
        rows += captured(site, pages, ms)
        sites.append((site, SEED, depth, budget))
    rows.append(("broken", "https://e.com/fails", None, None, None, "", None, "simulated failure"))
    home = "<nav><a href=//www.e.com/help>help</a><a href=terms>terms</a></nav>"
    rows.append(("moved", SEED, "https://www.e.com/0", 200, 10.0, "text/html", home, None))
    answers = spark.createDataFrame([("https://e.com/shut", False)], "url string, allowed boolean")
    sites_df = spark.createDataFrame(sites, SITES)
    done = crawl(sites_df, spark.createDataFrame(rows, RESPONSES), answers)
    report = build_report(sites_df, done.visits, done.verdict_counts, started_at=datetime(2024, 1, 1))
    return done, {r.site_id: r.asDict(recursive=True) for r in report.collect()}


@pytest.mark.parametrize("site", GOLDEN)
def test_golden_counters(golden, site):
    row = golden[1][site]
    assert {k: row[k] for k in GOLDEN[site][3]} == GOLDEN[site][3]
    assert sum(row["status_counts"].values()) == row["pages_crawled"]


def test_the_ten_slowest(golden):
    slow = golden[1]["fan"]["slowest"]
    assert [s["elapsed_ms"] for s in slow] == [float(n) for n in range(25, 15, -1)]
    assert slow[0]["url"] == "https://e.com/25"


def test_invariants(golden):
    done = golden[0]
    from_links = {(r.site_id, r.verdict): r["count"] for r in done.verdicts.groupBy("site_id", "verdict").count().collect()}
    from_decisions = {(r.site_id, r.verdict): r.n for r in done.verdict_counts.collect()}
    assert from_links == from_decisions
    visits = Counter(r.site_id for r in done.visits.collect())
    for site, n in visits.items():
        assert from_links.get((site, "accepted"), 0) + 1 == n


def test_chain_of_fifty(spark):
    sites = spark.createDataFrame([("s", SEED, 49, 50)], SITES)
    done = crawl(sites, spark.createDataFrame(captured("s", line(50)), RESPONSES))
    (row,) = build_report(sites, done.visits, done.verdict_counts).collect()
    assert (row.pages_crawled, row.links_found, row.fetch_errors, row.skipped_robots) == (50, 49, 0, 0)
    assert (row.skipped_off_host, row.skipped_non_http, row.completed) == (0, 0, True)


@pytest.mark.parametrize(
    ("seed", "depth", "budget"), [(SEED, 3, 0), (SEED, -1, 10), ("http://[::1", 3, 10), ("mailto:a@b.c", 3, 10)]
)
def test_refused_seeds(spark, seed, depth, budget):
    with pytest.raises(ValueError):
        crawl(spark.createDataFrame([("s", seed, depth, budget)], SITES), spark.createDataFrame([], RESPONSES))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_levels_shuffle_offers_once_and_read_no_page(spark, golden):
    from webledger.operators import frontier
    from webledger.plans.crawl import _links

    done = golden[0]
    seen = done.visits.selectExpr("site_id", "url as url_norm")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(frontier.decide(_links(done._visits), seen))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # offers to one row per URL, the seen set to those rows; links come with the visits, already canonical
    assert plan.count("Exchange hashpartitioning") == 2
    assert "partial_min" in plan and "Bucketed: true" not in plan and "regexp" not in plan


def test_a_level_scans_the_capture_once_and_only_folders_with_an_open_frontier(spark, golden):
    from webledger.plans.crawl import _open_pages, _visited

    done = golden[0]
    front = done.visits.where("depth = 1").selectExpr(
        "site_id", "url", "depth", "accept_rank", "'e.com' as scope_host", "3 as max_depth", "9 as max_pages"
    )
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(_visited(front, _open_pages(done._pages, [3, 7]), None, None))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    scans = [line for line in plan.splitlines() if "FileScan" in line and "links" in line and "Bucketed: true" in line]
    assert len(scans) == 1 and "PartitionFilters" in scans[0] and "part#" in scans[0] and " IN (3,7)" in scans[0]
    # the frontier moves, the capture does not
    assert plan.count("Exchange hashpartitioning") == 1


def test_finished_sites_are_not_read_again(spark, monkeypatch):
    from webledger.plans import crawl as plans

    asked = []
    own = plans._open_pages
    monkeypatch.setattr(plans, "_open_pages", lambda pages, parts: asked.append(sorted(parts)) or own(pages, parts))
    rows, sites = [], []
    for n in range(1, 7):
        rows += captured(f"s{n}", line(n))
        sites.append((f"s{n}", SEED, 9, 20))
    done = crawl(spark.createDataFrame(sites, SITES), spark.createDataFrame(rows, RESPONSES))
    assert done.visits.count() == 21
    part = {r.site_id: r.part for r in spark.createDataFrame(sites, SITES).selectExpr("site_id", f"{plans._PART} as part").collect()}
    for depth, parts in enumerate(asked):
        assert parts == sorted({part[f"s{n}"] for n in range(depth + 1, 7)})
    assert len(asked) == 6


def test_conflicting_captures_of_a_link_target(spark):
    seed = {SEED: "<title>t</title>" + "".join(f"<a href='/{t}'>" for t in ("a", "b", "c", "d"))}
    rows = captured("s", seed)

    def one(path, status, fault=None, site="s"):
        return (site, f"https://e.com/{path}", None, status, 1.0, "text/html", None, fault)

    rows += [one("a", None, "timeout"), one("a", 404), one("b", 404), one("b", 200), one("c", None, "refused"), one("c", None, "timeout")]
    done = audit(spark.createDataFrame([("s", SEED, 1, 9)], SITES), spark.createDataFrame(rows, RESPONSES))
    broken = {r.subject for r in done.findings.where("severity = 'error'").collect()}
    answered = {r.url: r.status for r in done.crawl.visits.collect()}
    # a link is judged by the capture that the crawl took: /a and the uncaptured /d are broken, /b and /c are not
    assert broken == {"https://e.com/a", "https://e.com/d"}
    assert answered["https://e.com/a"] == 404 and answered["https://e.com/b"] == 200 and answered["https://e.com/c"] is None
    (row,) = done.report.collect()
    assert (row.errors, row.gate, row.fetch_errors) == (2, 1, 1)


def serial(pages, seed, max_depth, max_pages):
    """The rules one link at a time: (url, depth) in accept order, and the verdict of every link."""
    seen, order, verdicts = {seed}, [(seed, 0)], []
    queue = deque(order)
    while queue:
        page, depth = queue.popleft()
        for target in pages.get(page, []):
            if target is None:
                verdict = "malformed"
            elif target in seen:
                verdict = "duplicate"
            elif not target.startswith("http"):
                verdict = "non_http"
            elif not target.startswith("https://e.com/"):
                verdict = "off_host"
            elif depth + 1 > max_depth:
                verdict = "too_deep"
            elif len(order) >= max_pages:
                verdict = "budget_full"
            else:
                verdict = "accepted"
                seen.add(target)
                order.append((target, depth + 1))
                queue.append((target, depth + 1))
            verdicts.append((page, target, verdict))
    return order, Counter(verdicts)


@pytest.mark.parametrize("hot_rows", [1_000_000, 2])
def test_random_graphs_agree_with_a_serial_crawl(spark, hot_rows):
    rng = random.Random(7 + hot_rows)
    rows, sites, wanted = [], [], {}
    for s in range(25):
        n = rng.randint(2, 14)
        pool = [f"https://e.com/{i}" for i in range(n)] + ["https://o.com/", "mailto:x@e.com", None]
        pages = {f"https://e.com/{i}": rng.choices(pool, k=rng.randint(0, 7)) for i in range(n)}
        for url, targets in pages.items():
            text = "".join(f"<a href='{t or 'http://[::1'}'>" for t in targets)
            rows.append((f"s{s}", url, None, 200, 1.0, "text/html", text, None))
        depth, budget = rng.randint(0, 4), rng.choice([1, 3, 6, 2000])
        sites.append((f"s{s}", SEED, depth, budget))
        wanted[f"s{s}"] = serial(pages, SEED, depth, budget)
    done = crawl(spark.createDataFrame(sites, SITES), spark.createDataFrame(rows, RESPONSES), hot_rows=hot_rows)
    visits, verdicts = {}, {}
    for r in done.visits.collect():
        visits.setdefault(r.site_id, []).append((r.accept_rank, r.url, r.depth))
    for r in done.verdicts.collect():
        verdicts.setdefault(r.site_id, Counter())[(r.page_url, r.url_norm, r.verdict)] += 1
    for site, (order, counted) in wanted.items():
        assert [(u, d) for _, u, d in sorted(visits[site])] == order
        assert [k for k, _, _ in sorted(visits[site])] == list(range(len(order)))
        assert verdicts.get(site, Counter()) == counted


def test_audit_finds_reports_and_writes(spark, tmp_path):
    pages = {
        SEED: '<title>t</title><h1>x</h1><a href="/gone">g</a><a href="/gone">again</a><a href="http://e.com/1">1</a>',
        "http://e.com/1": "<h1>a</h1><h1>b</h1>",
    }
    unreached = captured("s", {"https://e.com/unlinked": "<p>"})
    sites = spark.createDataFrame([("s", SEED, 3, 20)], SITES)
    hops = spark.createDataFrame(
        [(SEED, "/b", 301), ("https://e.com/b", "/c", 302), ("https://e.com/unlinked", "/b", 301)],
        "url string, location string, status int",
    )

    def mention(rows):
        from pyspark.sql import functions as F

        found = finding("own", "info", "seen")
        return rows.select("site_id", F.col("url").alias("page_url"), F.inline(F.array(found)))

    done = audit(
        sites, spark.createDataFrame(captured("s", pages) + unreached, RESPONSES), hops=hops,
        extra_checks=(Check("own", mention),),
    )
    found = {(r.page_url, r.check, r.severity, r.message, r.subject) for r in done.findings.collect()}
    assert (SEED, "links", "error", "broken link", "https://e.com/gone") in found
    assert (SEED, "links", "warning", "mixed content", "http://e.com/1") in found
    assert ("http://e.com/1", "meta", "warning", "h1 count 2", None) in found
    assert ("http://e.com/1", "meta", "warning", "title missing", None) in found
    assert (SEED, "meta", "warning", "description missing", None) in found
    assert (SEED, "own", "info", "seen", None) in found
    assert (SEED, "links", "warning", "redirect chain length 2", None) in found
    assert not any(page == "https://e.com/unlinked" for page, *_ in found)
    (row,) = done.report.collect()
    assert (row.errors, row.gate, row.pages_crawled) == (1, 1, 3)
    assert row.warnings == sum(severity == "warning" for _, _, severity, _, _ in found)
    assert row.finished_at >= row.started_at
    shown = {(r.section, r["item"], r.amount) for r in summary(done.crawl.visits, done.findings).collect()}
    assert {("status", "2xx", 2.0), ("status", "4xx", 1.0), ("broken", "https://e.com/gone", 1.0)} <= shown
    captures.write_report_jsonl(done.crawl.visits, done.findings, str(tmp_path / "report"))
    lines = {r.url: r for r in spark.read.json(str(tmp_path / "report")).collect()}
    assert lines["https://e.com/gone"].checks == [] and lines["https://e.com/gone"].status == 404
    assert "text" not in lines[SEED].asDict() and len(lines[SEED].checks) >= 4
    captures.write_summary(done.report, str(tmp_path / "summary"), "json")
    with pytest.raises(Exception):
        captures.write_summary(done.report, str(tmp_path / "summary"), "json")


def test_a_page_captured_twice_is_visited_once(spark):
    rows = captured("s", {SEED: "<a href=/1>"}) + captured("s", {SEED + "#top": "<a href=/1><a href=/2>"})
    rows.append(("s", SEED, None, None, None, "", None, "timeout"))
    done = crawl(spark.createDataFrame([("s", SEED, 1, 9)], SITES), spark.createDataFrame(rows, RESPONSES))
    seeds = done.visits.where("depth = 0").collect()
    assert [r.outcome for r in seeds] == ["fetched"]


def test_a_final_url_without_canonical_form_is_a_failed_fetch(spark):
    rows = [("s", SEED, "http://[", 200, 1.0, "text/html", "<a href=/1>", None)]
    done = crawl(spark.createDataFrame([("s", SEED, 1, 9)], SITES), spark.createDataFrame(rows, RESPONSES))
    assert [(r.outcome, r.status) for r in done.visits.collect()] == [("fetch_error", None)]
