"""Crawls of many levels: the last ones are taken together, pages are looked up by few keys, and written anew without visited ones."""

import random

import pytest

from webledger.params import RESPONSES, SITES
from webledger.plans import crawl as plan

HOST = "https://e.com"


def rows_of(site, links, final=None, failed=()):
    """Captures of a site from {page: [href, …]}."""
    for page, hrefs in links.items():
        text = "".join(f"<a href='{h}'>x</a>" for h in hrefs)
        error = "timeout" if page in failed else None
        yield site, f"{HOST}/{page}", (final or {}).get(page), 200, 1.0, "text/html", text, error


def test_a_thin_site_of_many_levels_takes_few_tables(spark, monkeypatch):
    written, store = [], plan.store
    monkeypatch.setattr(plan, "store", lambda df, name: written.append(name) or store(df, name))
    n = 150
    pages = {i: [f"/{i + 1}", f"/{i // 2}"] for i in range(n)} | {"off": []}
    sites = spark.createDataFrame([("s", f"{HOST}/0", n + 5, 10 * n), ("t", f"{HOST}/0", n - 20, 10 * n)], SITES)
    rows = [*rows_of("s", pages), *rows_of("t", pages)]
    done = plan.crawl(sites, spark.createDataFrame(rows, RESPONSES))
    assert len(written) < 30
    visits = {(r.site_id, r.url): (r.depth, r.accept_rank, r.status) for r in done.visits.collect()}
    expected = {("s", f"{HOST}/{i}"): (i, i, 200 if i < n else 404) for i in range(n + 1)}
    expected |= {("t", f"{HOST}/{i}"): (i, i, 200) for i in range(n - 19)}
    assert visits == expected
    counts = {(r.site_id, r.verdict): r.n for r in done.verdict_counts.collect()}
    assert counts == {
        ("s", "accepted"): n, ("s", "duplicate"): n,
        ("t", "accepted"): n - 20, ("t", "duplicate"): n - 19, ("t", "too_deep"): 1,
    }


@pytest.fixture(scope="module")
def tangled(spark):
    """Sites with redirects, failures, repeated and foreign links, budgets and limits of depth that bind."""
    rng = random.Random(5)
    sites, rows = [], []
    for s, (depth, budget) in enumerate([(60, 1000), (9, 1000), (60, 25), (60, 1000), (2, 3)]):
        n = 20
        links = {}
        for i in range(n):
            hrefs = [f"/{i + 1}", f"/{rng.randrange(i + 1)}", f"./{rng.randrange(i + 1, i + 9)}?b=1&a=2", f"/{rng.randrange(n + 10)}#x"]
            hrefs += rng.sample(["https://other.test/", "mailto:a@b.c", "https://[1", f"/{i + 2}", f"/{i + 1}"], 2)
            rng.shuffle(hrefs)
            links[i] = hrefs
        links[f"{n}?a=2&b=1"] = ["/40", "/41"]
        moved = {7: f"{HOST}/77", 12: f"{HOST}/13"}
        rows += rows_of(f"s{s}", links, moved, failed=(9, 17) if s != 3 else (1, 2, 3))
        sites.append((f"s{s}", f"{HOST}/0", depth, budget))
    answers = spark.createDataFrame([(f"{HOST}/11", False), (f"{HOST}/15", False)], "url string, allowed boolean")
    return spark.createDataFrame(sites, SITES), spark.createDataFrame(rows, RESPONSES), answers


def found(done):
    columns = ["site_id", "level", "source_rank", "page_url", "pos", "url_norm", "verdict"]
    return (
        sorted(map(str, done.visits.collect())),
        sorted(map(str, done.verdicts.select(*columns).collect())),
        sorted(map(str, done.verdict_counts.collect())),
    )


@pytest.fixture(scope="module")
def one_by_one(tangled):
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(plan, "_LEVELS_APART", 10**6)
        return found(plan.crawl(*tangled))


@pytest.mark.parametrize("change", [{"_LEVELS_APART": 0}, {"_LEVELS_APART": 3, "_FEW_BYTES": -1}, {"_LEVELS_APART": 5, "_REWRITE_PAGES": 1}])
def test_levels_taken_together_find_the_same(tangled, one_by_one, monkeypatch, change):
    for name, value in change.items():
        monkeypatch.setattr(plan, name, value)
    assert found(plan.crawl(*tangled)) == one_by_one


def test_sorted_joins_and_rewritten_pages_find_the_same(tangled, one_by_one, monkeypatch):
    for name, value in {"_LEVELS_APART": 10**6, "_FEW_BYTES": -1, "_REWRITE_PAGES": 1}.items():
        monkeypatch.setattr(plan, name, value)
    assert found(plan.crawl(*tangled)) == one_by_one
