import pytest

from webledger.operators import frontier
from webledger.operators.joins import mark_seen

CAND = (
    "site_id string, level int, source_rank bigint, pos int, url_norm string, scope_host string, "
    "max_depth int, max_pages int"
)


def judged(spark, links, level=1, max_pages=10, accepted=1, hot_rows=1_000_000):
    cand = spark.createDataFrame(
        [("s", level, rank, pos, url, "x.com", 3, max_pages) for rank, pos, url in links], CAND
    )
    seen = spark.createDataFrame([("s", "https://x.com/")], "site_id string, url_norm string")
    before = spark.createDataFrame([("s", accepted)], "site_id string, accepted bigint")
    rows = frontier.judge(cand, seen, before, hot_rows).collect()
    return [r.verdict for r in sorted(rows, key=lambda r: (r.source_rank, r.pos))]


@pytest.mark.parametrize("hot_rows", [1_000_000, 1])
def test_each_rule_has_its_verdict(spark, hot_rows):
    links = ["https://x.com/a", "https://x.com/", "https://other.com/", "https://www.x.com/", "mailto:a@x.com", None,
             "https://x.com/a"]
    got = judged(spark, [(0, i, u) for i, u in enumerate(links)], hot_rows=hot_rows)
    assert got == ["accepted", "duplicate", "off_host", "off_host", "non_http", "malformed", "duplicate"]


def test_depth(spark):
    assert judged(spark, [(0, 0, "https://x.com/deep"), (0, 1, "https://x.com/")], level=4) == ["too_deep", "duplicate"]


@pytest.mark.parametrize("hot_rows", [1_000_000, 1])
def test_the_budget_goes_by_offer_order(spark, hot_rows):
    links = [(1, 0, "https://x.com/c"), (0, 5, "https://x.com/b"), (0, 2, "https://x.com/a"), (2, 0, "https://x.com/a"),
             (2, 1, "https://x.com/c")]
    got = judged(spark, links, max_pages=3, accepted=1, hot_rows=hot_rows)
    assert got == ["accepted", "accepted", "budget_full", "duplicate", "budget_full"]


def test_links_to_one_url_are_one_row_before_the_shuffle(spark):
    cand = spark.createDataFrame([("s", 1, 0, i, "https://x.com/a", "x.com", 3, 9) for i in range(50)], CAND)
    (row,) = frontier.first_offer(cand).collect()
    assert (row.links, row.source_rank, row.pos) == (50, 0, 0)


def test_mark_seen_keeps_duplicates(spark):
    cand = spark.createDataFrame([("s", "u"), ("s", "u"), ("s", "v")], "site_id string, url_norm string")
    seen = spark.createDataFrame([("s", "u")], "site_id string, url_norm string")
    rows = mark_seen(cand, seen).collect()
    assert sorted((r.url_norm, r.seen) for r in rows) == [("u", True), ("u", True), ("v", False)]
