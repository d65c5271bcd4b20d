"""The whole audit of a set of sites: crawl, checks, report."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame

from webledger import params
from webledger.operators import checks
from webledger.operators.urls import canonicalize
from webledger.plans.crawl import Crawl, crawl
from webledger.plans.report import build_report
from webledger.scale import HOT_ROWS, store


@dataclass(frozen=True)
class Audit:
    crawl: Crawl
    findings: DataFrame
    report: DataFrame


def audit(
    sites: DataFrame,
    responses: DataFrame,
    robots: DataFrame | None = None,
    hops: DataFrame | None = None,
    agent: str = params.ANY_AGENT,
    extra_checks: tuple[checks.Check, ...] = (),
    hot_rows: int = HOT_ROWS,
) -> Audit:
    """Crawl the captured sites, check the pages that were reached, and report.

    Bodies are read once, for hrefs and page checks together. Targets of broken links are looked up
    in the whole capture, on or off the site's host. ``extra_checks`` are given the responses of the
    reached pages.
    """
    reached = crawl(sites, responses, robots, agent, hot_rows, page_checks=checks.PAGE_CHECKS)
    links = store(reached.links.select("site_id", "page_url", "pos", "url_norm"), "links")
    found = [
        reached.page_findings,
        checks.check_broken(links, _known_statuses(reached)),
    ]
    if hops is not None:
        found.append(checks.check_redirects(_chains_of_reached(hops, reached, hot_rows)))
    if extra_checks:
        fetched = reached.visits.where("outcome = 'fetched' and has_text").select("site_id", "url")
        pages = canonicalize(responses.where("text is not null"), "url", "url")
        found.append(checks.run_checks(pages.join(fetched, ["site_id", "url"], "left_semi"), list(extra_checks)))
    findings = store(reduce(DataFrame.unionByName, found), "findings")
    report = build_report(
        sites, reached.visits, reached.verdict_counts, findings, reached.started_at, reached.finished_at
    )
    return Audit(reached, findings, report)


def _chains_of_reached(hops: DataFrame, reached: Crawl, hot_rows: int) -> DataFrame:
    """Redirect chains that start at visited pages; hops without a site hold for every site."""
    chains = checks.redirect_chains(hops, hot_rows=hot_rows)
    visited = reached.visits.where("outcome <> 'robots'").select("site_id", "url")
    if "site_id" in hops.columns:
        return chains.join(visited, ["site_id", "url"], "left_semi")
    return chains.drop("site_id").join(visited, "url")


def _known_statuses(reached: Crawl) -> DataFrame:
    """Statuses of captured pages as the crawl itself saw them, and the 404 of visited ones that no capture holds.

    Of several captures of a page the crawl has picked one; a link is judged by that one too.
    """
    asked = reached.visits.where("outcome = 'fetched'").select("site_id", "url", "status")
    return reached.statuses.unionByName(asked)
