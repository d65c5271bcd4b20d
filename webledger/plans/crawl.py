"""Breadth-first reach over captured sites: the frontier replayed level by level.

Bodies are read once, and URLs are made canonical once. One pass turns the capture into a slim table of pages with their
canonical links, in folders by a hash of the site and bucketed by (site, URL). A level reads that table once: it moves only
its frontier to it, reads only the folders that hold a site with an open frontier, and takes along what the pages it visits
say, links and findings included, so the next level, the verdicts and the audit start from the visited pages alone. Sites
leave as they finish, and their folders are not read again. Each level writes two tables, the decisions on the URLs it was
offered and the pages it visited; when little is left, all further levels write one of each. Verdicts of single links are
never stored: counts come from the decisions, and the table of all link verdicts is one lazy join over the stored tables.
"""

from __future__ import annotations

from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from webledger import params
from webledger.functions import html
from webledger.functions import urls as url_rules
from webledger.operators import frontier
from webledger.operators.checks import with_checks
from webledger.operators.joins import visit
from webledger.operators.robots import permitted, robots_hosts, wide_rules
from webledger.operators.urls import written_href
from webledger.scale import BROADCAST_BYTES, HOT_ROWS, store, store_bucketed

# Folders of the slim capture.
PARTS = 32
# The folder that a site's pages are in.
_PART = f"CAST(pmod(xxhash64(site_id), {PARTS}) AS INT)"
# Levels whose visits are read separately for the seen set before they are written as one table.
_SEEN_PARTS = 6
# Keys of a level up to this size are broadcast to the tables that they are looked up in; more meet them in a sorted join.
_FEW_BYTES = 16 * 1024 * 1024
# Pages are written anew without the visited ones when those are half of them, and at least so many.
_REWRITE_PAGES = 50_000
# Levels that are always taken one by one. Later ones are taken together as soon as what may still be visited is small.
_LEVELS_APART = 6


def validate_sites(sites: DataFrame) -> DataFrame:
    """Sites with canonical seeds; a site that cannot be crawled is an error, never an empty report."""
    seeds = url_rules.canonicalize(sites, "seed_url", "url")
    fault = (
        F.when(F.col("url").isNull(), "malformed seed")
        .when(~url_rules.is_crawlable(F.col("url")), "seed is not http or https")
        .when(F.coalesce("max_pages", F.lit(0)) <= 0, "budget_full: max_pages must be above zero")
        .when(F.coalesce("max_depth", F.lit(-1)) < 0, "too_deep: max_depth must not be negative")
    )
    faulty = seeds.withColumn("fault", fault).where("fault is not null").limit(5).collect()
    if faulty:
        listed = "; ".join(f"{r.site_id} ({r.seed_url}): {r.fault}" for r in faulty)
        raise ValueError(f"sites that cannot be crawled: {listed}")
    twice = sites.groupBy("site_id").count().where("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"site_id given twice: {', '.join(str(r.site_id) for r in twice)}")
    return seeds.select(
        "site_id",
        "url",
        url_rules.host_of(F.col("url")).alias("scope_host"),
        F.col("max_depth").cast("int").alias("max_depth"),
        F.col("max_pages").cast("int").alias("max_pages"),
    )


def capture_pages(responses: DataFrame, page_checks: tuple[str, ...] = ()) -> DataFrame:
    """Responses to one slim row per page: no body, but its links and its findings.

    The only pass over the bodies. Where a page was captured more than once, one capture is picked
    by its content. The links are resolved and made canonical row by row and put together again where the pick has left
    the page, so there is one shuffle.
    """
    read = responses.select(
        "site_id",
        "url",
        F.coalesce("final_url", "url").alias("final_url"),
        "status",
        "elapsed_ms",
        F.coalesce("content_type", F.lit("")).alias("content_type"),
        "fetch_error",
        F.when(F.col("fetch_error").isNull(), F.col("text")).alias("text"),
    )
    if page_checks:
        slim = with_checks(read, page_checks)
    else:
        none = F.array().cast(f"array<{params.FINDING}>")
        slim = read.withColumns({"hrefs": html.raw_hrefs(F.col("text")), "checks": none}).drop("text")
    known = url_rules.canonicalize(url_rules.canonicalize(slim, "url", "url"), "final_url", "_final")
    lost = F.when(F.col("_final").isNull(), "malformed final url")
    page = F.struct(
        F.coalesce("fetch_error", lost).alias("fetch_error"),
        F.col("_final").alias("final_url"),
        "status",
        "elapsed_ms",
        "content_type",
        "hrefs",
        "checks",
    )
    picked = known.where(F.col("url").isNotNull()).groupBy("site_id", "url").agg(F.min(page).alias("_p"))
    hrefs = picked.select(
        "site_id", "url", F.col("_p.final_url").alias("_base"), F.col("_p").dropFields("hrefs").alias("_p"),
        F.col("_p.hrefs").isNotNull().alias("has_text"), F.posexplode_outer("_p.hrefs").alias("pos", "href_raw"),
    )
    written = hrefs.withColumn("href_raw", written_href())
    found = url_rules.canonicalize(url_rules.resolve(written, "_base", "href_raw", "_link"), "_link", "_link_norm")
    link = F.struct("pos", F.col("_link").alias("url"), F.col("_link_norm").alias("url_norm"))
    whole = found.groupBy("site_id", "url").agg(
        F.first("_p").alias("_p"), F.first("has_text").alias("has_text"),
        F.sort_array(F.collect_list(F.when(F.col("href_raw").isNotNull(), link))).alias("links"),
    )
    return whole.select("site_id", "url", "_p.*", F.when(F.col("has_text"), F.col("links")).alias("links"), "has_text")


class Crawl:
    """What a crawl found. ``visits`` is stored; the rest is computed from stored tables when used."""

    def __init__(self, pages, levels, decided, started_at, hot_rows) -> None:
        self._pages = pages
        self._visits = reduce(DataFrame.unionByName, levels)
        self._decided = reduce(DataFrame.unionByName, decided) if decided else None
        self._hot_rows = hot_rows
        self.started_at = started_at
        self.finished_at = datetime.now(timezone.utc)

    @property
    def visits(self) -> DataFrame:
        """Every page admitted, with depth, accept rank, outcome and response."""
        return self._visits.drop(*frontier.SITE_SCOPE, *_SAID)

    @property
    def links(self) -> DataFrame:
        """Every link of every fetched page, resolved and canonical, not yet judged."""
        return _links(self._visits).drop(*frontier.SITE_SCOPE)

    @property
    def statuses(self) -> DataFrame:
        """The status of every captured page, reached or not; null where it could not be fetched."""
        return self._pages.select("site_id", "url", F.when(F.col("fetch_error").isNull(), F.col("status")).alias("status"))

    @property
    def page_findings(self) -> DataFrame:
        """Findings of the page checks on fetched pages."""
        fetched = self._visits.where((F.col("outcome") == "fetched") & F.col("has_text"))
        return fetched.select("site_id", F.col("url").alias("page_url"), F.inline("checks"))

    @property
    def _admitted(self) -> DataFrame:
        return self._visits.where(F.col("depth") > 0).select(
            "site_id", F.col("depth").alias("level"), F.col("url").alias("url_norm")
        )

    @property
    def verdicts(self) -> DataFrame:
        """Every link with its verdict."""
        judged = frontier.link_verdicts(self.links, self._decided, self._admitted, self._hot_rows)
        return judged.select(
            "site_id", "level", "source_rank", "page_url", "source_url", "pos", "url", "url_norm", "verdict"
        )

    @property
    def verdict_counts(self) -> DataFrame:
        """Links per site and verdict, from the decisions alone."""
        keys = ["site_id", "level", "url_norm"]
        entry = self._admitted.withColumn("_admitted", F.lit(True))
        final = self._decided.join(entry, keys, "left")
        one_row = lambda verdict, n: F.struct(verdict.alias("verdict"), n.alias("n"))
        parts = F.when(
            F.col("_admitted"),
            F.array(
                one_row(F.lit("accepted"), F.lit(1).cast("bigint")),
                one_row(F.lit("duplicate"), F.col("links") - 1),
            ),
        ).otherwise(
            F.array(
                one_row(
                    F.when(F.col("verdict") == "open", "budget_full").otherwise(F.col("verdict")),
                    F.col("links"),
                )
            )
        )
        counted = final.select("site_id", F.inline(parts)).where("n > 0")
        return counted.groupBy("site_id", "verdict").agg(F.sum("n").alias("n"))


# What a page says, which visits carry along.
_SAID = ("links", "checks")


def _links(visits: DataFrame) -> DataFrame:
    """The links of fetched pages; no other page has any."""
    return visits.select(
        "site_id",
        F.col("accept_rank").alias("source_rank"),
        (F.col("depth") + 1).alias("level"),
        *frontier.SITE_SCOPE,
        F.col("url").alias("page_url"),
        F.col("final_url").alias("source_url"),
        F.inline("links"),
    )


def _robots_answers(robots: DataFrame | None, agent: str) -> tuple[DataFrame, DataFrame | None] | None:
    """Robots captures read into rules once for the whole crawl, with those of hosts with many; ready answers as they are."""
    if robots is None:
        return None
    if "allowed" in robots.columns:
        return robots, None
    hosts = store(robots_hosts(robots, agent), "robots")
    return hosts, wide_rules(hosts)


def _asked(urls: DataFrame, robots: tuple[DataFrame, DataFrame | None] | None, hot_rows: int | None) -> DataFrame:
    if robots is None:
        return urls.withColumn("allowed", F.lit(True))
    answers, wide = robots
    if "allowed" in answers.columns:
        # a denial among several answers holds
        ready = answers.groupBy("url").agg(F.min("allowed").alias("_allowed"))
        joined = urls.join(ready, ["url"], "left")
        return joined.withColumn("allowed", F.coalesce("_allowed", F.lit(True))).drop("_allowed")
    if hot_rows is None:
        return permitted(urls, answers, hot=False, wide=wide)
    return permitted(urls, answers, hot_rows=hot_rows, wide=wide)


def _visited(
    admitted: DataFrame, pages: DataFrame, answers: tuple[DataFrame, DataFrame | None] | None, hot_rows: int | None
) -> DataFrame:
    """Admitted URLs with what came of them: robots denial, failed fetch, or a response."""
    asked = _asked(admitted, answers, hot_rows)
    answered = visit(asked, pages)
    outcome = (
        F.when(~F.col("allowed"), "robots")
        .when(F.col("fetch_error").isNotNull(), "fetch_error")
        .otherwise("fetched")
    )
    answered = answered.withColumn("outcome", outcome)
    fetched = F.col("outcome") == "fetched"
    columns = {c: F.when(fetched, F.col(c)) for c in ("status", "elapsed_ms", "content_type", "final_url")}
    columns["fetch_error"] = F.when(F.col("outcome") == "fetch_error", F.col("fetch_error"))
    said = F.coalesce(fetched & F.col("has_text"), F.lit(False))
    columns |= {"has_text": said, **{c: F.when(said, F.col(c)) for c in _SAID}}
    return answered.withColumns(columns).select(
        "site_id", "url", "depth", "accept_rank", *frontier.SITE_SCOPE, "outcome", "final_url",
        "status", "elapsed_ms", "content_type", "fetch_error", "has_text", *_SAID,
    )


def _open_pages(pages: DataFrame, parts: list[int]) -> DataFrame:
    """The pages in the given folders; no other folder is listed or read."""
    return pages.where(F.col("part").isin(sorted(parts)))


def _unvisited(pages: DataFrame, levels: list[DataFrame]) -> tuple[DataFrame, int, int]:
    """The pages that none of the given levels has visited, stored as :func:`_store_pages` does."""
    gone = reduce(DataFrame.union, [v.select("site_id", "url") for v in levels])
    left = pages.join(gone, ["site_id", "url"], "left_anti")
    return _store_pages(left)


def _store_pages(pages: DataFrame) -> tuple[DataFrame, int, int]:
    """Pages, stored, with their number and the size of their links as keys."""
    told = Observation()
    rows = pages.observe(told, F.count(F.lit(1)).alias("n"), _links_bytes().alias("size"))
    return store_bucketed(rows, "pages", ["site_id", "url"], "part"), told.get["n"], told.get["size"]


def _key_bytes(site_id: str, url) -> Column:
    """What a key takes up in a broadcast table, about."""
    return F.octet_length(site_id).cast("bigint") + F.coalesce(F.octet_length(url), F.lit(0)) + 48


def _links_bytes() -> Column:
    size = F.aggregate("links", F.lit(0).cast("bigint"), lambda n, link: n + _key_bytes("site_id", link["url_norm"]))
    return F.coalesce(F.sum(size), F.lit(0))


def _store_visits(visits: DataFrame) -> tuple[DataFrame, int, int]:
    """Visits, stored, with the number of pages that have a text and the size of their links as keys."""
    told = Observation()
    visited = store(visits.observe(told, F.count_if("has_text").alias("read"), _links_bytes().alias("size")), "visits")
    return visited, told.get["read"], told.get["size"]


def _looked_up(table: DataFrame, asked: DataFrame, size: int) -> DataFrame:
    """The rows of ``table`` that may be asked for, by keys that both hold under the same names.

    Few keys are broadcast, so that of the table only their rows are moved or sorted.
    """
    return table.join(F.broadcast(asked), asked.columns, "left_semi") if size <= _FEW_BYTES else table


def _together(
    visited: DataFrame, unread: DataFrame, seen: DataFrame, answers: tuple[DataFrame, DataFrame | None] | None, size: int
) -> tuple[DataFrame, DataFrame]:
    """All levels after that of ``visited``: their decisions and their visits, as one table each.

    ``unread`` holds every page that they may reach and is small, links and all (``size``).
    """
    by_site = visited.groupBy("site_id", *frontier.SITE_SCOPE).agg(
        (F.max("depth") + 1).alias("level"), (F.max("accept_rank") + 1).alias("accepted")
    )
    scope = by_site.select("site_id", *frontier.SITE_SCOPE)
    # what every page would say, were it visited
    none = {"depth": F.lit(None).cast("int"), "accept_rank": F.lit(None).cast("bigint")}
    asked = unread.select("site_id", "url").join(scope, "site_id").withColumns(none)
    said = _visited(asked, unread, answers, None)
    links = _links(visited).unionByName(_links(said)).drop(*frontier.SITE_SCOPE, "level")
    known = _looked_up(seen, links.select("site_id", "url_norm"), size)
    edges = links.join(known, ["site_id", "url_norm"], "left_anti").join(by_site, "site_id")
    admitted = frontier.walk(edges)
    visits = store(_visited(admitted.join(scope, "site_id"), unread, answers, None), "visits")

    offered = _links(visited).unionByName(_links(visits))
    since = _looked_up(seen, offered.select("site_id", "url_norm"), size).withColumn("since", F.lit(-1))
    first = visits.select("site_id", F.col("url").alias("url_norm"), F.col("depth").alias("since"))
    return store(frontier.decide_levels(offered, since.unionByName(first)), "decisions"), visits


def rebind(visited_seeds: DataFrame) -> DataFrame:
    """Seeds that were redirected: the site's host is the one that answered."""
    moved = F.col("has_text") & (F.col("final_url") != F.col("url"))
    host = F.when(moved, url_rules.host_of(F.col("final_url"))).otherwise(F.col("scope_host"))
    return visited_seeds.withColumn("scope_host", host)


def _captured_for(responses: DataFrame, sites: DataFrame) -> DataFrame:
    """Responses of the given sites, when the list of sites is small enough to broadcast."""
    ids = sites.select("site_id")
    size = ids.agg(F.sum(F.octet_length("site_id") + 16).alias("n")).first()["n"] or 0
    return responses.join(F.broadcast(ids), "site_id", "left_semi") if size <= BROADCAST_BYTES else responses


def crawl(
    sites: DataFrame,
    responses: DataFrame,
    robots: DataFrame | None = None,
    agent: str = params.ANY_AGENT,
    hot_rows: int = HOT_ROWS,
    page_checks: tuple[str, ...] = (),
) -> Crawl:
    """Replay a breadth-first crawl of every site over a capture.

    ``sites`` gives seed, depth limit and page budget per site; ``responses`` is the capture;
    ``robots`` is either robots captures (host, status, text, fetch_error) or ready answers
    (url, allowed). ``page_checks`` names the checks made on pages while their bodies are read.
    Links are offered in the order of a single worker: level by level, pages in
    the order they were accepted, links in document order.
    """
    started_at = datetime.now(timezone.utc)
    seeds = validate_sites(sites)
    limits = sites.agg(F.max("max_depth").alias("depth"), F.max("max_pages").alias("pages")).first()
    if limits["depth"] is None:
        raise ValueError("there is no site to crawl")
    captured = capture_pages(_captured_for(responses, sites), page_checks)
    pages, n_pages, pages_size = _store_pages(captured.withColumn("part", F.expr(_PART)))

    start = seeds.withColumns({"depth": F.lit(0), "accept_rank": F.lit(0).cast("bigint")})
    answers = _robots_answers(robots, agent)
    first = [r["part"] for r in seeds.select(F.expr(_PART).alias("part")).distinct().collect()]
    visited, n_read, size = _store_visits(rebind(_visited(start, _open_pages(pages, first).drop("part"), answers, hot_rows)))
    levels, decided = [visited], []
    # pages that may still be visited, and how many of them levels from ``since`` on have visited
    unread, n_unread, unread_size, n_gone, since = pages, n_pages, pages_size, n_read, 0
    parts, hot = first, None
    landed = visited.where(F.col("has_text") & (F.col("final_url") != F.col("url")))
    seen = [
        visited.select("site_id", F.col("url").alias("url_norm")),
        landed.select("site_id", F.col("final_url").alias("url_norm")),
    ]
    for level in range(limits["depth"] + 1):
        if level >= _LEVELS_APART and hot is None and unread_size * (1 - n_gone / max(n_unread, 1)) + size <= BROADCAST_BYTES:
            if since < len(levels):
                unread, n_unread, unread_size = _unvisited(_open_pages(unread, parts), levels[since:])
                n_gone, since = 0, len(levels)
            if unread_size + size <= BROADCAST_BYTES:
                left_pages = _open_pages(unread, parts).drop("part")
                decisions, visited = _together(visited, left_pages, reduce(DataFrame.union, seen), answers, unread_size + size)
                decided.append(decisions)
                levels.append(visited)
                break
        offered = _links(visited)
        known = _looked_up(reduce(DataFrame.union, seen), offered.select("site_id", "url_norm"), size)
        # told while the decisions are written: how many URLs are open, how large they are as keys, and in which folders
        # their sites are, a bit each
        left, is_open = Observation(), F.col("verdict") == "open"
        key = F.when(is_open, _key_bytes("site_id", F.col("url_norm")))
        told = F.count_if(is_open).alias("n"), F.sum(key).alias("size"), F.bit_or(F.when(is_open, F.expr(f"shiftleft(1L, {_PART})"))).alias("parts")
        decisions = store(frontier.decide(offered, known).observe(left, *told), "decisions")
        decided.append(decisions)
        n_open = left.get["n"]
        if not n_open:
            break
        parts = [p for p in range(PARTS) if left.get["parts"] >> p & 1]
        if n_gone >= max(_REWRITE_PAGES, n_unread / 2):
            unread, n_unread, unread_size = _unvisited(_open_pages(unread, parts), levels[since:])
            n_gone, since = 0, len(levels)
        # ranks are dense, so the last one of a site says how many pages it has accepted
        by_site = visited.groupBy("site_id", "scope_host")
        accepted = by_site.agg((F.max("accept_rank") + 1).alias("accepted"))
        # fewer open URLs than make a key hot: no site needs a second look
        hot = hot_rows if n_open >= hot_rows else None
        admitted = frontier.cut_budget(decisions, accepted, limits["pages"], hot)
        front = admitted.select(
            "site_id",
            F.col("url_norm").alias("url"),
            F.col("level").alias("depth"),
            "accept_rank",
            *frontier.SITE_SCOPE,
        )
        asked = decisions.where(is_open).select("site_id", F.col("url_norm").alias("url"))
        target = _looked_up(_open_pages(unread, parts).drop("part"), asked, left.get["size"])
        visited, n_read, size = _store_visits(_visited(front, target, answers, hot))
        n_gone += n_read
        levels.append(visited)
        seen.append(visited.select("site_id", F.col("url").alias("url_norm")))
        if len(seen) > _SEEN_PARTS:
            seen = [store(reduce(DataFrame.union, seen), "seen")]
    return Crawl(pages, levels, decided, started_at, hot_rows)
