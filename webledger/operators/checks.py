"""Findings about pages and links.

Checks of single pages are column expressions collected into one array per page, so any number of
them costs one pass over the bodies. Checks that need other tables are DataFrame functions. Both
kinds register under a name and are put together by :func:`run_checks`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webledger import params
from webledger.functions import html
from webledger.functions import urls as url_rules
from webledger.operators.joins import link_status
from webledger.operators.urls import parseable
from webledger.scale import HOT_ROWS, join_to_one, store

# Redirects a client follows before it gives a chain up; longer chains are labelled, not cut.
MAX_HOPS = 20


def finding(check: str, severity: str, message: Column | str, subject: Column | None = None) -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    about = F.lit(None).cast("string") if subject is None else subject
    if severity not in params.SEVERITIES:
        raise ValueError(f"unknown severity: {severity}")
    return F.struct(
        F.lit(check).alias("check"),
        F.lit(severity).alias("severity"),
        text.alias("message"),
        about.alias("subject"),
    )


@dataclass(frozen=True)
class Check:
    """A named rule over a table of pages that returns findings (site_id, page_url, check, …)."""

    name: str
    run: Callable[[DataFrame], DataFrame]


@cache
def _fact_columns() -> tuple[Column, ...]:
    tags = F.col("_tags")
    return (
        html.hrefs_of(tags).alias("hrefs"),
        html.sources_of(tags).alias("_srcs"),
        html.title_of(tags).alias("_title"),
        html.description_of(tags).alias("_description"),
        html.canonical_href_of(tags).alias("_canonical"),
        html.h1_count_of(tags).alias("_h1"),
    )


def _facts(pages: DataFrame) -> DataFrame:
    """Pages without their bodies, but with the facts that hrefs and page checks are made from.

    One expression goes over a body and cuts out the few tags that matter; all facts are read from those.
    """
    site = [] if "site_id" in pages.columns else [F.lit("").alias("site_id")]
    kept = [c for c in pages.columns if c not in ("final_url", "text")]
    documents = pages.select(
        *site,
        *kept,
        F.coalesce("final_url", "url").alias("final_url"),
        html.tags(F.col("text")).alias("_tags"),
    )
    facts = documents.select(*[c for c in documents.columns if c != "_tags"], *_fact_columns())
    named = url_rules.resolve(facts, "final_url", "_canonical", "_target")
    return url_rules.canonicalize(url_rules.canonicalize(named, "_target", "_target_norm"), "final_url", "_own")


@cache
def _page_findings() -> dict[str, Column]:
    """The page checks by name: each an array of findings, null entries meaning nothing is wrong."""

    def absent(fact: str, what: str) -> Column:
        value = F.col(fact)
        return F.array(
            F.when(value.isNull(), finding("meta", "warning", f"{what} missing")).when(
                value == "", finding("meta", "warning", f"{what} empty")
            )
        )

    elsewhere = F.coalesce(F.col("_target_norm") != F.col("_own"), F.lit(True))
    canonical = F.array(
        F.when(
            F.coalesce("_canonical", F.lit("")) == "", finding("meta", "warning", "canonical missing")
        ).when(
            elsewhere,
            finding("meta", "warning", "canonical differs", F.coalesce("_target_norm", "_target")),
        )
    )
    heading = F.array(
        F.when(
            F.col("_h1") != 1,
            finding("meta", "warning", F.concat(F.lit("h1 count "), F.col("_h1").cast("string"))),
        )
    )
    insecure = F.filter(
        F.transform(F.concat("hrefs", "_srcs"), html.unquoted), lambda u: u.rlike(r"(?i)^\s*http:")
    )
    mixed = F.when(
        url_rules.scheme_of(F.col("final_url")) == "https",
        F.transform(
            F.array_distinct(insecure), lambda u: finding("links", "warning", "mixed content", F.trim(u))
        ),
    ).otherwise(F.array().cast(f"array<{params.FINDING}>"))
    return {
        "title": absent("_title", "title"),
        "description": absent("_description", "description"),
        "canonical": canonical,
        "h1": heading,
        "mixed": mixed,
    }


PAGE_CHECKS = ("title", "description", "canonical", "h1", "mixed")


def with_checks(pages: DataFrame, names: tuple[str, ...] = PAGE_CHECKS) -> DataFrame:
    """Pages without bodies, each with ``hrefs`` as written and ``checks``, the array of its findings.

    A narrow plan: one pass over the bodies, whatever the number of checks. A page without text has
    null hrefs and no findings.
    """
    known = _page_findings()
    unknown = [n for n in names if n not in known]
    if unknown:
        raise ValueError(f"unknown page checks: {', '.join(unknown)}")
    none = F.array().cast(f"array<{params.FINDING}>")
    found = F.array_compact(F.concat(none, *[known[n] for n in names]))
    facts = _facts(pages)
    checked = facts.withColumn("checks", F.when(F.col("hrefs").isNotNull(), found).otherwise(none))
    return checked.select(*[c for c in checked.columns if not c.startswith("_")])


def page_findings(pages: DataFrame, names: tuple[str, ...] = PAGE_CHECKS) -> DataFrame:
    """Findings of the named page checks, in one pass over the pages."""
    checked = with_checks(parseable(pages), names)
    # the outer form keeps Spark from making the checks twice, once to see if there are findings
    found = checked.select("site_id", F.col("url").alias("page_url"), F.inline_outer("checks"))
    return found.where(F.col("check").isNotNull())


def check_title(pages: DataFrame) -> DataFrame:
    return page_findings(pages, ("title",))


def check_description(pages: DataFrame) -> DataFrame:
    return page_findings(pages, ("description",))


def check_canonical(pages: DataFrame) -> DataFrame:
    return page_findings(pages, ("canonical",))


def check_h1(pages: DataFrame) -> DataFrame:
    return page_findings(pages, ("h1",))


def check_mixed(pages: DataFrame) -> DataFrame:
    """Links, images and scripts that an https page asks for over http."""
    return page_findings(pages, ("mixed",))


def _as_findings(rows: DataFrame, found: Column) -> DataFrame:
    return rows.select("site_id", "page_url", found.alias("_f")).select("site_id", "page_url", "_f.*")


def check_broken(links: DataFrame, responses: DataFrame) -> DataFrame:
    """Links whose captured target answered 4xx or 5xx: one error per page and target."""
    broken = link_status(links, responses).where(F.col("target_status") >= 400)
    per_page = broken.select("site_id", "page_url", "url_norm").distinct()
    return _as_findings(per_page, finding("links", "error", "broken link", F.col("url_norm")))


def redirect_chains(hops: DataFrame, max_hops: int = MAX_HOPS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Where every redirecting URL (``url, location, status``) ends, and after how many hops.

    Every round joins the chains found so far to themselves and so doubles the length they may
    have. As long as a chain with an end is not followed to it, each round ends some of its URLs; when
    a round ends none, all that still go on are a ``loop`` or lead into one, and have no end and
    length. ``over_limit`` marks loops and chains of more than ``max_hops``, which clients give up. Of several
    redirects of one URL the smallest target is followed.
    """
    site = [F.col("site_id")] if "site_id" in hops.columns else [F.lit("").alias("site_id")]
    moved = hops.where(F.col("status").between(300, 399) & F.col("location").isNotNull())
    moved = moved.select(*site, "url", "location")
    named = url_rules.resolve(moved, "url", "location", "_next")
    named = url_rules.canonicalize(url_rules.canonicalize(named, "url", "_from"), "_next", "_to")
    steps = named.where(F.col("_from").isNotNull() & F.col("_to").isNotNull())
    chains = steps.groupBy("site_id", F.col("_from").alias("url")).agg(F.min("_to").alias("end"))
    chains = store(chains.withColumns({"hops": F.lit(1).cast("bigint"), "going": F.lit(True)}), "chains")
    before, left = -1, chains.where("going").count()
    while left and left != before:
        onward = chains.select(
            "site_id", F.col("url").alias("end"), F.col("end").alias("_end"),
            F.col("hops").alias("_hops"), F.col("going").alias("_going"),
        )
        joined = join_to_one(chains, onward, ["site_id", "end"], ["url"], hot_rows=hot_rows)
        further = F.col("going") & F.col("_end").isNotNull()
        chains = store(
            joined.select(
                "site_id",
                "url",
                F.when(further, F.col("_end")).otherwise(F.col("end")).alias("end"),
                F.when(further, F.col("hops") + F.col("_hops")).otherwise(F.col("hops")).alias("hops"),
                (further & F.col("_going")).alias("going"),
            ),
            "chains",
        )
        before, left = left, chains.where("going").count()
    loop = F.col("going")
    return chains.select(
        "site_id",
        "url",
        F.when(~loop, F.col("end")).alias("final_url"),
        F.when(~loop, F.col("hops")).alias("hops"),
        loop.alias("loop"),
        (loop | (F.col("hops") > max_hops)).alias("over_limit"),
    )


def check_redirects(chains: DataFrame, min_hops: int = 2) -> DataFrame:
    """Pages reached only over several redirects, and those that are never reached (see :func:`redirect_chains`)."""
    long = chains.where(F.col("loop") | (F.col("hops") >= min_hops)).withColumnRenamed("url", "page_url")
    counted = F.concat(F.lit("redirect chain length "), F.col("hops").cast("string"))
    message = F.when(F.col("loop"), "redirect loop").otherwise(counted)
    return _as_findings(long, finding("links", "warning", message))


def run_checks(pages: DataFrame, checks: list[Check]) -> DataFrame:
    """Findings of all checks put together."""
    names = [c.name for c in checks]
    if len(set(names)) != len(names):
        raise ValueError(f"a check is registered twice: {', '.join(names)}")
    columns = ["site_id", "page_url", "check", "severity", "message", "subject"]
    return reduce(DataFrame.unionByName, [c.run(pages).select(*columns) for c in checks])
