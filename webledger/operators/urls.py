"""Jobs over URL tables: canonical forms, link resolution, host and scheme rules."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webledger.functions import html
from webledger.functions import urls as url_rules
from webledger.functions.urls import canonicalize

__all__ = [
    "canonicalize",
    "crawlable",
    "dedupe_urls",
    "extract_links",
    "hosts",
    "inlinks",
    "is_redirect",
    "malformed_urls",
    "parseable",
    "resolve_links",
    "same_host",
    "with_host",
]


def malformed_urls(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Rows whose URL has no canonical form."""
    return canonicalize(df, url_col, "_canonical").where(F.col("_canonical").isNull()).drop("_canonical")


def with_host(df: DataFrame, url_col: str = "url") -> DataFrame:
    return df.withColumn("host", url_rules.host_of(F.col(url_col)))


def is_redirect(df: DataFrame) -> DataFrame:
    """Add ``redirected``: the response came from another URL than the one asked for."""
    return df.withColumn("redirected", F.coalesce(F.col("final_url") != F.col("url"), F.lit(False)))


def crawlable(links: DataFrame, url_col: str = "url") -> DataFrame:
    """Links whose scheme can be crawled. Relative URLs have none and are left out."""
    return links.where(url_rules.is_crawlable(F.col(url_col)))


def same_host(links: DataFrame, sites: DataFrame) -> DataFrame:
    """Links that stay on the host of their site's seed."""
    from webledger.operators.joins import with_site

    scoped = with_site(links, sites.select("site_id", "seed_url"))
    return scoped.where(url_rules.same_host(F.col("seed_url"), F.col("url"))).drop("seed_url")


def parseable(responses: DataFrame) -> DataFrame:
    """Responses with a text body, whatever their status and text type."""
    return responses.where(F.col("text").isNotNull())


def resolve_links(hrefs: DataFrame, base_col: str = "source_url", href_col: str = "href_raw") -> DataFrame:
    """Add ``url``: the href as an absolute URL, or as written where that cannot be made."""
    return url_rules.resolve(hrefs, base_col, href_col, "url")


def extract_links(pages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per anchor href of each page, in document order, duplicates kept.

    The base of a page is its ``final_url``. The body is dropped before anything is moved: the
    whole job is one pass over the pages without a shuffle.
    """
    carried = [c for c in ("site_id", *keep) if c in pages.columns]
    hrefs = parseable(pages).select(
        *carried,
        F.col("url").alias("page_url"),
        F.coalesce("final_url", "url").alias("source_url"),
        # the outer form keeps Spark from cutting the hrefs twice, once to see if there are any
        F.posexplode_outer(html.raw_hrefs(F.col("text"))).alias("pos", "href_raw"),
    )
    return links_from_hrefs(hrefs)


@cache
def written_href():
    """A raw href value without quotes and references; null where it is empty, and so no link."""
    return F.when(~F.col("href_raw").isin('""', "''"), html.unquoted(F.col("href_raw")))


def links_from_hrefs(hrefs: DataFrame) -> DataFrame:
    """Raw href values, as cut from the document, to resolved links; empty ones are no links."""
    written = hrefs.where(F.col("href_raw").isNotNull() & ~F.col("href_raw").isin('""', "''"))
    written = written.withColumn("href_raw", written_href())
    return resolve_links(written).withColumn("text", F.lit(""))


def dedupe_urls(
    df: DataFrame, url_col: str = "url", pick: str | None = None, keep: tuple[str, ...] | None = None
) -> DataFrame:
    """One row per canonical URL: the one with the smallest ``pick`` value, or any one.

    Only the columns in ``keep`` (default: all) are moved; leave bodies out.
    """
    canonical = df if "url_norm" in df.columns else canonicalize(df, url_col)
    canonical = canonical.where(F.col("url_norm").isNotNull())
    others = [c for c in (canonical.columns if keep is None else keep) if c != "url_norm"]
    if pick is None:
        return canonical.select(*others, "url_norm").dropDuplicates(["url_norm"])
    if others == [pick]:
        return canonical.groupBy("url_norm").agg(F.min(pick).alias(pick)).select(pick, "url_norm")
    picked = canonical.groupBy("url_norm").agg(F.min_by(F.struct(*others), F.col(pick)).alias("_row"))
    return picked.select(*[F.col(f"_row.{c}").alias(c) for c in others], "url_norm")


def hosts(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """Distinct hosts: each asks for one robots.txt, however many URLs it has."""
    named = urls.select(url_rules.host_of(F.col(url_col)).alias("host"))
    return named.where(F.col("host").isNotNull()).distinct()


def inlinks(links: DataFrame) -> DataFrame:
    """How often, and from how many pages, each target is linked."""
    canonical = links if "url_norm" in links.columns else canonicalize(links)
    per_page = canonical.groupBy("url_norm", "source_url").agg(F.count(F.lit(1)).alias("_n"))
    return per_page.groupBy("url_norm").agg(
        F.sum("_n").alias("links"), F.count("source_url").alias("pages")
    )
