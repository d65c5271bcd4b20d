"""Judging the links of one level: which are admitted, and why the others are not.

Links are judged per distinct URL. All links of a level are first counted down to one row per
(site, URL) with the place of its earliest offer, inside the map tasks as far as possible, so a URL
linked from every page of a site is one row before anything is shuffled. Verdicts of single links
follow from the row of their URL.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webledger.functions import urls as url_rules
from webledger.operators.joins import mark_seen
from webledger.scale import HOT_ROWS, hot_keys, join_to_one, store, with_row_number

# What a link carries of its site and level; the same for all links of a site within a level. The
# level is data, not a literal, so that Spark compiles the plan of a level only once.
SITE_SCOPE = ("scope_host", "max_depth", "max_pages")
# Offers are ordered by (rank of the page, position on it), packed into one BIGINT: ranks stay under a
# page budget and positions under the length of an array, which are INTs both.
_POSITIONS = 1 << 31
# Spark cuts a ranked window inside the map tasks up to this rank.
_GROUP_LIMIT = 1000


def _offer():
    """Order of an offer as one number, so that its minimum is a plain hash aggregate."""
    return F.col("source_rank").cast("bigint") * F.lit(_POSITIONS).cast("bigint") + F.col("pos")


def first_offer(cand: DataFrame, *by: str) -> DataFrame:
    """One row per (site, URL) offered, and ``by``: number of links, and the earliest as rank and position.

    What links of a site share is taken along as maxima, not as keys: the next join is on (site,
    URL) too, and so needs no further shuffle.
    """
    shared = [c for c in ("level", "max_depth", "max_pages", "on_host") if c in cand.columns and c not in by]
    offered = cand.groupBy("site_id", "url_norm", *by).agg(
        F.count(F.lit(1)).alias("links"), F.min(_offer()).alias("offer"), *[F.max(c).alias(c) for c in shared]
    )
    return offered.withColumns(
        {
            "source_rank": F.shiftright("offer", 31),
            "pos": F.col("offer").bitwiseAND(F.lit(_POSITIONS - 1)).cast("int"),
        }
    )


@cache
def _on_host():
    url = F.col("url_norm")
    http = url.startswith("http://") | url.startswith("https://")
    return F.coalesce(http & (url_rules.canonical_host(url) == F.col("scope_host")), F.lit(False))


@cache
def _verdict():
    url = F.col("url_norm")
    return (
        F.when(url.isNull(), "malformed")
        .when(F.col("seen"), "duplicate")
        .when(~(url.startswith("http://") | url.startswith("https://")), "non_http")
        .when(~F.col("on_host"), "off_host")
        .when(F.col("level") > F.col("max_depth"), "too_deep")
        .otherwise("open")
    )


def decide(cand: DataFrame, seen: DataFrame) -> DataFrame:
    """Every offered URL with its verdict up to the page budget; ``open`` is left to the budget.

    ``cand`` has site_id, level, url_norm, source_rank, pos and the site's scope; ``seen`` holds each
    accepted (site_id, url_norm) of earlier levels once, so this join has no hot key.
    """
    offered = first_offer(cand.withColumn("on_host", _on_host()))
    judged = mark_seen(offered, seen, unique=True).withColumn("verdict", _verdict())
    return judged.drop("seen", "on_host")


def decide_levels(cand: DataFrame, seen: DataFrame) -> DataFrame:
    """:func:`decide` for the links of many levels at once: a row per (site, level, URL).

    ``seen`` also holds the level that accepted the URL as ``since``; it is a duplicate in later levels only.
    """
    offered = first_offer(cand.withColumn("on_host", _on_host()), "level")
    judged = offered.join(seen.select("site_id", "url_norm", "since"), ["site_id", "url_norm"], "left")
    judged = judged.withColumn("seen", F.coalesce(F.col("since") < F.col("level"), F.lit(False)))
    return judged.withColumn("verdict", _verdict()).drop("seen", "since", "on_host")


_WALKED = "site_id string, url string, depth int, accept_rank bigint"


def walk(edges: DataFrame) -> DataFrame:
    """The pages that all further levels of a site admit, with depth and accept rank, in one pass.

    What :func:`decide` and :func:`cut_budget` come to, level by level, for sites of which little is left. ``edges`` holds
    the links that may be followed, none to a URL seen before: those of pages just visited with their rank as ``source_rank``,
    those of pages that may be visited yet with null; and of the site its scope, ``level`` (the next one) and ``accepted``.
    A site is one task, so the caller bounds the size of ``edges``.
    """
    kept = edges.where(_on_host()).select(
        "site_id", "page_url", "source_rank", "pos", "url_norm", "level", "accepted", "max_depth", "max_pages"
    )
    return kept.groupBy("site_id").applyInArrow(_site_walker(), _WALKED)


def _site_walker():
    """The walk of one site; a closure, so that workers need not have this package."""

    def walk_site(edges: pa.Table) -> pa.Table:
        site, level, accepted, deepest, budget = (
            edges[c][0].as_py() for c in ("site_id", "level", "accepted", "max_depth", "max_pages")
        )
        both = pa.chunked_array([*edges["page_url"].chunks, *edges["url_norm"].chunks], pa.string()).combine_chunks()
        named = both.dictionary_encode()
        ids = named.indices.to_numpy(zero_copy_only=False)
        source, target = ids[: len(edges)], ids[len(edges) :]
        rank = pc.fill_null(edges["source_rank"], -1).to_numpy()
        pos = edges["pos"].to_numpy()
        # the links of pages just visited, in offer order; then those of each other page, in document order
        now = np.flatnonzero(rank >= 0)
        offers = target[now[np.lexsort((pos[now], rank[now]))]]
        later = np.flatnonzero(rank < 0)
        later = later[np.lexsort((pos[later], source[later]))]
        linked = target[later]
        begins, ends = (np.searchsorted(source[later], np.arange(len(named.dictionary)), side) for side in ("left", "right"))

        seen = np.zeros(len(named.dictionary), bool)
        pages, depths = [np.zeros(0, ids.dtype)], [np.zeros(0, np.int32)]
        while len(offers) and level <= deepest and accepted < budget:
            fresh = offers[~seen[offers]]
            _, first = np.unique(fresh, return_index=True)
            page = fresh[np.sort(first)][: budget - accepted]
            seen[page] = True
            pages.append(page)
            depths.append(np.full(len(page), level, np.int32))
            level, accepted = level + 1, accepted + len(page)
            offers = np.concatenate([linked[:0], *(linked[b:e] for b, e in zip(begins[page], ends[page], strict=True))])
        page = np.concatenate(pages)
        start = accepted - len(page)
        return pa.table(
            {
                "site_id": pa.array([site] * len(page), pa.string()),
                "url": named.dictionary.take(pa.array(page)),
                "depth": pa.array(np.concatenate(depths)),
                "accept_rank": pa.array(np.arange(start, accepted, dtype=np.int64)),
            }
        )

    return walk_site


def cut_budget(
    decided: DataFrame,
    accepted: DataFrame,
    largest_budget: int | None = None,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """The open URLs that the page budget still admits, in offer order, with their accept rank.

    ``accepted`` holds, per site, how many pages it has accepted before, and may hold more about the
    site. Budgets up to
    ``largest_budget`` pages are cut inside the map tasks when that number is small; beyond it a
    site with very many open URLs is ranked in parallel chunks (``hot_rows=None``: there is none).
    """
    open_urls = decided.where(F.col("verdict") == "open")
    # what is left of a site after the cut is no more than its budget
    cut_early = largest_budget is not None and largest_budget <= _GROUP_LIMIT
    if cut_early:
        order = Window.partitionBy("site_id").orderBy("offer")
        ranked = open_urls.withColumn("_rank", F.row_number().over(order))
        ranked = ranked.where(F.col("_rank") <= largest_budget)
    else:
        ranked = with_row_number(open_urls, ["site_id"], ["offer"], "_rank", hot_rows)
    counted = join_to_one(
        ranked,
        accepted,
        ["site_id"],
        ["url_norm"],
        hot=False if cut_early or hot_rows is None else hot_keys(open_urls, ["site_id"], hot_rows),
    )
    admitted = counted.where(F.col("_rank") <= F.col("max_pages") - F.col("accepted"))
    rank = (F.col("accepted") + F.col("_rank") - 1).cast("bigint")
    return admitted.withColumn("accept_rank", rank).drop("_rank", "accepted", "verdict")


def link_verdicts(
    cand: DataFrame, decided: DataFrame, admitted: DataFrame, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """The verdict of every single link, from the decisions on their URLs.

    Of an admitted URL the earliest link is accepted and the others are duplicates; links to an
    open URL that was not admitted met a full budget. A much-linked URL is salted: ``decided``
    already knows how many links each has.
    """
    keys = ["site_id", "level", "url_norm"]
    entry = admitted.select("site_id", "level", "url_norm", F.lit(True).alias("_admitted"))
    final = decided.where(F.col("url_norm").isNotNull()).join(entry, keys, "left")
    final = final.select(*keys, F.col("offer").alias("_first"), F.col("verdict").alias("_verdict"), "_admitted")
    hot = store(decided.where(F.col("links") >= hot_rows).select(*keys), "hot")
    joined = join_to_one(cand, final, keys, ["source_rank", "pos"], hot=hot)
    verdict = (
        F.when(F.col("url_norm").isNull(), "malformed")
        .when(F.col("_verdict") != "open", F.col("_verdict"))
        .when(F.col("_admitted").isNull(), "budget_full")
        .when(_offer() == F.col("_first"), "accepted")
        .otherwise("duplicate")
    )
    return joined.withColumn("verdict", verdict).drop("_first", "_verdict", "_admitted")


def judge(cand: DataFrame, seen: DataFrame, accepted: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add ``verdict`` to the links of one level (see :func:`decide` for their columns)."""
    decided = decide(cand, seen)
    admitted = cut_budget(decided, accepted, hot_rows=hot_rows)
    return link_verdicts(cand, decided, admitted, hot_rows)
