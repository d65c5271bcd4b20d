"""Joins between links, captures, sites and the seen set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webledger.functions import urls as url_rules
from webledger.scale import join_small, join_to_one


def pick(rows: DataFrame, keys: list[str], first: list[str]) -> DataFrame:
    """One row per key: the smallest by the columns ``first``, nulls first, then by all others.

    The one rule for repeated captures; a null ``fetch_error`` is a successful fetch.
    """
    rest = [c for c in rows.columns if c not in keys]
    orderable = [c for c in rest if not rows.schema[c].dataType.simpleString().startswith("map")]
    order = [c for c in first if c in orderable] + [c for c in orderable if c not in first]
    row = F.struct(*order, *[c for c in rest if c not in orderable])
    least = F.min_by(row, F.struct(*order)) if len(orderable) < len(rest) else F.min(row)
    return rows.groupBy(*keys).agg(least.alias("_p")).select(*keys, *[F.col(f"_p.{c}").alias(c) for c in rest])


# What decides between captures of one page.
CAPTURE_ORDER = ["fetch_error", "final_url", "status"]


def with_site(df: DataFrame, sites: DataFrame) -> DataFrame:
    """Add the parameters of its site to every row; the row's other columns spread a hot site."""
    spread = [c for c in df.columns if c != "site_id"]
    return join_small(df, sites, ["site_id"], spread)


def visit(frontier: DataFrame, responses: DataFrame) -> DataFrame:
    """The capture of every frontier URL; a URL that was never captured is a 404 without a body.

    Both sides hold a (site_id, url) once, so the join has no hot key.
    """
    captured = responses.select(
        "site_id",
        "url",
        *[c for c in responses.columns if c not in ("site_id", "url")],
        F.lit(True).alias("_captured"),
    )
    joined = frontier.join(captured, ["site_id", "url"], "left")
    absent = F.col("_captured").isNull()
    filled = {
        "status": F.when(absent, F.lit(404)).otherwise(F.col("status")),
        "content_type": F.coalesce("content_type", F.lit("")),
        "final_url": F.coalesce("final_url", "url"),
    }
    present = {name: column for name, column in filled.items() if name in responses.columns}
    return joined.withColumns(present).drop("_captured")


def lookup(urls: DataFrame, responses: DataFrame) -> DataFrame:
    """Captures by URL with the rules of :func:`visit`, for a table with any number of asks.

    Every ask stays one row: of several captures of a URL, :func:`pick` takes one.
    """
    keys = [c for c in ("site_id", "url") if c in urls.columns]
    captured = pick(responses, keys, CAPTURE_ORDER).withColumn("_captured", F.lit(True))
    spread = [c for c in urls.columns if c not in keys] or keys
    joined = join_to_one(urls, captured, keys, spread)
    return joined.withColumns(
        {
            "status": F.when(F.col("_captured").isNull(), 404).otherwise(F.col("status")),
            "content_type": F.coalesce("content_type", F.lit("")),
            "final_url": F.coalesce("final_url", "url"),
        }
    ).drop("_captured")


def mark_seen(cand: DataFrame, seen: DataFrame, unique: bool = False) -> DataFrame:
    """Add ``seen`` to candidates, every duplicate kept so that it can be counted.

    ``unique``: both tables hold a (site_id, url_norm) once, so neither has to be looked at for repeated or hot keys.
    """
    known = seen.select("site_id", "url_norm")
    known = (known if unique else known.distinct()).withColumn("_seen", F.lit(True))
    spread = [c for c in cand.columns if c not in ("site_id", "url_norm")] or ["url_norm"]
    joined = join_to_one(cand, known, ["site_id", "url_norm"], spread, hot=False if unique else None)
    return joined.withColumn("seen", F.coalesce("_seen", F.lit(False))).drop("_seen")


def link_status(links: DataFrame, responses: DataFrame) -> DataFrame:
    """Links with the status of their target and the page they stand on.

    ``status`` is null when the capture does not hold the target, or when fetching it failed.
    A much-linked target is salted. ``links`` is read twice (once for the heavy targets, only its
    keys), so on a large capture pass a stored table.
    """
    keyed = links if "url_norm" in links.columns else url_rules.canonicalize(links)
    slim = responses.select("site_id", "url", *[c for c in CAPTURE_ORDER if c in responses.columns])
    target = url_rules.canonicalize(slim, "url").where(F.col("url_norm").isNotNull()).drop("url")
    target = pick(target, ["site_id", "url_norm"], CAPTURE_ORDER)
    target = target.select("site_id", "url_norm", F.col("status").alias("target_status"))
    return join_to_one(keyed, target, ["site_id", "url_norm"], ["page_url", "pos"])
