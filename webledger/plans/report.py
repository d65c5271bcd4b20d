"""The audit report: counters per site, the slowest pages, and the gate."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webledger.params import SLOWEST_KEPT


def _fetched(visits: DataFrame) -> DataFrame:
    return visits.where(F.col("outcome") == "fetched")


def status_class(status: Column) -> Column:
    return F.concat(F.floor(status / 100).cast("string"), F.lit("xx"))


def status_counts(visits: DataFrame) -> DataFrame:
    """Fetched pages per site and status."""
    return _fetched(visits).groupBy("site_id", "status").agg(F.count(F.lit(1)).alias("pages"))


def status_class_counts(visits: DataFrame) -> DataFrame:
    named = _fetched(visits).withColumn("status_class", status_class(F.col("status")))
    return named.groupBy("site_id", "status_class").agg(F.count(F.lit(1)).alias("pages"))


def verdict_counts(verdicts: DataFrame) -> DataFrame:
    """Links per site and verdict, from single links or from counts made earlier (column ``n``)."""
    weight = F.sum("n") if "n" in verdicts.columns else F.count(F.lit(1))
    return verdicts.groupBy("site_id", "verdict").agg(weight.cast("bigint").alias("n"))


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("site_id").agg(
        F.count_if(F.col("severity") == "error").alias("errors"),
        F.count_if(F.col("severity") == "warning").alias("warnings"),
    )


def slowest(visits: DataFrame, n: int = SLOWEST_KEPT) -> DataFrame:
    """The ``n`` slowest pages of each site, slowest first; cut inside the map tasks."""
    order = Window.partitionBy("site_id").orderBy(F.desc("elapsed_ms"), F.desc("final_url"))
    timed = _fetched(visits).where(F.col("elapsed_ms").isNotNull())
    ranked = timed.select("site_id", "final_url", "elapsed_ms").withColumn("place", F.row_number().over(order))
    return ranked.where(F.col("place") <= n)


def build_report(
    sites: DataFrame,
    visits: DataFrame,
    verdicts: DataFrame,
    findings: DataFrame | None = None,
    started_at: datetime | None = None,
    finished_at: datetime | None = None,
) -> DataFrame:
    """One row of counters per site; it never holds pages.

    Each part is aggregated per site before the parts are joined, so a site of any size is one
    row in every join.
    """
    pages = visits.groupBy("site_id").agg(
        F.count_if(F.col("outcome") == "fetched").alias("pages_crawled"),
        F.count_if(F.col("outcome") == "fetch_error").alias("fetch_errors"),
        F.count_if(F.col("outcome") == "robots").alias("skipped_robots"),
    )
    statuses = status_counts(visits).groupBy("site_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "pages")))).alias("status_counts")
    )
    of = lambda v: F.coalesce(F.sum(F.when(F.col("verdict") == v, F.col("n"))), F.lit(0)).cast("bigint")
    links = verdict_counts(verdicts).groupBy("site_id").agg(
        F.sum("n").cast("bigint").alias("links_found"),
        of("off_host").alias("skipped_off_host"),
        of("non_http").alias("skipped_non_http"),
        (of("budget_full") == 0).alias("completed"),
    )
    places = F.array_sort(F.collect_list(F.struct("place", "final_url", "elapsed_ms")))
    named = F.transform(places, lambda p: F.struct(p["final_url"].alias("url"), p["elapsed_ms"].alias("elapsed_ms")))
    slow = slowest(visits).groupBy("site_id").agg(named.alias("slowest"))
    report = sites.select("site_id", "seed_url")
    parts = [pages, statuses, links, slow]
    if findings is not None:
        parts.append(severity_counts(findings))
    for part in parts:
        report = report.join(part, "site_id", "left")
    if findings is None:
        zero = F.lit(0).cast("bigint")
        report = report.withColumns({"errors": zero, "warnings": zero})
    none = F.lit(0).cast("bigint")
    counters = ("pages_crawled", "links_found", "errors", "warnings", "fetch_errors",
                "skipped_off_host", "skipped_robots", "skipped_non_http")
    filled = {c: F.coalesce(c, none) for c in counters}
    filled["completed"] = F.coalesce("completed", F.lit(True))
    filled["status_counts"] = F.coalesce("status_counts", F.create_map().cast("map<int,bigint>"))
    filled["slowest"] = F.coalesce("slowest", F.array().cast("array<struct<url:string,elapsed_ms:double>>"))
    stamps = {"started_at": F.lit(started_at).cast("timestamp"), "finished_at": F.lit(finished_at).cast("timestamp")}
    return report.withColumns({**filled, **stamps}).select(
        "site_id", "seed_url", "started_at", "finished_at", "pages_crawled", "links_found", "status_counts",
        "errors", "warnings", "fetch_errors", "skipped_off_host", "skipped_robots", "skipped_non_http",
        "completed", "slowest", gate(F.col("errors")).alias("gate"),
    )


def gate(errors: Column) -> Column:
    """1 when a finding is an error, else 0: warnings never stop a build."""
    return F.when(errors > 0, F.lit(1)).otherwise(F.lit(0))


def summary(visits: DataFrame, findings: DataFrame) -> DataFrame:
    """What a reader looks at first: pages by status class, slowest pages, broken links."""
    shape = lambda section, item, number: [
        F.col("site_id"), F.lit(section).alias("section"), item.alias("item"), number.cast("double").alias("amount")
    ]
    classes = status_class_counts(visits).select(*shape("status", F.col("status_class"), F.col("pages")))
    slow = slowest(visits).select(*shape("slowest", F.col("final_url"), F.col("elapsed_ms")))
    broken = findings.where((F.col("check") == "links") & (F.col("severity") == "error"))
    broken = broken.groupBy("site_id", "subject").agg(F.count(F.lit(1)).alias("n"))
    return classes.unionByName(slow).unionByName(broken.select(*shape("broken", F.col("subject"), F.col("n"))))
