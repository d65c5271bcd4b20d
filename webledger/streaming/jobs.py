"""The audit as streams: page findings as captures arrive, distinct URLs, pacing, counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from webledger.functions.urls import canonicalize
from webledger.operators.checks import PAGE_CHECKS, with_checks
from webledger.operators.pacing import next_free, pace_schedule
from webledger.plans.report import status_class
from webledger.scale import HOT_ROWS, store

# Batches after which the log of booked hosts is written anew as one table.
_COMPACT_EVERY = 20


def stream_records(responses: DataFrame, names: tuple[str, ...] = PAGE_CHECKS) -> DataFrame:
    """Page records with their findings. Nothing is kept between rows, so memory stays flat."""
    checked = with_checks(responses.where(F.col("fetch_error").isNull()), names)
    depth = F.col("depth") if "depth" in responses.columns else F.lit(None).cast("int").alias("depth")
    return checked.select("site_id", "url", "status", "final_url", "elapsed_ms", depth, "checks")


def stream_audit(responses: DataFrame, out: str, ckpt: str, names: tuple[str, ...] = PAGE_CHECKS) -> StreamingQuery:
    """Append page records to JSON lines under ``out`` as responses arrive."""
    writer = stream_records(responses, names).writeStream.format("json").outputMode("append")
    return (
        writer.option("path", out)
        .option("ignoreNullFields", "false")
        .option("checkpointLocation", ckpt)
        .trigger(availableNow=True)
        .start()
    )


def stream_dedupe(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """Each canonical URL of a stream once, however often it comes: the seen set, kept for good.

    Every URL stays in the state store; on a long stream use the RocksDB provider
    (``spark.sql.streaming.stateStore.providerClass``).
    """
    canonical = canonicalize(urls, url_col).where(F.col("url_norm").isNotNull())
    return canonical.select("url_norm").dropDuplicates(["url_norm"])


def stream_dedupe_recent(
    urls: DataFrame, at_col: str = "at", every: str = "1 day", delay: str = "2 days", url_col: str = "url"
) -> DataFrame:
    """(url_norm, seen_from): each canonical URL once in every window of event time, with state that does not grow for good.

    ``at_col`` says when a URL was seen. A window is forgotten when the watermark, ``delay`` behind the latest time of earlier
    batches, has passed its end; rows that come later still are dropped. So the state holds the URLs of the
    windows within the delay, however long the stream is.
    """
    timed = urls.select(url_col, F.col(at_col).alias("_at")).withWatermark("_at", delay)
    canonical = canonicalize(timed, url_col).where(F.col("url_norm").isNotNull())
    once = canonical.select("url_norm", F.window("_at", every).alias("_w")).dropDuplicates(["url_norm", "_w"])
    return once.select("url_norm", F.col("_w.start").alias("seen_from"))


def stream_counts(visits: DataFrame, by: str = "status") -> DataFrame:
    """Running counts per status, status class or any other column; for output mode ``complete``."""
    if by == "status_class":
        visits = visits.withColumn("status_class", status_class(F.col("status")))
    return visits.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def stream_pace(
    requests: DataFrame, rate: float, out: str, ckpt: str, hot_rows: int = HOT_ROWS
) -> StreamingQuery:
    """Grant every request of a stream its slot, after those granted in earlier batches.

    The state is one number per host, when it is free again. It only grows, so each batch appends
    the hosts it touched to a log and the largest entry of a host counts. A batch writes its grants
    and its log entry under its own number and reads only lower ones: run again after a failure, it
    replaces what it had written. Within a batch a host of any size is cut into ordered chunks.
    """
    spark = requests.sparkSession
    log = f"{ckpt.rstrip('/')}/booked"

    def booked_before(batch: int, base: int) -> DataFrame | None:
        """When hosts are free again after the batches before; each of them has written its entry.

        A missing entry is an error of the folder, not an absence of bookings, and is not hidden.
        """
        paths = [f"{log}/base={base}"] if base else []
        paths += [f"{log}/batch={b}" for b in range(base, batch)]
        if not paths:
            return None
        whole = spark.read.schema("host string, next_free_ms double").parquet(*paths)
        return whole.groupBy("host").agg(F.max("next_free_ms").alias("next_free_ms"))

    def grant(batch_rows: DataFrame, batch: int) -> None:
        base = batch - batch % _COMPACT_EVERY
        if batch and batch == base:
            merged = booked_before(batch, batch - _COMPACT_EVERY)
            merged.write.mode("overwrite").parquet(f"{log}/base={batch}")
        # the schedule looks at its requests more than once
        slots = pace_schedule(store(batch_rows, "requests"), rate, booked_before(batch, base), hot_rows)
        target = f"{out.rstrip('/')}/batch={batch}"
        slots.write.mode("overwrite").parquet(target)
        granted = spark.read.schema(slots.schema).parquet(target)
        free = next_free(granted, rate).select("host", F.col("next_free_ms").cast("double").alias("next_free_ms"))
        free.write.mode("overwrite").parquet(f"{log}/batch={batch}")

    return (
        requests.writeStream.foreachBatch(grant)
        .option("checkpointLocation", f"{ckpt.rstrip('/')}/progress")
        .trigger(availableNow=True)
        .start()
    )
