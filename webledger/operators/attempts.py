"""Retried requests as a log: outcome, attempts used, pauses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webledger.params import RetryPolicy


def retryable(policy: RetryPolicy) -> Column:
    """Another try may change it: a transport failure or one of the policy's statuses."""
    return F.col("fetch_error").isNotNull() | F.coalesce(
        F.col("status").isin(*policy.retry_statuses), F.lit(False)
    )


def resolve_attempts(attempts: DataFrame, policy: RetryPolicy = RetryPolicy()) -> DataFrame:
    """One row per request: its first final answer, else whatever its last attempt gave."""
    allowed = attempts.where(F.col("attempt") < policy.attempts).withColumn("_again", retryable(policy))
    answer = F.struct("attempt", "status", "fetch_error", "elapsed_ms")
    final = F.min(F.when(~F.col("_again"), answer))
    last = F.max(answer)
    picked = allowed.groupBy("request_id").agg(F.coalesce(final, last).alias("_answer"))
    return picked.select(
        "request_id",
        F.col("_answer.status").alias("status"),
        F.col("_answer.fetch_error").alias("fetch_error"),
        F.col("_answer.elapsed_ms").alias("elapsed_ms"),
        (F.col("_answer.attempt") + 1).alias("attempts_used"),
    )


def attempt_usage(attempts: DataFrame, policy: RetryPolicy = RetryPolicy()) -> DataFrame:
    """Per request: attempts logged, attempts needed, and those made after it was settled.

    A request is settled by its first final answer, or by its last permitted attempt.
    """
    final = F.when(~retryable(policy), F.col("attempt"))
    counted = attempts.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("attempts"),
        F.least(F.min(final), F.lit(policy.attempts - 1)).alias("_settled"),
        F.max("attempt").alias("_last"),
    )
    needed = (F.least(F.col("_settled"), F.col("_last")) + 1).cast("bigint")
    return counted.select(
        "request_id",
        "attempts",
        needed.alias("attempts_used"),
        (F.col("attempts") - needed).alias("wasted"),
    )


def backoff_audit(
    attempts: DataFrame, policy: RetryPolicy = RetryPolicy(), queued_ms_col: str | None = None
) -> DataFrame:
    """Pauses between attempts that are longer than the policy's window for them.

    Any pause inside the window is legal, so only longer ones are rows. A request has at most
    ``policy.attempts`` rows here, whatever the log holds: no group of the window is large.
    """
    own = Window.partitionBy("request_id").orderBy("attempt")
    numbered = attempts.where(F.col("attempt") < policy.attempts)
    started = F.unix_micros("at")
    if queued_ms_col is not None:
        # the next start was put off by queueing for its host's turn
        started_next = F.lead(started - F.coalesce(F.col(queued_ms_col), F.lit(0)) * 1000).over(own)
    else:
        started_next = F.lead(started).over(own)
    pause = (started_next - started) / 1000.0 - F.col("elapsed_ms")
    window = F.least(
        F.lit(policy.base_delay * 1000.0) * F.pow(F.lit(2.0), F.col("attempt")),
        F.lit(policy.max_delay * 1000.0),
    )
    audited = numbered.select(
        "request_id", "attempt", pause.alias("pause_ms"), window.alias("window_ms")
    )
    return audited.where(F.col("pause_ms") > F.col("window_ms"))
