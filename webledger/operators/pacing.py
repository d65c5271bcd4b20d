"""Even spacing of requests per host: the schedule, and gaps that break it.

The rule "slot = max(arrival, previous slot + interval)" has a closed form: with k requests before
it, a request's slot is ``k * interval + max(arrival_j - j * interval)`` over all j up to itself.
Counts and maxima can be put together from parts, so a host that holds most of the log is cut into
ordered chunks, each handled by its own task. Requests without a host are those of one host.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webledger.params import interval_ms
from webledger.scale import HOT_ROWS, join_null_safe, join_to_one, ordered_chunks, split_hot


def _interval(rate: float):
    interval = round(interval_ms(rate), 6)
    return F.lit(int(interval)).cast("bigint") if float(interval).is_integer() else F.lit(interval)


def _slot_type(requests: DataFrame, rate: float) -> str:
    """Slots are whole numbers when arrivals and interval are."""
    whole = float(round(interval_ms(rate), 6)).is_integer()
    return "bigint" if whole and dict(requests.dtypes)["arrival_ms"] in ("bigint", "int") else "double"


def _up_to(*keys: str, order: tuple[str, ...]):
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _earlier_chunks(key: str):
    return Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)


def pace_schedule(
    requests: DataFrame, rate: float, booked: DataFrame | None = None, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Add ``slot_ms`` and ``wait_ms`` to requests (``request_id, host, arrival_ms``).

    Requests of a host are served by (arrival, id). ``booked`` (host, next_free_ms) holds hosts
    whose earlier requests are not in this table.
    """
    step = _interval(rate)
    order = ("arrival_ms", "request_id")
    ready = F.col("arrival_ms")
    if booked is not None:
        free = booked.select("host", "next_free_ms")
        requests = join_to_one(requests, free, ["host"], ["request_id"], hot_rows=hot_rows)
        ready = F.greatest("arrival_ms", "next_free_ms")
    requests = requests.withColumn("_ready", ready.cast(_slot_type(requests, rate)))
    heavy, rest = split_hot(requests, ["host"], hot_rows)
    inside = Window.partitionBy("host").orderBy(*order)
    numbered = rest.withColumn("_k", F.row_number().over(inside) - 1)
    best = F.max(F.col("_ready") - F.col("_k") * step).over(_up_to("host", order=order))
    slots = numbered.withColumn("slot_ms", F.col("_k") * step + best)
    if heavy is not None:
        slots = slots.unionByName(_slots_in_chunks(heavy, order, step).select(slots.columns))
    return slots.withColumn("wait_ms", F.col("slot_ms") - F.col("arrival_ms")).drop("_k", "_ready", "next_free_ms")


def _slots_in_chunks(requests: DataFrame, order: tuple[str, ...], step) -> DataFrame:
    """Slots of hosts with very many requests, put together from chunks."""
    chunks = ordered_chunks(requests, ["host"], list(order))
    inside = Window.partitionBy("host", "_chunk").orderBy(*order)
    numbered = chunks.withColumn("_k", F.row_number().over(inside) - 1)
    numbered = numbered.withColumn("_lead", F.col("_ready") - F.col("_k") * step)
    parts = numbered.groupBy("host", "_chunk").agg(F.count(F.lit(1)).alias("_n"), F.max("_lead").alias("_top"))
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(_earlier_chunks("host")), F.lit(0)))
    parts = parts.withColumn("_carry", F.max(F.col("_top") - F.col("_before") * step).over(_earlier_chunks("host")))
    local = F.max("_lead").over(_up_to("host", "_chunk", order=order))
    joined = join_null_safe(numbered.withColumn("_lead", local), parts.drop("_n", "_top"), ["host", "_chunk"])
    best = F.greatest(F.col("_carry"), F.col("_lead") - F.col("_before") * step)
    return joined.withColumn("slot_ms", (F.col("_before") + F.col("_k")) * step + best)


def next_free(schedule: DataFrame, rate: float) -> DataFrame:
    """When each host is free again after a schedule."""
    return schedule.groupBy("host").agg((F.max("slot_ms") + _interval(rate)).alias("next_free_ms"))


def pace_violations(log: DataFrame, rate: float, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Requests (``request_id, host, at_ms``) that follow the one before them too soon."""
    step = _interval(rate)
    order = ("at_ms", "request_id")
    heavy, rest = split_hot(log, ["host"], hot_rows)
    before = rest.withColumn("_prev", F.lag("at_ms").over(Window.partitionBy("host").orderBy(*order)))
    if heavy is not None:
        chunks = ordered_chunks(heavy, ["host"], list(order))
        inside = Window.partitionBy("host", "_chunk").orderBy(*order)
        parts = chunks.groupBy("host", "_chunk").agg(F.max("at_ms").alias("_last"))
        parts = parts.select("host", "_chunk", F.max("_last").over(_earlier_chunks("host")).alias("_carry"))
        followed = join_null_safe(chunks.withColumn("_own", F.lag("at_ms").over(inside)), parts, ["host", "_chunk"])
        followed = followed.withColumn("_prev", F.coalesce("_own", "_carry"))
        before = before.unionByName(followed.select(before.columns))
    gaps = before.withColumn("gap_ms", F.col("at_ms") - F.col("_prev")).drop("_prev")
    return gaps.where(F.col("gap_ms") < step)
