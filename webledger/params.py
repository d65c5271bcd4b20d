"""Table schemas, job parameters and the checks made on them before a plan is built."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# Windows-1252 for the bytes 80 to 9F; U+FFFD where it has none.
CP1252 = "€�‚ƒ„…†‡ˆ‰Š‹Œ�Ž��‘’“”•–—˜™š›œ�žŸ"

RESPONSES = T.StructType(
    [
        T.StructField("site_id", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("final_url", T.StringType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("elapsed_ms", T.DoubleType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("fetch_error", T.StringType()),
    ]
)

RAW_CAPTURES = T.StructType(
    [
        T.StructField("site_id", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("final_url", T.StringType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
        T.StructField("body", T.BinaryType()),
        T.StructField("elapsed_ms", T.DoubleType()),
        T.StructField("fetch_error", T.StringType()),
    ]
)

ROBOTS_CAPTURES = T.StructType(
    [
        T.StructField("host", T.StringType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("fetch_error", T.StringType()),
    ]
)

SITES = T.StructType(
    [
        T.StructField("site_id", T.StringType()),
        T.StructField("seed_url", T.StringType()),
        T.StructField("max_depth", T.IntegerType()),
        T.StructField("max_pages", T.IntegerType()),
    ]
)

ATTEMPTS = T.StructType(
    [
        T.StructField("request_id", T.LongType()),
        T.StructField("attempt", T.IntegerType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("fetch_error", T.StringType()),
        T.StructField("at", T.TimestampType()),
        T.StructField("elapsed_ms", T.DoubleType()),
    ]
)

FINDING = "struct<check:string,severity:string,message:string,subject:string>"

# The words used for severities, verdicts and visit outcomes.
SEVERITIES = ("error", "warning", "info")
VERDICTS = (
    "accepted",
    "duplicate",
    "off_host",
    "non_http",
    "too_deep",
    "budget_full",
    "malformed",
)
OUTCOMES = ("fetched", "robots", "fetch_error")

# Statuses that may change on another try.
RETRY_STATUSES = (408, 429, 500, 502, 503, 504)

# Defaults of a crawl, a request and the report.
DEFAULT_MAX_DEPTH = 3
DEFAULT_MAX_PAGES = 500
DEFAULT_TIMEOUT_S = 10.0
DEFAULT_MAX_BODY_BYTES = 10 * 1024 * 1024
SLOWEST_KEPT = 10

# robots.txt group used when the caller names no crawler token of its own.
ANY_AGENT = "*"


@dataclass(frozen=True, kw_only=True)
class RetryPolicy:
    """How often a request may be tried and how long the pauses between tries may grow."""

    # How often and how patiently a client tries.
    attempts: int = 3
    base_delay: float = 0.5
    max_delay: float = 10.0
    retry_statuses: tuple[int, ...] = field(default=RETRY_STATUSES)

    def __post_init__(self) -> None:
        if self.attempts < 1:
            raise ValueError(f"a request needs at least one attempt, not {self.attempts}")


def interval_ms(rate: float) -> float:
    """Milliseconds between two requests to a host at ``rate`` requests per second."""
    if rate <= 0:
        raise ValueError(f"the request rate must be above zero, not {rate}")
    return 1000.0 / rate


def body_cap(max_body_bytes: int) -> int:
    if max_body_bytes <= 0:
        raise ValueError(f"the body cap must be above zero, not {max_body_bytes}")
    return max_body_bytes
