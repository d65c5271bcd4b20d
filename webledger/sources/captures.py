"""Reading captures and turning raw ones into responses; writing audit results."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webledger import params
from webledger.functions.urls import canonicalize
from webledger.operators.joins import pick

# Media types whose bodies are read.
TEXT_TYPES = ("text/html", "text/plain")

# Names of the charsets that Spark expressions decode.
_LATIN1 = ("iso-8859-1", "latin-1", "latin1", "iso8859-1", "l1")
_ASCII = ("us-ascii", "ascii")
_CP1252_NAMES = ("windows-1252", "cp1252")
_UTF8 = ("", "utf-8", "utf8")
# Content codings that are taken off a body.
CODINGS = ("gzip", "deflate")
CP1252 = params.CP1252


def read_responses(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Captured responses (``parquet`` or ``json``); an absent content type becomes ``""``."""
    if fmt not in ("parquet", "json"):
        raise ValueError(f"responses are parquet or json, not {fmt}")
    raw = spark.read.schema(params.RESPONSES).format(fmt).load(path)
    return raw.withColumn("content_type", F.coalesce("content_type", F.lit("")))


def read_robots(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Robots captures, one row per host name: a successful one before a failed one, then by status."""
    raw = spark.read.schema(params.ROBOTS_CAPTURES).format(fmt).load(path)
    named = raw.withColumn("host", F.lower(F.regexp_replace("host", r":\d+$", "")))
    return pick(named, ["host"], ["fetch_error", "status"])


def robots_urls(hosts: DataFrame) -> DataFrame:
    """Where the robots file of each host is asked for."""
    return hosts.withColumn("robots_url", F.concat(F.lit("https://"), F.col("host"), F.lit("/robots.txt")))


def apply_deadline(responses: DataFrame, timeout_s: float = params.DEFAULT_TIMEOUT_S) -> DataFrame:
    """An exchange longer than the deadline is a failed fetch, not a slow response."""
    late = F.coalesce(F.col("elapsed_ms") > timeout_s * 1000.0, F.lit(False))
    changed = {
        "fetch_error": F.when(F.col("fetch_error").isNull() & late, "timeout").otherwise(F.col("fetch_error"))
    }
    for column in ("status", "text", "body"):
        if column in responses.columns:
            changed[column] = F.when(~late, F.col(column))
    return responses.withColumns(changed)


def _header(name: str):
    lowered = F.transform_keys("headers", lambda k, v: F.lower(k))
    return F.coalesce(F.get(F.map_values(F.map_filter(lowered, lambda k, v: k == name)), F.lit(0)), F.lit(""))


def body_state(content_type, declared, size, cap: int):
    """What becomes of a body: ``text``, ``not_text``, ``declared_too_long`` or ``too_long``."""
    kind = F.lower(content_type)
    is_text = F.coalesce(F.startswith(kind, F.lit(TEXT_TYPES[0])) | F.startswith(kind, F.lit(TEXT_TYPES[1])), F.lit(False))
    # more digits than a bigint holds is over any cap
    too_long = declared.rlike("^[0-9]+$") & F.coalesce(declared.try_cast("bigint") > cap, F.lit(True))
    return (
        F.when(~is_text, "not_text")
        .when(too_long, "declared_too_long")
        .when(size > cap, "too_long")
        .otherwise("text")
    )


# Bytes that a decoder gives at a time.
_PIECE = 64 * 1024


class _Deflated:
    """The decoder of one content coding, a piece at a time. ``deflate`` may come with its header or without."""

    def __init__(self, coding: str):
        self.wrapped = coding == "deflate"
        self.inner = zlib.decompressobj(zlib.MAX_WBITS | 16 if coding == "gzip" else zlib.MAX_WBITS)

    def pieces(self, chunks: Iterator[bytes]) -> Iterator[bytes]:
        for chunk in chunks:
            while not self.inner.eof:
                try:
                    piece = self.inner.decompress(chunk, _PIECE)
                except zlib.error:
                    if not self.wrapped:
                        raise
                    self.inner, self.wrapped = zlib.decompressobj(-zlib.MAX_WBITS), False
                    continue
                self.wrapped = False
                yield piece
                chunk = self.inner.unconsumed_tail
                if not chunk and len(piece) < _PIECE:
                    break


def inflated(body: bytes, codings: list[str], cap: int) -> bytes | None:
    """A body without its content codings; None as soon as it is over the cap. Raises ``zlib.error``.

    A body that ends too early gives what it holds; what follows the end of the data is left out.
    """
    chunks: Iterator[bytes] = (body[i : i + _PIECE] for i in range(0, len(body), _PIECE))
    for coding in reversed(codings):
        chunks = _Deflated(coding).pieces(chunks)
    out, size = [], 0
    for piece in chunks:
        size += len(piece)
        if size > cap:
            return None
        out.append(piece)
    return b"".join(out)


def _decoded(body: bytes, charset: str) -> str:
    try:
        return body.decode(charset or "utf-8", "replace")
    except (LookupError, ValueError):
        return body.decode("utf-8", "replace")


def _read_in_python(cap: int, names: list[str]):
    """Rows whose body is encoded or in a charset that Spark does not know, with their text."""

    def read(body: bytes, codings: list[str], charset: str) -> tuple[str | None, str | None, str | None]:
        try:
            plain = inflated(body, codings, cap)
        except zlib.error:
            return None, None, "undecodable body"
        return (None, "too_long", None) if plain is None else (_decoded(plain, charset), "text", None)

    def run(batches):
        for batch in batches:
            asked = zip(*(batch.column(c).to_pylist() for c in ("_read", "_codings", "_charset")), strict=True)
            found = [read(*row) for row in asked]
            text, state, fault = ([f[i] for f in found] for i in range(3))
            columns = {c: batch.column(c) for c in names}
            columns["status"] = pc.if_else(pa.array([f is None for f in fault], pa.bool_()), batch.column("status"), pa.nulls(batch.num_rows, batch.column("status").type))
            columns |= {"fetch_error": pa.array(fault, pa.string()), "body_state": pa.array(state, pa.string()), "text": pa.array(text, pa.string())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def _charset(content_type):
    return F.lower(F.regexp_extract(content_type, r"(?i)charset\s*=\s*[\"']?([^\s;\"']+)", 1))


_COMMON = (*_UTF8, *_LATIN1, *_ASCII, *_CP1252_NAMES)


def _codings():
    """The content codings of a capture that were applied and are known here, in the order of their application."""
    named = F.transform(F.split(F.lower(_header("content-encoding")), ","), lambda c: F.trim(c))
    return F.filter(named, lambda c: c.isin(*CODINGS))


def _decoded_body(body, charset):
    """Body text in its declared charset, else UTF-8; bytes that are not text are replaced. Common charsets only."""
    latin = F.decode(body, "ISO-8859-1")
    high = "".join(map(chr, range(0x80, 0xA0)))
    return (
        F.when(charset.isin(*_UTF8), F.make_valid_utf8(body.cast("string")))
        .when(charset.isin(*_LATIN1), latin)
        .when(charset.isin(*_ASCII), F.regexp_replace(latin, "[\u0080-\u00ff]", "\ufffd"))
        .when(charset.isin(*_CP1252_NAMES), F.translate(latin, high, CP1252))
    )


def ingest_captures(
    raw: DataFrame,
    max_body_bytes: int = params.DEFAULT_MAX_BODY_BYTES,
    timeout_s: float = params.DEFAULT_TIMEOUT_S,
) -> DataFrame:
    """Raw captures to responses, in narrow plans without a shuffle.

    The headers decide whether a body is read at all; one over the cap is dropped whole, never
    cut. A final URL without a canonical form is a failed fetch.

    Two branches over the captures: all but a few rows stay in expressions; those whose body has a content coding, or
    a charset that Spark does not know, are read by Python, where a body is inflated piece by piece and given up as soon
    as it is over the cap. A body that its coding cannot have made is a failed fetch.
    """
    cap = params.body_cap(max_body_bytes)
    site = [F.col("site_id")] if "site_id" in raw.columns else [F.lit("").alias("site_id")]
    timed = apply_deadline(raw, timeout_s).withColumns(
        {"content_type": _header("content-type"), "_declared": _header("content-length"), "_codings": _codings()}
    )
    failed = F.col("fetch_error").isNotNull()
    encoded = F.size("_codings") > 0
    # the size of an encoded body is known when it has been inflated
    size = F.when(encoded, 0).otherwise(F.octet_length("body"))
    state = body_state(F.col("content_type"), F.col("_declared"), size, cap)
    judged = timed.withColumn("body_state", F.when(~failed & F.col("body").isNotNull(), state))
    # a body that is not read is not decoded either
    judged = judged.withColumn("_read", F.when(F.col("body_state") == "text", F.col("body")))
    judged = judged.withColumn("_charset", _charset(F.col("content_type")))
    final = F.coalesce("final_url", "url").alias("final_url")
    kept = ["site_id", "url", "final_url", "status", "elapsed_ms", "content_type", "fetch_error", "body_state"]
    slow = F.coalesce((F.col("body_state") == "text") & (encoded | ~F.col("_charset").isin(*_COMMON)), F.lit(False))
    judged = judged.select(
        *site, "url", final, F.col("status").cast("int").alias("status"), F.col("elapsed_ms").cast("double").alias("elapsed_ms"),
        "content_type", "fetch_error", "body_state", "_read", "_charset", "_codings", slow.alias("_slow"),
    )
    plain = judged.where(~F.col("_slow")).select(*kept, _decoded_body(F.col("_read"), F.col("_charset")).alias("text"))
    names = kept[:6]
    schema = "site_id string, url string, final_url string, status int, elapsed_ms double, content_type string, fetch_error string, body_state string, text string"
    read = judged.where("_slow").select(*names, "_read", "_codings", "_charset").mapInArrow(_read_in_python(cap, names), schema)
    texts = plain.unionByName(read)
    known = canonicalize(canonicalize(texts, "url", "_url"), "final_url", "_final")
    lost = F.col("_final").isNull() & F.col("fetch_error").isNull()
    return known.select(
        "site_id",
        F.coalesce("_url", "url").alias("url"),
        F.coalesce("_final", "final_url").alias("final_url"),
        F.when(~lost, F.col("status")).alias("status"),
        "elapsed_ms",
        "content_type",
        F.when(~lost, F.col("text")).alias("text"),
        F.when(lost, "malformed final url").otherwise(F.col("fetch_error")).alias("fetch_error"),
        "body_state",
    )


def jsonl_records(visits: DataFrame, findings: DataFrame) -> DataFrame:
    """One record per fetched page with its findings; never the body.

    The findings of one page number at most a few per link of its body, which the body cap bounds.
    """
    ordered = F.array_sort(F.collect_list(F.struct("check", "severity", "message", "subject")))
    per_page = findings.groupBy("site_id", F.col("page_url").alias("url")).agg(ordered.alias("checks"))
    fetched = visits.where(F.col("outcome") == "fetched").select(
        "site_id", "url", "status", "final_url", "elapsed_ms", "depth"
    )
    empty = F.array().cast(f"array<{params.FINDING}>")
    return fetched.join(per_page, ["site_id", "url"], "left").select(
        "site_id", "url", "status", "final_url", "elapsed_ms", "depth",
        F.coalesce("checks", empty).alias("checks"),
    )


def write_report_jsonl(visits: DataFrame, findings: DataFrame, path: str) -> None:
    """Page records as JSON lines, one file per task."""
    jsonl_records(visits, findings).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_summary(report: DataFrame, path: str, fmt: str = "parquet") -> None:
    """The report rows; an existing report is never changed in place."""
    if fmt not in ("parquet", "json"):
        raise ValueError(f"a report is written as parquet or json, not {fmt}")
    report.write.mode("errorifexists").format(fmt).save(path)
