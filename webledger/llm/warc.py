"""WARC: archives of gzip members written by tasks, read back, and assembled into captures.

A page becomes three records: request, response (or revisit) and metadata; request and metadata name
the response in ``WARC-Concurrent-To``. Of pages with equal payloads the one with the smallest
page_id is the response; the others are revisit records that refer to it and keep only its HTTP
head, whose ``Content-Length`` and the payload digest still describe the full payload. Reading
back, the three kinds are brought together by their concurrent-to identifier in one grouping,
one nested row per capture.

The numbered pages are written first: a shuffled or randomly ordered input would be numbered otherwise the next time
it is read. Only digests that occur twice are joined back to the pages; that table is written first, so Spark
knows its size and picks the join (a hot digest is split by the adaptive skew join).

Defined cases: a null html is an empty payload, and empty payloads are equal ones; null page_ids come
last when the response is picked, and a capture whose page_id is null reads null again; of repeated
page_ids with one payload, one row is the response and the others revisit it; a null url leaves
out the target header; line breaks in a url are percent-encoded; very long pages are records like others; only page_id, url and
html are read, so other columns cannot clash; an empty table writes nothing.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webledger.llm.common import in_pieces, new_folder, open_folder
from webledger.scale import store

MIN_BYTES = 0
FILE_BYTES = 256 * 1024 * 1024
DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, record_id: str, headers: dict[str, str | None], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {DATE}"]
    lines += [f"{k}: {v}" for k, v in headers.items() if v is not None]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def urn(run: str, row: int, kind: str) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.md5(f'{run}/{row}/{kind}'.encode()).hexdigest())}>"


def capture(run: str, row: int, page_id: int | None, url: str | None, payload: bytes, first: int | None) -> Iterator[bytes]:
    """The records of one page; ``first``: row of the response that it revisits, or None."""
    target = None if url is None else url.replace("\r", "%0D").replace("\n", "%0A")
    own = urn(run, row, "response")
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    digest = f"sha1:{base32_sha1(payload)}"
    about = {"WARC-Target-URI": target, "Content-Type": "application/http;msgtype=response", "WARC-Payload-Digest": digest}
    if first is None:
        yield record("response", own, about, head + payload)
    else:
        more = {"WARC-Profile": _PROFILE, "WARC-Refers-To": urn(run, first, "response"), "WARC-Truncated": "length"}
        yield record("revisit", own, about | more, head)
    ask = {"WARC-Target-URI": target, "WARC-Concurrent-To": own, "Content-Type": "application/http;msgtype=request"}
    yield record("request", urn(run, row, "request"), ask, f"GET {target or '/'} HTTP/1.1\r\n\r\n".encode())
    tell = {"WARC-Target-URI": target, "WARC-Concurrent-To": own, "Content-Type": "application/warc-fields"}
    fields = b"" if page_id is None else f"pageId: {page_id}\r\n".encode()
    yield record("metadata", urn(run, row, "metadata"), tell, fields)


_MANIFEST = "path string, n_captures bigint"


def write_archives(pages: DataFrame, min_bytes: int = MIN_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives; the stored manifest, a row per file."""
    spark = pages.sparkSession
    folder, run = new_folder(spark, "warc"), uuid.uuid4().hex
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    # numbers of rows hold for one run of a plan only, so numbered rows are written before they are used twice
    rows = store(rows.withColumn("row", F.monotonically_increasing_id()).withColumn("digest", F.unhex(F.sha1("payload"))), "pages")
    whole = F.length("payload") >= min_bytes
    pick = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "row")
    twice = rows.where(whole).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(pick).alias("first"))
    twice = store(twice.where("n > 1").select("digest", F.col("first.row").alias("first")), "digests")
    joined = rows.join(twice, "digest", "left").select(
        "row", "page_id", "url", "payload",
        F.when(whole & (F.col("first") != F.col("row")), F.col("first")).alias("first"),
    )

    def write(batches):
        sink, path, done, names = None, None, 0, []
        for batch in in_pieces(batches):
            for r in batch.to_pylist():
                if sink is None:
                    path, done = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0
                    system, inside = open_folder(path)
                    system.create_dir(inside.rpartition("/")[0], recursive=True)
                    sink = system.open_output_stream(inside, compression=None)
                for member in capture(run, r["row"], r["page_id"], r["url"], r["payload"], r["first"]):
                    sink.write(gzip.compress(member, 4, mtime=0))
                done += 1
                if sink.tell() >= file_bytes:
                    sink.close()
                    names.append((path, done))
                    sink = None
        if sink is not None:
            sink.close()
            names.append((path, done))
        yield pa.RecordBatch.from_pydict({
            "path": pa.array([n[0] for n in names], pa.string()), "n_captures": pa.array([n[1] for n in names], pa.int64())
        })

    return store(joined.mapInArrow(write, _MANIFEST), "manifest")


def parse(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of every record of an uncompressed stream."""
    while line := source.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        headers: dict[str, str] = {}
        while (line := source.readline().rstrip(b"\r\n")):
            name, _, value = line.decode().partition(":")
            headers[name.strip().lower()] = value.strip()
        block = source.read(int(headers["content-length"]))
        source.readline()
        source.readline()
        yield headers, block


_RECORD = (
    "kind string, record_id string, capture string, url string, page_id bigint, payload_bytes bigint, "
    "payload_digest string, refers_to string, block_bytes bigint, payload binary"
)


def read_records(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """Every record of the archives; payloads of responses only if asked for."""

    def entry(headers: dict[str, str], block: bytes) -> dict:
        kind = headers["warc-type"]
        out = {"kind": kind, "record_id": headers["warc-record-id"], "url": headers.get("warc-target-uri"), "block_bytes": len(block)}
        out["capture"] = headers.get("warc-concurrent-to", out["record_id"])
        if kind == "response":
            body = block.partition(b"\r\n\r\n")[2]
            out |= {"payload_bytes": len(body), "payload_digest": base32_sha1(body), "payload": body if payloads else None}
        elif kind == "revisit":
            head = block.decode("latin-1").lower().partition("content-length:")[2]
            out |= {"payload_bytes": int(head.split("\r\n")[0]), "refers_to": headers["warc-refers-to"]}
            out["payload_digest"] = headers["warc-payload-digest"].removeprefix("sha1:")
        elif kind == "metadata":
            fields = dict(line.split(": ", 1) for line in block.decode().split("\r\n") if line)
            out["page_id"] = int(fields["pageId"]) if "pageId" in fields else None
        return out

    names = [part.split()[0] for part in _RECORD.split(", ")]

    def run(batches):
        schema = None
        for batch in batches:
            for path in batch.column("path").to_pylist():
                system, inside = open_folder(path)
                with system.open_input_stream(inside, compression=None) as raw, gzip.GzipFile(fileobj=raw) as plain:
                    rows, held = [], 0
                    for headers, block in parse(io.BufferedReader(plain, 1 << 20)):
                        rows.append(entry(headers, block))
                        held += len(block)
                        if len(rows) >= 2000 or held > 16_000_000:
                            yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in names} for r in rows], schema=_ARROW)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in names} for r in rows], schema=_ARROW)

    # a number given here is kept: few rows stand for many bytes, and must not be put together
    files = manifest.select("path").repartition(max(1, manifest.count()), "path")
    return files.mapInArrow(run, _RECORD)


_KINDS = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
_ARROW = pa.schema([(part.split()[0], _KINDS[part.split()[1]]) for part in _RECORD.split(", ")])


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: (capture, page_id, response, request, metadata).

    ``response`` is the response or revisit record. A record whose partners are missing gives a row
    with nulls in their places.
    """
    answer = F.struct("record_id", "kind", "url", "payload_bytes", "payload_digest", "refers_to", "payload")
    small = F.struct("record_id", "url", "block_bytes")
    grouped = records.groupBy("capture").agg(
        F.max(F.when(F.col("kind").isin("response", "revisit"), answer)).alias("response"),
        F.max(F.when(F.col("kind") == "request", small)).alias("request"),
        F.max(F.when(F.col("kind") == "metadata", F.struct("record_id", "url", "block_bytes", "page_id"))).alias("metadata"),
    )
    return grouped.select("capture", F.col("metadata.page_id").alias("page_id"), "response", "request", "metadata")


def with_referred(captures: DataFrame) -> DataFrame:
    """page_id, payload figures, record type and the page that a revisit refers to."""
    columns = ["page_id", "response.payload_bytes", "response.payload_digest", F.col("response.kind").alias("record_type")]
    first = captures.where("response.kind = 'response'")
    again = captures.where("response.kind = 'revisit'").select(*columns, F.col("response.refers_to").alias("record_id"))
    known = first.select(F.col("response.record_id").alias("record_id"), F.col("page_id").alias("refers_to"))
    # Spark sees the size of the manifest, not of what is read from it, and would broadcast
    referred = again.join(known.hint("merge"), "record_id", "left").drop("record_id")
    return first.select(*columns, F.lit(None).cast("bigint").alias("refers_to")).unionByName(referred)
