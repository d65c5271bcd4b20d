import base64
import gzip
import hashlib

from webledger.llm import warc
from webledger.llm.common import open_folder

PAGES = "page_id long, url string, html string, digest string, payload string, row string, first string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "c", "c", "c", "c") for r in rows], PAGES)


def assembled(spark, rows, **kw):
    return warc.assemble(warc.read_records(warc.write_archives(pages(spark, rows), **kw), payloads=True))


ROWS = [(3, "http://a/x", "same"), (1, "http://a/y", "same"), (2, None, None), (5, "http://a\r\nX: y", ""), (4, "http://é/", "é" * 40_000),
        (9, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n"), (1, "http://a/y", "same"), (None, "n", "same"), (None, "m", "only")]


def test_round_trip(spark):
    captures = assembled(spark, ROWS)
    rows = captures.collect()
    assert len(rows) == len(ROWS) and all(r.response and r.request and r.metadata for r in rows)
    plain = warc.with_referred(captures).collect()
    assert sorted((r.page_id or 0, r.payload_bytes) for r in plain) == sorted((p or 0, len((h or "").encode())) for p, _, h in ROWS)
    for r in plain:
        bodies = {(h or "").encode() for p, _, h in ROWS if p == r.page_id}
        assert r.payload_digest in {base64.b32encode(hashlib.sha1(b).digest()).decode() for b in bodies}
    kinds = sorted((r.page_id or 0, r.record_type, r.refers_to) for r in plain if r.payload_bytes == 4 and r.payload_digest == warc.base32_sha1(b"same"))
    assert [k[1] for k in kinds].count("response") == 1
    assert all(k[2] == 1 for k in kinds if k[1] == "revisit") and (0, "revisit", 1) in kinds
    assert {r.page_id: r.refers_to for r in plain if r.payload_bytes == 0} == {2: None, 5: 2}
    assert [bytes(r.response.payload) for r in rows if r.page_id == 9] == [ROWS[5][2].encode()]


def test_least_size_and_rotation(spark):
    captures = assembled(spark, ROWS, min_bytes=5, file_bytes=1)
    assert {r.record_type for r in warc.with_referred(captures).collect()} == {"response"}
    manifest = warc.write_archives(pages(spark, ROWS), file_bytes=1)
    files = manifest.collect()
    assert len(files) == len(ROWS) and sum(f.n_captures for f in files) == len(ROWS)
    system, inside = open_folder(files[0].path)
    with system.open_input_stream(inside, compression=None) as raw, gzip.GzipFile(fileobj=raw) as plain:
        kinds = [h["warc-type"] for h, _ in warc.parse(plain)]
    assert sorted(kinds)[-2:] in (["request", "response"], ["request", "revisit"])


def test_empty_and_orphans(spark):
    assert assembled(spark, []).count() == 0
    records = warc.read_records(warc.write_archives(pages(spark, ROWS[:1])))
    lone = warc.assemble(records.where("kind = 'request'")).collect()
    assert len(lone) == 1 and lone[0].response is None and lone[0].request is not None


def test_pages_from_a_shuffle_or_in_random_order(spark):
    from pyspark.sql import functions as F

    base = spark.range(400).select(
        F.col("id").alias("page_id"), F.concat(F.lit("https://e.com/"), "id").alias("url"), F.concat(F.lit("<p>"), F.col("id") % 40).alias("html")
    )
    for pages in (base.repartition(7), base.orderBy(F.rand()), base.repartition(5).join(base.select("page_id").repartition(3), "page_id")):
        rows = warc.with_referred(warc.assemble(warc.read_records(warc.write_archives(pages)))).collect()
        assert len(rows) == 400
        for r in rows:
            assert (r.record_type, r.refers_to) == (("response", None) if r.page_id < 40 else ("revisit", r.page_id % 40))
