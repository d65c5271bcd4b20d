from webledger.operators.pacing import pace_schedule
from webledger.streaming import jobs


def test_slots_go_on_across_batches_and_compaction(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "_COMPACT_EVERY", 2)
    schema = "request_id bigint, host string, arrival_ms bigint"
    rows = [(i, "a" if i % 3 else "b", i * 40) for i in range(60)]
    for batch in range(6):
        part = spark.createDataFrame(rows[batch * 10 : batch * 10 + 10], schema)
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    jobs.stream_pace(stream, 5.0, out, ckpt, hot_rows=4).awaitTermination()
    granted = spark.read.schema("request_id bigint, slot_ms bigint").parquet(out)
    whole = pace_schedule(spark.createDataFrame(rows, schema), 5.0)
    assert {(r.request_id, r.slot_ms) for r in granted.collect()} == {(r.request_id, r.slot_ms) for r in whole.collect()}


def test_findings_are_appended_as_pages_arrive(spark, tmp_path):
    schema = "site_id string, url string, final_url string, status int, elapsed_ms double, text string, fetch_error string"
    rows = [("s", "https://e.com/1", None, 200, 1.0, "<title>x</title>", None), ("s", "https://e.com/2", None, None, None, None, "t")]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        jobs.stream_audit(stream, str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()
    (line,) = spark.read.json(str(tmp_path / "out")).collect()
    assert line.url == "https://e.com/1" and len(line.checks) == 3 and "text" not in line.asDict()


def test_the_state_of_recent_urls_stays_bounded(spark, tmp_path):
    from datetime import datetime, timedelta

    start, files = datetime(2024, 1, 1), 8
    schema, seen = "url string, at timestamp", []
    for day in range(files):
        rows = [(f"https://e.com/{day}/{i % 20}#{i}", start + timedelta(days=day, hours=i % 24)) for i in range(40)]
        if day == 1:
            rows.append(("https://e.com/late", start))
        if day == 6:
            rows.append(("https://e.com/too-late", start))
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/day={day}"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / f"in/day=[0-{day}]"))
        once = jobs.stream_dedupe_recent(stream, delay="2 days")
        query = once.writeStream.format("json").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ckpt"))
        query = query.trigger(availableNow=True).start()
        query.awaitTermination()
        seen.append(max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]))
    urls = sorted(r.url_norm for r in spark.read.json(str(tmp_path / "out")).collect())
    assert len(urls) == len(set(urls)) == 20 * files + 1
    assert "https://e.com/late" in urls and "https://e.com/too-late" not in urls
    # the URLs of some four days, not of all
    assert max(seen) <= 20 * 4 + 1 and seen[-1] <= seen[3] + 1
