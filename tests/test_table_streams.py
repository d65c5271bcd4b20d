import pytest

from checkset.queries import QUERIES

PAGES = [(i, f"http://h{i % 3}.example/en/{i % 5}", "x" * i) for i in range(12)]


@pytest.mark.parametrize("files", [1, 3])
def test_streams_of_a_table_kept_as_a_folder_of_files(spark, tmp_path, files):
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string")
    pages.repartition(files).write.parquet(str(tmp_path / "pages.parquet"))
    # each page has one of fifteen canonical URLs, and the home page of one of three hosts
    urls = [r.url_norm for r in QUERIES["stream_dedupe"](spark, str(tmp_path)).collect()]
    assert sorted(urls) == sorted({u for _, u, _ in PAGES} | {u.rpartition("/")[0] + "/" for _, u, _ in PAGES})
    counts = {r.status_class: r.n for r in QUERIES["stream_counts"](spark, str(tmp_path)).collect()}
    assert sum(counts.values()) == len(PAGES)
    assert len(QUERIES["stream_audit"](spark, str(tmp_path)).collect()) == len(PAGES)


def test_a_stream_of_a_table_kept_as_one_file(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string")
    pages.coalesce(1).write.parquet(str(tmp_path / "parts"))
    (written,) = (tmp_path / "parts").glob("part-*.parquet")
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "pages.parquet").write_bytes(written.read_bytes())
    assert len(QUERIES["stream_audit"](spark, str(tmp_path / "t")).collect()) == len(PAGES)
    assert sum(r.n for r in QUERIES["stream_counts"](spark, str(tmp_path / "t")).collect()) == len(PAGES)
