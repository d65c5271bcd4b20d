import __spark_entry__ as spec
from tests.check_oracles import connect, difference

SMALL = "/root/testdata/sf0.001"
QUICK = ["canonical_links", "link_kinds", "admit_bodies", "robots_allowed_probe", "pace_schedule", "page_findings", "stream_dedupe"]


def test_every_query_of_the_library_has_sql():
    assert set(spec.QUERIES) == set(spec.ORACLES)
    # of the training-data queries, those that SQL cannot express are tested against brute force
    assert set(spec.oracle_sql()) <= set(spec.queries())


def test_the_flagship_runs(spark):
    assert spec.entry(spark).count() > 0


def test_queries_equal_their_sql(spark):
    db = connect(SMALL)
    for name in QUICK:
        assert difference(spark, db, name, SMALL) is None, name
