import random
from datetime import datetime, timedelta

import pytest

from webledger.operators import attempts as att
from webledger.operators import pacing
from webledger.params import ATTEMPTS, RetryPolicy

START = datetime(2024, 1, 1)


def log(spark, *outcomes, pauses=None):
    rows, at = [], START
    for number, outcome in enumerate(outcomes):
        failed = outcome is None
        rows.append((1, number, None if failed else outcome, "refused" if failed else None, at, 100.0))
        at += timedelta(milliseconds=100 + (pauses or {}).get(number, 0))
    return spark.createDataFrame(rows, ATTEMPTS)


@pytest.mark.parametrize(
    ("outcomes", "status", "error", "used"),
    [
        ([None, None, 200], 200, None, 3), ([None] * 9, None, "refused", 3), ([503] * 9, 503, None, 3), ([404], 404, None, 1),
        ([503, None, 503], 503, None, 3), ([503, 503, None], None, "refused", 3), ([501, 200], 501, None, 1),
        ([429, 200], 200, None, 2), ([505], 505, None, 1), ([408, 500, 502, 200], 502, None, 3),
    ],
)
def test_outcome(spark, outcomes, status, error, used):
    (row,) = att.resolve_attempts(log(spark, *outcomes)).collect()
    assert (row.status, row.fetch_error, row.attempts_used) == (status, error, used)


def test_usage(spark):
    (row,) = att.attempt_usage(log(spark, 503, 200, 200, 200, 200)).collect()
    assert (row.attempts, row.attempts_used, row.wasted) == (5, 2, 3)
    (row,) = att.attempt_usage(log(spark, 404)).collect()
    assert (row.attempts, row.attempts_used, row.wasted) == (1, 1, 0)


def test_only_pauses_over_the_window_are_found(spark):
    policy = RetryPolicy(attempts=4, base_delay=0.5, max_delay=0.8)
    found = att.backoff_audit(log(spark, 503, 503, 503, 503, 503, pauses={0: 500, 1: 801, 2: 0, 3: 9999}), policy)
    assert [(r.attempt, r.pause_ms, r.window_ms) for r in found.collect()] == [(1, 801.0, 800.0)]


def test_parameters_are_checked():
    for rate in (0, -1.0):
        with pytest.raises(ValueError):
            pacing.pace_schedule(None, rate)
    with pytest.raises(ValueError):
        RetryPolicy(attempts=0)


def requests(spark, rows):
    return spark.createDataFrame(rows, "request_id bigint, host string, arrival_ms bigint")


@pytest.mark.parametrize("hot_rows", [1_000_000, 5])
def test_schedule_follows_the_sequential_rule(spark, hot_rows):
    rng = random.Random(3)
    rows = [(i, rng.choice(["hot", "hot", "hot", "a", "b"]), rng.choice([0, rng.randrange(20_000)])) for i in range(300)]
    free, wanted = {}, {}
    for number, host, arrival in sorted(rows, key=lambda r: (r[2], r[0])):
        slot = max(arrival, free.get(host, arrival))
        free[host] = slot + 200
        wanted[number] = slot
    done = pacing.pace_schedule(requests(spark, rows), 5.0, hot_rows=hot_rows)
    assert {r.request_id: r.slot_ms for r in done.collect()} == wanted
    assert {r.host: r.next_free_ms for r in pacing.next_free(done, 5.0).collect()} == free
    assert all(r.wait_ms == r.slot_ms - r.arrival_ms for r in done.collect())


def test_booked_hosts_wait(spark):
    booked = spark.createDataFrame([("a", 1000.0)], "host string, next_free_ms double")
    done = pacing.pace_schedule(requests(spark, [(1, "a", 0), (2, "a", 5000), (3, "b", 0)]), 5.0, booked)
    assert {r.request_id: r.slot_ms for r in done.collect()} == {1: 1000, 2: 5000, 3: 0}


@pytest.mark.parametrize("hot_rows", [1_000_000, 5])
def test_violations(spark, hot_rows):
    rng = random.Random(5)
    rows = [(i, rng.choice(["hot", "hot", "a"]), rng.randrange(40_000)) for i in range(200)]
    wanted, last = set(), {}
    for number, host, at in sorted(rows, key=lambda r: (r[2], r[0])):
        if host in last and at - last[host] < 200:
            wanted.add((number, at - last[host]))
        last[host] = at
    logged = requests(spark, rows).withColumnRenamed("arrival_ms", "at_ms")
    found = pacing.pace_violations(logged, 5.0, hot_rows)
    assert {(r.request_id, r.gap_ms) for r in found.collect()} == wanted
