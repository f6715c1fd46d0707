"""Breakers go by rounded milliseconds, over batches that part within one, and up to the end of the stream."""

import datetime as dt

from txcompact.streaming import streaks
from txcompact.streaming.run import available, in_batches


def test_breakers_round_times_and_lose_no_call(spark):
    at = lambda s, us: dt.datetime(2024, 1, 1, 0, 0, 0) + dt.timedelta(seconds=s, microseconds=us)
    rows = [(1, at(1, 100), 1, False), (1, at(2, 999_550), 2, False), (1, at(2, 999_600), 3, False), (2, at(2, 999_700), 4, True), (2, at(62, 999_500), 5, True)]
    calls = spark.createDataFrame(rows, "backend long, ts timestamp, event_id long, ok boolean")
    cut = (at(2, 999_580) - dt.datetime(1970, 1, 1)).total_seconds()
    name, provider = streaks.ROCKSDB
    was = spark.conf.get(name)
    spark.conf.set(name, provider)
    try:
        found = available(streaks.breaker_changes(in_batches(calls, "ts", cuts=[cut]), cool_seconds=60))
    finally:
        spark.conf.set(name, was)
    got = sorted((r.backend, r.s, r.status, r.failures) for r in found.selectExpr("*", "CAST(ts AS STRING) AS s").collect())
    assert got == [(1, "2024-01-01 00:00:03", "open", 3), (1, "2024-01-01 00:01:03", "half_open", 3)]
