"""The same functions over streams."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from millrace.operators import correlate
from millrace.streaming import grouping


def at(s):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)


@pytest.fixture()
def stream(spark, tmp_path):
    d = spark.createDataFrame([("a", i, at(i)) for i in range(6)] + [("a", 6, at(100)), ("b", 7, at(100000))], "k string, i long, t timestamp").coalesce(1)
    d.write.parquet(str(tmp_path / "in"))
    return d, spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))


def test_sessions_equal_batch(spark, stream):
    batch, s = stream
    agg = {"n": F.count(F.lit(1))}
    got = grouping.run_available(grouping.sessions(s, ["k"], 10, agg, ts="t", delay="1 second"), "sessions_out").collect()
    want = correlate.session_groups(batch, ["k"], 10, agg, ts="t").where("k = 'a'").collect()  # b's session is still open
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_triggered(spark, stream):
    """State with timeouts keeps a query running, so the result is awaited and the query stopped."""
    _, s = stream
    made = grouping.triggered(s, ["k"], ["i"], 3600, lambda rows: (len(rows), rows[-1][0]), "k string, n long, last long", lambda rows: len(rows) == 3)
    q = made.writeStream.outputMode("append").format("memory").queryName("triggered_out").start()
    try:
        until = time.time() + 60
        while time.time() < until and spark.table("triggered_out").count() < 2:
            time.sleep(0.5)
    finally:
        q.stop()
    assert sorted((r.n, r.last) for r in spark.table("triggered_out").collect()) == [(3, 2), (3, 5)]


def test_rate_limit_equals_batch(spark, stream):
    batch, s = stream
    got = grouping.run_available(grouping.rate_limited(s, ["k"], 1, "t"), "rate_out").collect()
    want = correlate.rate_limit(batch, ["k"], 1, ts="t").collect()
    assert sorted(r.i for r in got) == sorted(r.i for r in want)


def test_counters(spark, stream):
    _, s = stream
    got = grouping.run_available(grouping.counters(s, ["k"], "t", delay="1 second"), "counters_out").collect()
    assert {(r.k, r.value) for r in got} == {("a", 6), ("a", 1)}
