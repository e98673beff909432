"""Streams with watermarks: what is closed equals the batch, and nothing else is given."""

from pyspark.sql import functions as F

from tidemark.sources.tables import load
from tidemark.streaming import events as streams

SF = "/root/testdata/sf0.001"


def stream(spark):
    load(spark, SF, "events").limit(0)
    return streams.read(spark, SF, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def test_closed_windows_equal_the_batch(spark):
    batch = load(spark, SF, "events")
    end = batch.agg(F.max("ts")).head()[0]
    got = {(r["start"], r["event_type"]): r["n"] for r in streams.run_once(streams.tumbling(stream(spark), "ts", "1 hour", ["event_type"], "2 hours"), "append").collect()}
    want = {(r["start"], r["event_type"]): r["n"] for r in streams.tumbling(batch, "ts", "1 hour", ["event_type"]).collect()}
    assert got and got.items() <= want.items()
    closed = {k for k in want if (end - k[0]).total_seconds() >= 3 * 3600 + 1}
    assert closed <= got.keys() and len(got) < len(want)


def test_sessions_and_sliding_windows_close(spark):
    batch = load(spark, SF, "events")
    for make in (lambda e, late: streams.sessions(e, "ts", "2 hours", ["user_id"], late), lambda e, late: streams.sliding(e, "ts", "2 hours", "1 hour", ["event_type"], late)):
        got = {tuple(r) for r in streams.run_once(make(stream(spark), "1 hour"), "append").collect()}
        want = {tuple(r) for r in make(batch, None).collect()}
        assert got <= want and len(got) >= 0.9 * len(want)


def test_one_row_for_each_key_within_the_watermark(spark):
    rows = streams.run_once(streams.first_of(stream(spark).select("ts", "user_id", "event_type"), ["user_id", "event_type"], "ts", "60 days"), "append").collect()
    keys = [(r["user_id"], r["event_type"]) for r in rows]
    want = {(r["user_id"], r["event_type"]) for r in load(spark, SF, "events").select("user_id", "event_type").distinct().collect()}
    assert len(keys) == len(set(keys)) and set(keys) == want
    assert streams.first_of(load(spark, SF, "events"), ["user_id"], "ts").count() == len({u for u, _ in want})
