"""Streaming operators against their batch forms."""

from pyspark.sql import functions as F

from gossamer import bindings
from gossamer.operators import scoring
from gossamer.streaming import live
from tests.conftest import SMALL


def test_token_buckets_equal_the_batch_fold(spark):
    stream = live.token_buckets(live.event_stream(spark, f"{SMALL}/events.parquet"), "node", 0.00001, 2.0)
    got = live.run_available(stream).groupBy("node").agg(F.count_if("allowed").alias("a"), F.count_if(~F.col("allowed")).alias("d"))
    want = scoring.token_bucket(bindings.messages(spark, SMALL), "node", 0.00001, 2.0)
    assert {(r[0], r[1], r[2]) for r in got.collect()} == {(r["node"], r["allowed"], r["denied"]) for r in want.collect()}


def test_ttl_lets_a_repeat_through(spark, tmp_path):
    # the third row moves the watermark on, and the batch after that one lets the first one's state go
    rows = [("2024-01-01 00:00:00", 1, "p"), ("2024-01-01 00:05:00", 2, "p"), ("2024-01-02 00:00:00", 9, "q"), ("2024-01-02 00:01:00", 8, "r"), ("2024-01-03 00:00:00", 3, "p")]
    for ts, seq, props in rows:
        df = spark.createDataFrame([(seq, 7, "view", props)], "event_id long, user_id long, event_type string, props string")
        df.withColumn("ts", F.lit(ts).cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/e")
    stream = live.event_stream(spark, f"{tmp_path}/e", files_per_batch=1)
    got = {r["seq"] for r in live.run_available(live.deduplicated(stream, "1 hour")).collect()}
    assert got == {1, 9, 8, 3}


def test_windows_are_emitted_once(spark):
    stream = live.tumbling_counts(live.event_stream(spark, f"{SMALL}/events.parquet"), "1 day", "1 day")
    rows = live.run_available(stream).collect()
    assert len({(r["kind"], r["start"]) for r in rows}) == len(rows)
