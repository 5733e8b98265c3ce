"""Alert runs over long series."""

from pyspark.sql import functions as F

from gossamer.operators import monitoring

HOUR = 3_600_000


def test_alert_runs_of_more_hours_than_an_int_of_milliseconds(spark):
    n = 700  # 700 hours are over 2^31 ms
    series = spark.range(n + 3).filter(f"id <> {n}").selectExpr("'a' AS kind", f"id * {HOUR} AS bucket", "3L AS n")
    got = monitoring.alert_islands(series, F.col("n") >= 3, HOUR, 2, "kind").orderBy("first").collect()
    assert [(r["first"], r["last"], r["buckets"]) for r in got] == [(0, (n - 1) * HOUR, n), ((n + 1) * HOUR, (n + 2) * HOUR, 2)]
