"""Rates, histograms, health and alerts over event and metric tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def tumbling_counts(copies: DataFrame, width_ms: int, *by: str) -> DataFrame:
    """by, bucket (start in ms), n, per_s."""
    bucket = (F.floor(F.col("ts") / width_ms) * width_ms).alias("bucket")
    return copies.groupBy(*by, bucket).agg(F.count("*").alias("n")).withColumn("per_s", F.round(F.col("n") * 1000 / width_ms, 6))


def two_bucket_rate(counts: DataFrame, width_ms: int, *by: str) -> DataFrame:
    """Adds rate: this bucket and the one before it over both their lengths; a gap counts as zero."""
    w = Window.partitionBy(*by).orderBy("bucket")
    before = F.when(F.lag("bucket").over(w) == F.col("bucket") - width_ms, F.lag("n").over(w)).otherwise(0)
    return counts.withColumn("rate", F.round((F.col("n") + before) * 1000 / (2 * width_ms), 6))


def histogram(values: DataFrame, column: str, bounds: list[float], *by: str) -> DataFrame:
    """by, le, n: cumulative counts at each bound, the last one at infinity."""
    counted = values.groupBy(*by).agg(*[F.count_if(F.col(column) <= b).alias(f"b{i}") for i, b in enumerate(bounds)], F.count(column).alias("binf"))
    pairs = [F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)]
    pairs.append(F.struct(F.lit(float("inf")).alias("le"), F.col("binf").alias("n")))
    return counted.select(*by, F.explode(F.array(*pairs)).alias("p")).select(*by, "p.le", "p.n")


def histogram_quantile(buckets: DataFrame, q: float, *by: str) -> DataFrame:
    """by, quantile: linear within the bucket that holds rank q; the last finite bound beyond it."""
    w = Window.partitionBy(*by).orderBy("le")
    total = F.max("n").over(Window.partitionBy(*by))
    lower, below = F.coalesce(F.lag("le").over(w), F.lit(0.0)), F.coalesce(F.lag("n").over(w), F.lit(0))
    marked = buckets.withColumn("rank", q * total).withColumn("lower", lower).withColumn("below", below)
    hit = marked.filter((F.col("n") >= F.col("rank")) & (F.col("below") < F.col("rank")))
    inside = F.col("lower") + (F.col("le") - F.col("lower")) * (F.col("rank") - F.col("below")) / (F.col("n") - F.col("below"))
    value = F.when(F.col("le") == float("inf"), F.col("lower")).otherwise(inside)
    return hit.select(*by, F.round(value, 6).alias("quantile"))


def alert_islands(series: DataFrame, condition, step_ms: int, hold: int, *by: str) -> DataFrame:
    """by, first, last, buckets: runs of at least ``hold`` neighbouring buckets that meet a condition."""
    w = Window.partitionBy(*by).orderBy("bucket")
    island = F.col("bucket") - F.row_number().over(w).cast("long") * step_ms
    runs = series.filter(condition).withColumn("island", island)
    out = runs.groupBy(*by, "island").agg(F.min("bucket").alias("first"), F.max("bucket").alias("last"), F.count("*").alias("buckets"))
    return out.filter(F.col("buckets") >= hold).drop("island")


def health(nodes: DataFrame) -> DataFrame:
    """Adds status by the ordered rules: peers, eager, failure_rate, pending, cache_use, shutdown are read."""
    status = (
        F.when(F.col("shutdown") | (F.col("peers") == 0) | (F.col("failure_rate") > 0.8), "unhealthy")
        .when(
            (F.col("eager") == 0) | (F.col("failure_rate") > 0.3) | (F.col("pending") > 50) | (F.col("cache_use") > 0.95) | (F.col("peers") < 3),
            "degraded",
        )
        .otherwise("healthy")
    )
    return nodes.withColumn("status", status)


def counter_rates(samples: DataFrame, width_ms: int, *by: str) -> DataFrame:
    """by, bucket, increase, per_s of counters (ts, seq, reading): a reading below the one before it is a reset and counts whole."""
    w = Window.partitionBy(*by).orderBy("ts", "seq")
    before = F.lag("reading").over(w)
    step = F.when(before.isNull(), 0).when(F.col("reading") < before, F.col("reading")).otherwise(F.col("reading") - before)
    bucket = (F.floor(F.col("ts") / width_ms) * width_ms).alias("bucket")
    out = samples.select(*by, "ts", step.alias("step")).groupBy(*by, bucket).agg(F.sum("step").alias("increase"))
    return out.withColumn("per_s", F.round(F.col("increase") * 1000 / width_ms, 6))


def repair_ratios(counts: DataFrame) -> DataFrame:
    """Adds the ratios of counters (succeeded, failed, retried, added, removed, promoted, demoted, delivered, sent): success of repairs, that
    with a guarded divisor, retries per repair, churn, promotions per demotion, and a health score of at most 1."""
    c = F.col
    tried = c("succeeded") + c("failed")
    return counts.select(
        "*",
        F.round(F.try_divide(c("succeeded"), tried), 6).alias("success"),
        F.round(c("succeeded") / (tried + 0.001), 6).alias("guarded_success"),
        F.round(F.try_divide(c("retried"), tried), 6).alias("retry_rate"),
        (c("added") + c("removed")).alias("churn"),
        F.round(F.try_divide(c("promoted"), c("demoted")), 6).alias("promotion_ratio"),
        F.least(F.round(F.try_divide(c("delivered"), c("sent")), 6), F.lit(1.0)).alias("health"),
    )


def severity(value, warning: float, critical: float):
    """ok, warning or critical by two thresholds."""
    return F.when(value > critical, "critical").when(value > warning, "warning").otherwise("ok")
