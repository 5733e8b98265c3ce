"""Adaptive batch sizes, trends of smoothed rates, retries and their outcomes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def batch_size(target: Column, latency_ms: Column, grafts: Column, success: Column, nodes: Column, least: int = 4, most: int = 64) -> Column:
    """A batch size from latency (larger when slow), graft success (smaller when low, over 20 grafts) and cluster size."""
    by_latency = F.when(latency_ms < 20, 0.75).when(latency_ms > 200, 1.5).otherwise(1.0)
    by_success = F.when((grafts > 20) & (success < 0.8), 0.6 + 0.4 * success).otherwise(1.0)
    by_nodes = F.when(nodes > 100, 1 + 0.2 * F.ln(nodes / 100)).otherwise(1.0)
    return F.greatest(F.lit(float(least)), F.least(F.lit(float(most)), target * by_latency * by_success * by_nodes))


def efficiency_factor(efficiency: Column) -> Column:
    """Piecewise linear factor: 0.5 to 0.15, 1.0 from 0.25 to 0.6, 1.5 from 0.85."""
    return (
        F.when(efficiency <= 0.15, 0.5)
        .when(efficiency < 0.25, 0.5 + 0.5 * (efficiency - 0.15) / 0.1)
        .when(efficiency <= 0.6, 1.0)
        .when(efficiency < 0.85, 1.0 + 0.5 * (efficiency - 0.6) / 0.25)
        .otherwise(1.5)
    )


def smoothed(series: DataFrame, key: str, value: str, alpha: float) -> DataFrame:
    """key, bucket, value, ema: exponential average over each key's ordered buckets."""
    ordered = F.sort_array(F.collect_list(F.struct("bucket", F.col(value).cast("double").alias("v"))))
    empty = F.array().cast("array<struct<bucket:bigint,v:double,ema:double>>")

    def step(a: Column, x: Column) -> Column:
        last = F.try_element_at(a, F.lit(-1))["ema"]
        ema = F.when(last.isNull(), x["v"]).otherwise(alpha * x["v"] + (1 - alpha) * last)
        return F.concat(a, F.array(F.struct(x["bucket"].alias("bucket"), x["v"].alias("v"), ema.alias("ema"))))

    out = series.groupBy(key).agg(ordered.alias("o")).select(key, F.explode(F.aggregate("o", empty, step)).alias("x"))
    return out.select(key, F.col("x.bucket").alias("bucket"), F.col("x.v").alias(value), F.col("x.ema").alias("ema"))


def trend(series: DataFrame, key: str, threshold: float, least: int) -> DataFrame:
    """Adds trend of ema against the bucket before: up, down, flat; unknown for the first ``least``."""
    w = Window.partitionBy(key).orderBy("bucket")
    step = F.col("ema") - F.lag("ema").over(w)
    early = F.row_number().over(w) <= least
    return series.withColumn(
        "trend", F.when(early, "unknown").when(step > threshold, "up").when(step < -threshold, "down").otherwise("flat")
    )


def graft_outcomes(requests: DataFrame, arrivals: DataFrame, within_ms: int) -> DataFrame:
    """node, payload, requested, latency (null: none in time): each first request and the first arrival after it."""
    asked = requests.groupBy("node", "payload").agg(F.min("ts").alias("requested"))
    in_time = F.col("ts").between(F.col("requested"), F.col("requested") + within_ms)
    came = asked.join(arrivals.select("node", "payload", "ts"), ["node", "payload"]).filter(in_time)
    first = came.groupBy("node", "payload").agg(F.min("ts").alias("came"))
    return asked.join(first, ["node", "payload"], "left").select("node", "payload", "requested", (F.col("came") - F.col("requested")).alias("latency"))


def alternate(alternatives: Column, original: Column, retry: Column) -> Column:
    """The peer to ask at a retry: the alternatives in turn, the original where there are none."""
    n = F.size(alternatives)
    return F.when(n > 0, F.try_element_at(alternatives, (F.pmod(retry - 1, F.greatest(n, F.lit(1))) + 1).cast("int"))).otherwise(original)


def role_flaps(changes: DataFrame, key: str, role: Column) -> DataFrame:
    """key, flaps: how often the role differs from the one before it."""
    w = Window.partitionBy(key).orderBy("ts", "seq")
    flap = F.lag(role).over(w) != role
    return changes.select(key, flap.alias("f")).groupBy(key).agg(F.count_if("f").alias("flaps"))


@dataclass(frozen=True)
class Cleanup:
    """Parameters of adaptive clean-up, in ms where they are times."""

    base_ms: int = 30_000
    least_ms: int = 5_000
    most_ms: int = 120_000
    high: float = 0.8
    low: float = 0.3
    hysteresis: float = 0.03
    drop_some: float = 0.93
    drop_most: float = 0.96
    block_new: float = 0.98
    high_load: float = 1000.0
    target_ms: float = 50.0
    smoothing: float = 0.15
    ttl_divisor: float = 4.0
    ttl_cap: float = 2.0
    least_batch: float = 10.0
    most_batch: float = 500.0


def cleanup_plan(utilization: Column, rate: Column, was_aggressive: Column, ttl_ms: Column, p: Cleanup = Cleanup()) -> Column:
    """struct(backpressure, reason, aggressive, interval_ms) of a cache's next clean-up.

    The two thresholds move by the hysteresis with what the last clean-up was. Between them the interval falls
    linearly; it is no shorter than a part of the TTL, nor, unless pressure is extreme, than the least interval.
    """
    high = F.when(was_aggressive, p.high - p.hysteresis).otherwise(p.high + p.hysteresis)
    low = F.when(was_aggressive, p.low + p.hysteresis).otherwise(p.low - p.hysteresis)
    loaded = rate > p.high_load
    pressure = (
        F.when((utilization >= p.block_new) & loaded, "block_new")
        .when(utilization >= p.drop_most, "drop_most")
        .when(utilization >= p.drop_some, "drop_some")
        .otherwise("none")
    )
    reason = F.when(pressure != "none", "critical").when(utilization > high, "high").when(utilization < low, "low").otherwise("moderate")
    place = F.least(F.greatest((utilization - low) / (high - low), F.lit(0.0)), F.lit(1.0))
    extreme = pressure.isin("block_new", "drop_most")
    base = (
        F.when(extreme, p.least_ms / 2)
        .when(pressure == "drop_some", p.least_ms)
        .when(reason == "high", F.when(loaded, 2 * p.least_ms).otherwise(p.least_ms))
        .when(reason == "low", min(p.most_ms, 2 * p.base_ms))
        .otherwise(F.floor(p.most_ms - place * (p.most_ms - p.base_ms)))
    )
    by_ttl = F.when(ttl_ms > 0, F.least(ttl_ms / p.ttl_divisor, F.lit(p.most_ms * p.ttl_cap))).otherwise(0.0)
    interval = F.greatest(base, by_ttl, F.when(extreme, 0).otherwise(p.least_ms)).cast("double")
    return F.struct(
        pressure.alias("backpressure"), reason.alias("reason"), reason.isin("critical", "high").alias("aggressive"), interval.alias("interval_ms")
    )


def cleanup_batch(target: Column, last_ms: Column, efficiency: Column, trend_: Column, p: Cleanup = Cleanup()) -> Column:
    """The next target of a clean-up's batch: the last one scaled by duration, efficiency and its trend, then smoothed, between bounds.

    ``efficiency`` is null until there are enough clean-ups.
    """
    bounded = lambda x: F.least(F.greatest(x, F.lit(p.least_batch)), F.lit(p.most_batch))
    ratio = F.least(F.greatest(F.lit(p.target_ms) / F.greatest(last_ms, F.lit(1)), F.lit(0.5)), F.lit(2.0))
    factor = F.when(efficiency.isNull(), 1.0).otherwise(efficiency_factor(efficiency))
    by_trend = F.when(trend_ == "up", 0.95).when(trend_ == "down", 1.05).otherwise(1.0)
    return bounded(p.smoothing * bounded(target * ratio * factor * by_trend) + (1 - p.smoothing) * target)


def cleanup_stats(runs: DataFrame, key: str) -> DataFrame:
    """key, cycles, mean_ms, max_ms, removed, scanned, efficiency and aggressive of clean-ups (duration_ms, removed, scanned, aggressive)."""
    out = runs.groupBy(key).agg(
        F.count("*").alias("cycles"), F.avg("duration_ms").alias("mean_ms"), F.max("duration_ms").alias("max_ms"),
        F.sum("removed").alias("removed"), F.sum("scanned").alias("scanned"), F.count_if("aggressive").alias("aggressive"),
    )
    return out.withColumn("efficiency", F.least(F.try_divide("removed", "scanned"), F.lit(1.0)))
