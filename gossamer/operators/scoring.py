"""Peer scores from round-trip samples: smoothed latency, decaying failures, rankings, rate limits."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

@dataclass(frozen=True)
class Preset:
    """Parameters of the scoring formula."""

    alpha: float
    max_age_ms: int
    min_samples: int
    penalty: float
    half_life_ms: int
    floor_ms: float
    exponent: float = 1.15


#: The presets, the least round trip, and the weight of failures that counts as none.
DEFAULT = Preset(0.3, 300_000, 3, 2.0, 1_800_000, 10.0)
LAN = Preset(0.5, 180_000, 2, 3.0, 900_000, 5.0)
WAN = Preset(0.2, 600_000, 5, 1.5, 3_600_000, 20.0)
LEAST_RTT, LEAST_FAILURES = 0.1, 0.01


def _ema(ordered: Column, alpha: float) -> Column:
    """Exponential average of an ordered array; the first sample seeds it."""
    return F.aggregate(
        ordered,
        F.lit(None).cast("double"),
        lambda a, x: F.when(a.isNull(), x).otherwise(F.lit(alpha) * x + F.lit(1 - alpha) * a),
    )


def peer_scores(samples: DataFrame, as_of: int, preset: Preset = DEFAULT) -> DataFrame:
    """peer, ema, lowest, highest, samples, failures (decayed to ``as_of``), loss, score, last.

    ``samples``: peer, ts, seq, rtt, failed. The average depends on order, so each peer's
    samples are folded; everything else is a plain aggregate. Failures that have decayed below ``LEAST_FAILURES`` together count as none.
    """
    rtt = F.when(~F.col("failed"), F.greatest("rtt", F.lit(LEAST_RTT)))
    decay = F.exp(F.lit(-math.log(2) / preset.half_life_ms) * (F.lit(as_of) - F.col("ts")))
    per = samples.groupBy("peer").agg(
        F.transform(F.sort_array(F.collect_list(F.when(~F.col("failed"), F.struct("ts", "seq", rtt.alias("r"))))), lambda x: x["r"]).alias("o"),
        F.min(rtt).alias("lowest"),
        F.max(rtt).alias("highest"),
        F.count(rtt).alias("samples"),
        F.sum(F.when(F.col("failed"), decay).otherwise(0.0)).alias("decayed"),
        F.max(F.when(~F.col("failed"), F.col("ts"))).alias("last"),
    )
    per = per.withColumn("failures", F.when(F.col("decayed") < LEAST_FAILURES, 0.0).otherwise(F.col("decayed")))
    loss = F.coalesce(F.try_divide(F.col("failures"), F.col("samples") + F.col("failures")), F.lit(0.0))
    out = per.select("peer", _ema(F.col("o"), preset.alpha).alias("ema"), "lowest", "highest", "samples", "failures", "last").withColumn("loss", loss)
    base = 1000 / F.pow(F.greatest("ema", F.lit(LEAST_RTT)) + preset.floor_ms, F.lit(preset.exponent))
    return out.withColumn("score", base / (1 + F.col("loss") * preset.penalty))


def normalized(scores: DataFrame, as_of: int, default: float = 0.5, preset: Preset = DEFAULT) -> DataFrame:
    """Adds normalized = score / (score + 10), the default where there is no fresh score."""
    fresh = F.lit(as_of) - F.col("last") <= preset.max_age_ms
    return scores.withColumn("normalized", F.when(fresh, F.coalesce(F.col("score") / (F.col("score") + 10), F.lit(default))).otherwise(default))


def stats(scores: DataFrame, as_of: int, preset: Preset = DEFAULT) -> DataFrame:
    """peers, reliable, stale and mean figures; the means include stale peers."""
    return scores.agg(
        F.count("*").alias("peers"),
        F.count_if(F.col("samples") >= preset.min_samples).alias("reliable"),
        F.count_if(F.lit(as_of) - F.col("last") > preset.max_age_ms).alias("stale"),
        F.round(F.avg("ema"), 6).alias("mean_rtt"),
        F.round(F.avg("score"), 6).alias("mean_score"),
    )


def best(scores: DataFrame, as_of: int, n: int, worst: bool = False, preset: Preset = DEFAULT) -> DataFrame:
    """The ``n`` best (or worst) fresh peers; ties by id."""
    fresh = scores.filter(F.lit(as_of) - F.col("last") <= preset.max_age_ms)
    key = F.asc("score") if worst else F.desc("score")
    return fresh.orderBy(key, "peer").limit(n)


def drop_stale(scores: DataFrame, as_of: int, preset: Preset = DEFAULT) -> DataFrame:
    """Scores whose last sample is fresh."""
    return scores.filter(F.lit(as_of) - F.col("last") <= preset.max_age_ms)


def token_bucket(requests: DataFrame, key: str, rate_per_s: float, burst: float) -> DataFrame:
    """key, allowed, denied: each request takes a token of its key's bucket, refilled with time up to ``burst``."""
    return bucket_states(requests, key, rate_per_s, burst).select(key, "allowed", "denied")


def bucket_states(requests: DataFrame, key: str, rate_per_s: float, burst: float) -> DataFrame:
    """key, tokens, at (time of the last request), allowed, denied of each key's bucket after all requests."""
    state = F.struct(F.lit(burst).alias("tokens"), F.lit(None).cast("long").alias("at"), F.lit(0).cast("long").alias("allowed"), F.lit(0).cast("long").alias("denied"))

    def step(a: Column, x: Column) -> Column:
        waited = F.coalesce(x["ts"] - a["at"], F.lit(0)) / 1000
        tokens = F.least(F.lit(burst), a["tokens"] + waited * rate_per_s)
        ok = tokens >= 1
        return F.struct(
            F.when(ok, tokens - 1).otherwise(tokens).alias("tokens"),
            x["ts"].alias("at"),
            (a["allowed"] + F.when(ok, 1).otherwise(0)).alias("allowed"),
            (a["denied"] + F.when(ok, 0).otherwise(1)).alias("denied"),
        )

    ordered = requests.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("ts", "seq"))).alias("r"))
    return ordered.select(key, F.aggregate("r", state, step).alias("s")).select(key, "s.tokens", "s.at", "s.allowed", "s.denied")


def tokens_at(states: DataFrame, as_of: int, rate_per_s: float, burst: float) -> DataFrame:
    """Adds available: the tokens at ``as_of``, without taking any."""
    refilled = F.col("tokens") + (F.lit(as_of) - F.col("at")) / 1000 * rate_per_s
    return states.withColumn("available", F.least(F.lit(burst), refilled))


def live_buckets(states: DataFrame, as_of: int, idle_ms: int, burst: float) -> DataFrame:
    """Buckets that a clean-up keeps: used within ``idle_ms``, or not full when last used."""
    return states.filter((F.col("at") > as_of - idle_ms) | (F.col("tokens") < burst - 0.1))
