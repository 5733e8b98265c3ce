"""Seen-maps and caches: shards, evictions, idle entries, packing by bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shard_index(ts: Column, rnd: Column, shards: int = 16) -> Column:
    """Low bits of ts XOR rnd; ``shards`` is a power of two."""
    return ts.bitwiseXOR(rnd).bitwiseAND(F.lit(shards - 1))


def utilization(entries: DataFrame, shard: str, capacity: int) -> DataFrame:
    """shard, entries, share of its capacity, near_capacity (over 0.8)."""
    out = entries.groupBy(shard).agg(F.count("*").alias("entries"))
    return out.withColumn("share", F.round(F.col("entries") / capacity, 6)).withColumn("near_capacity", F.col("share") > 0.8)


def emergency_evict(entries: DataFrame, shard: str, share: float = 0.1) -> DataFrame:
    """What is left when each shard drops its oldest ``share``; a shard has a bounded capacity, so it is ranked whole."""
    n = F.count("*").over(Window.partitionBy(shard))
    rank = F.row_number().over(Window.partitionBy(shard).orderBy("ts", "seq"))
    return entries.withColumn("n", n).withColumn("rank", rank).filter(F.col("rank") > F.floor(F.col("n") * share)).drop("n", "rank")


def least_recently_used(uses: DataFrame, pool: str, entry: str) -> DataFrame:
    """pool, victim: the entry whose last use is the oldest; ties by entry."""
    last = uses.groupBy(pool, entry).agg(F.max("ts").alias("last"))
    return last.groupBy(pool).agg(F.min_by(entry, F.struct("last", entry)).alias("victim"))


def idle(uses: DataFrame, entry: str, as_of: int, timeout_ms: int) -> DataFrame:
    """entry, last: entries that have not been used for longer than the timeout."""
    return uses.groupBy(entry).agg(F.max("ts").alias("last")).filter(as_of - F.col("last") > timeout_ms)


def pack(frames: DataFrame, key: str, size: str, budget: int) -> DataFrame:
    """Adds used: frames of each key in order while their sizes' sum stays within the budget."""
    w = Window.partitionBy(key).orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return frames.withColumn("used", F.sum(size).over(w)).filter(F.col("used") <= budget)


def sample_peers(members: DataFrame, group: str, member: str, k: int, seed: str) -> DataFrame:
    """A uniform sample of ``k`` members of each group, by the order of seeded hashes: the sampling is the feature."""
    draw = F.sha2(F.concat_ws(":", F.lit(seed), F.col(member).cast("string")), 256)
    rank = F.row_number().over(Window.partitionBy(group).orderBy(draw))
    return members.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k)


def fifo_cache(seen: DataFrame, entry: str, as_of: int, ttl_ms: int, capacity: int) -> DataFrame:
    """entry, first: what a cache holds; expired entries go first, then the oldest beyond its capacity. A repeat doesn't refresh an entry."""
    first = seen.groupBy(entry).agg(F.min("ts").alias("first"))
    return first.filter(F.col("first") >= as_of - ttl_ms).orderBy(F.desc("first"), entry).limit(capacity)


def cache_get(asked: DataFrame, cached: DataFrame, entry: str, ttl_ms: int) -> DataFrame:
    """Adds hit: whether the entry was cached at the asking time (ts) and had not expired, evicted or not."""
    age = F.col("ts") - F.col("first")
    return asked.join(cached, entry, "left").withColumn("hit", F.coalesce(age.between(0, ttl_ms), F.lit(False))).drop("first")
