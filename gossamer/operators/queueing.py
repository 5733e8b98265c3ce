"""Priority queues, batches, retry schedules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Depth and weight of the classes critical, high, normal, low.
DEPTHS, WEIGHTS = (64, 256, 512, 128), (8, 4, 2, 1)


def bounded_push(items: DataFrame, depths: tuple[int, ...] = DEPTHS) -> DataFrame:
    """What each queue accepts: a class rejects items once its depth is reached."""
    depth = F.element_at(F.array(*[F.lit(d) for d in depths]), F.col("class") + 1)
    place = F.row_number().over(Window.partitionBy("queue", "class").orderBy("seq"))
    return items.withColumn("place", place.cast("long")).filter(F.col("place") <= depth)


def strict_pop(items: DataFrame, n: int) -> DataFrame:
    """The next ``n`` of each queue: lowest class first, first in first out within it."""
    place = F.row_number().over(Window.partitionBy("queue").orderBy("class", "seq"))
    return items.withColumn("place", place.cast("long")).filter(F.col("place") <= n)


def quota_pop(items: DataFrame, n: int, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The next ``n`` of each queue by weighted quotas: a non-empty class gets at least one; what is left is filled in strict order."""
    total = sum(weights)
    quota = F.element_at(F.array(*[F.lit(max(n * w // total, 1 if w else 0)) for w in weights]), F.col("class") + 1)
    place = F.row_number().over(Window.partitionBy("queue", "class").orderBy("seq"))
    first = items.withColumn("by_quota", place <= quota)
    order = Window.partitionBy("queue").orderBy(F.desc("by_quota"), "class", "seq")
    return first.withColumn("place", F.row_number().over(order).cast("long")).filter(F.col("place") <= n)


def fifo_batches(items: DataFrame, key: str, size: int) -> DataFrame:
    """key, batch, n, first, last: items of each key in batches of ``size`` in arrival order."""
    w = Window.partitionBy(key).orderBy("ts", "seq")
    batch = F.floor((F.row_number().over(w) - 1) / size)
    return items.withColumn("batch", batch).groupBy(key, "batch").agg(
        F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last")
    )


def backoff_schedule(requests: DataFrame, base_ms: int, most_ms: int, retries: int) -> DataFrame:
    """Each request with its retries: attempt, delay = min(base * 2^(attempt - 1), most), due."""
    delay = F.least(F.lit(float(base_ms)) * F.pow(F.lit(2.0), F.col("attempt") - 1), F.lit(float(most_ms))).cast("long")
    tries = F.sequence(F.lit(1).cast("long"), F.lit(retries).cast("long"))
    tried = requests.withColumn("attempt", F.explode(tries)).withColumn("delay", delay)
    w = Window.partitionBy(*requests.columns).orderBy("attempt")
    return tried.withColumn("due", F.col("ts") + F.sum("delay").over(w))


def peak_concurrency(sends: DataFrame, key: str) -> DataFrame:
    """key, peak: most sends of a key (ts, duration) under way at one time; an end before a start at the same time."""
    edges = sends.select(key, F.explode(F.array(F.struct(F.col("ts").alias("at"), F.lit(1).alias("d")), F.struct((F.col("ts") + F.col("duration")).alias("at"), F.lit(-1).alias("d")))).alias("e"))
    w = Window.partitionBy(key).orderBy("e.at", "e.d").rowsBetween(Window.unboundedPreceding, 0)
    return edges.withColumn("now", F.sum("e.d").over(w)).groupBy(key).agg(F.max("now").cast("long").alias("peak"))
