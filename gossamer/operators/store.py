"""Message stores: range pages, retention, capacity, and comparison of replicas."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_wins(arrivals: DataFrame, *order: str) -> DataFrame:
    """One row per id, the earliest by ``order``: a store ignores a second insert of an id."""
    rest = [c for c in arrivals.columns if c != "id"]
    best = arrivals.groupBy("id").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return best.select("id", *[F.col(f"r.{c}").alias(c) for c in rest])


def range_page(store: DataFrame, start: int, end: int, limit: int, offset: int) -> DataFrame:
    """Rows of an inclusive time range in order, with has_more and the store's whole count on each."""
    ranked = store.filter(F.col("ts").between(start, end)).orderBy("ts", "id").offset(offset).limit(limit + 1)
    numbered = ranked.withColumn("row", F.row_number().over(Window.orderBy("ts", "id")))
    more = ranked.agg((F.count("*") > limit).alias("has_more"))
    total = store.agg(F.count("*").alias("total"))
    # both sides are one row; the page itself has limit rows
    return numbered.filter(F.col("row") <= limit).join(more, F.lit(True)).join(total, F.lit(True))


def prune(store: DataFrame, older_than: int) -> DataFrame:
    """What retention keeps: rows at or after the cut-off."""
    return store.filter(F.col("ts") >= older_than)


def evict_to_capacity(store: DataFrame, bucket: str, capacity: int) -> DataFrame:
    """Drop whole time buckets, oldest first, until at most ``capacity`` rows are left.

    Only the buckets' sizes are ordered in one place, not the rows.
    """
    sizes = store.groupBy(bucket).agg(F.count("*").alias("n"))
    newer = F.sum("n").over(Window.orderBy(F.desc(bucket)).rowsBetween(Window.unboundedPreceding, 0))
    kept = sizes.withColumn("held", newer).filter(F.col("held") <= capacity).select(bucket)
    return store.join(kept, bucket, "left_semi")


def missing(wanted: DataFrame, held: DataFrame, *keys: str) -> DataFrame:
    """Rows of ``wanted`` whose keys ``held`` lacks: what an announcement, a sync response or a state difference asks for."""
    return wanted.join(held.select(*keys).distinct(), list(keys), "left_anti")


def pull(ids: DataFrame, store: DataFrame) -> DataFrame:
    """Stored rows of the asked-for ids; unknown ids are skipped."""
    return ids.join(store, "id")


def digest_lanes(rows: DataFrame, *by: str) -> DataFrame:
    """XOR of the SHA-256 of (id, payload) in eight 32-bit lanes, whatever the rows' order; n counts them."""
    leaf = F.sha2(F.concat_ws(":", F.col("id").cast("string"), "payload"), 256)
    lanes = [
        F.coalesce(F.bit_xor(F.conv(F.substring(leaf, 1 + 8 * i, 8), 16, 10).cast("long")), F.lit(0).cast("long")).alias(f"lane{i}")
        for i in range(8)
    ]
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *lanes)


def windowed_digests(a: DataFrame, b: DataFrame, width: int) -> DataFrame:
    """Windows of ``width`` time units in which two replicas differ, with both counts."""
    window = F.floor(F.col("ts") / width).alias("window")
    left, right = (digest_lanes(x.withColumn("window", window), "window") for x in (a, b))
    lanes = [f"lane{i}" for i in range(8)]
    l, r = (F.struct(*[F.col(f"{s}.{c}") for c in lanes]) for s in ("l", "r"))
    joined = left.alias("l").join(right.alias("r"), "window", "full")
    return joined.filter(~l.eqNullSafe(r)).select(
        "window", F.coalesce("l.n", F.lit(0)).alias("n_a"), F.coalesce("r.n", F.lit(0)).alias("n_b")
    )


def anti_entropy(a: DataFrame, b: DataFrame, width: int) -> DataFrame:
    """id, side of every row that only one replica holds; rows are read only in windows whose digests differ."""
    differing = windowed_digests(a, b, width).select("window")
    window = F.floor(F.col("ts") / width)
    held = [x.withColumn("window", window).join(differing, "window", "left_semi").select("id") for x in (a, b)]
    out = [missing(x, y, "id").withColumn("side", F.lit(s)) for x, y, s in ((held[0], held[1], "a"), (held[1], held[0], "b"))]
    return out[0].union(out[1])
