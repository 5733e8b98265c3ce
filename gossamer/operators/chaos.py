"""Faults put into message tables: partitions, loss, reordering, clock skew. Draws are hashes of keys, so runs repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(key: str, seed: str) -> Column:
    """A uniform number in [0, 1) from a key and a seed."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")), 256), 1, 8), 16, 10).cast("long") / 4294967296


def drop(messages: DataFrame, key: str, loss: float, seed: str) -> DataFrame:
    """What arrives when each message is lost with probability ``loss``."""
    return messages.filter(draw(key, seed) >= loss)


def split_brain(sides: DataFrame) -> DataFrame:
    """src, dst: every ordered pair of ``sides`` (node, side) that a partition cuts; a table of the members' sides squared."""
    other = sides.select(F.col("node").alias("dst"), F.col("side").alias("other"))
    return sides.join(other, F.col("side") != F.col("other")).select(F.col("node").alias("src"), "dst")


def block(messages: DataFrame, cut: DataFrame) -> DataFrame:
    """Messages (src, dst) that no cut pair stops."""
    return messages.join(cut, ["src", "dst"], "left_anti")


def reorder(messages: DataFrame, key: str, share: float, least_ms: int, most_ms: int, seed: str) -> DataFrame:
    """Adds deliver_at: a share of the messages is held back for a while between the two bounds."""
    u = draw(key, seed)
    wait = F.when(u < share, least_ms + F.floor(u / share * (most_ms - least_ms))).otherwise(0).cast("long")
    return messages.withColumn("deliver_at", F.col("ts") + wait)


def valid_under_skew(age_ms: Column, sender_skew: Column, receiver_skew: Column, most_ms: int) -> Column:
    """Whether a message's age, as the skewed clocks see it, is between zero and ``most_ms``."""
    return (age_ms - (sender_skew - receiver_skew)).between(0, most_ms)


def cascade(nodes: DataFrame, group: str, start_ms: int, delay_ms: int) -> DataFrame:
    """node, failed_at: the nodes of each group fail one after the other, in order of id."""
    r = F.row_number().over(Window.partitionBy(group).orderBy("node"))
    return nodes.select("node", (F.lit(start_ms) + (r - 1) * F.lit(delay_ms)).cast("long").alias("failed_at"))


def under_isolation(messages: DataFrame, failures: DataFrame, healed_at: int | None = None) -> DataFrame:
    """Adds blocked: whether a message's source or target was cut off from all others when it was sent.

    An isolated node stands for its pairs with every other node, so no pairs are made.
    """
    at = lambda end: failures.select(F.col("node").alias(end), F.col("failed_at").alias(f"{end}_failed"))
    cut = F.least("src_failed", "dst_failed") <= F.col("ts")
    if healed_at is not None:
        cut &= F.col("ts") < healed_at
    out = messages.join(at("src"), "src", "left").join(at("dst"), "dst", "left")
    return out.withColumn("blocked", F.coalesce(cut, F.lit(False))).select(*messages.columns, "blocked")


def heal(cut: DataFrame, healed: DataFrame) -> DataFrame:
    """Cut pairs (src, dst) without the healed ones, in both directions."""
    both = healed.select("src", "dst").union(healed.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return cut.join(both, ["src", "dst"], "left_anti")
