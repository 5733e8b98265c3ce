"""De-duplication, receive counts, tree parents and dissemination measures of message copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

COPY = ("node", "msg_id")


def receive_count(copies: DataFrame) -> DataFrame:
    """Adds ``receive_count``: the n-th copy of a message at a node, in order of (ts, seq)."""
    w = Window.partitionBy(*COPY).orderBy("ts", "seq")
    return copies.withColumn("receive_count", F.row_number().over(w).cast("long"))


def duplicate_ratio(copies: DataFrame) -> DataFrame:
    """node, delivered, duplicates, ratio of duplicates to deliveries. Two grouped counts; no window is needed."""
    per_message = copies.groupBy(*COPY).agg(F.count("*").alias("n"))
    return per_message.groupBy("node").agg(
        F.count("*").alias("delivered"), (F.sum("n") - F.count("*")).alias("duplicates")
    ).withColumn("ratio", F.round(F.col("duplicates") / F.col("delivered"), 6))


def tree_parent(copies: DataFrame, sender: str) -> DataFrame:
    """node, msg_id, parent: the sender of the first copy."""
    return copies.groupBy(*COPY).agg(F.min_by(sender, F.struct("ts", "seq")).alias("parent"))


def prune_triggers(copies: DataFrame, threshold: int = 3) -> DataFrame:
    """Copies beyond ``threshold`` of a message at a node: each asks its sender to prune."""
    return receive_count(copies).filter(F.col("receive_count") > threshold)


def seen_ttl(copies: DataFrame, ttl_ms: int) -> DataFrame:
    """Delivered copies where a message counts as seen for ``ttl_ms`` from its last *accepted* copy.

    The expiry is not refreshed by duplicates, so each message's copies at a node are folded in order.
    """
    ordered = F.sort_array(F.collect_list(F.struct("ts", "seq")))
    none = F.lit(None).cast("long")
    start = F.struct(none.alias("at"), F.array().cast("array<struct<ts:bigint,seq:bigint>>").alias("kept"))

    def step(a, x):
        taken = a["at"].isNull() | (x["ts"] - a["at"] > ttl_ms)
        return F.when(taken, F.struct(x["ts"].alias("at"), F.concat(a["kept"], F.array(x)).alias("kept"))).otherwise(a)

    return (
        copies.groupBy(*COPY)
        .agg(ordered.alias("c"))
        .select(*COPY, F.explode(F.aggregate("c", start, step, lambda a: a["kept"])).alias("x"))
        .select(*COPY, F.col("x.ts").alias("ts"), F.col("x.seq").alias("seq"))
    )


def redundancy(copies: DataFrame, nodes: int) -> DataFrame:
    """msg_id, copies, rmr: redundant copies per node that needs one, 0 for one node or none."""
    out = copies.groupBy("msg_id").agg(F.count("*").alias("copies"))
    return out.withColumn("rmr", F.lit(0.0) if nodes <= 1 else F.round(F.col("copies") / (nodes - 1) - 1, 6))


def control_overhead(copies: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """node, gossip, control, overhead: announcements, grafts and prunes per payload message."""
    kind = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])[F.col("kind")]
    return (
        copies.groupBy("node")
        .agg(F.count_if(kind == "gossip").alias("gossip"), F.count_if(kind.isin("ihave", "graft", "prune")).alias("control"))
        .withColumn("overhead", F.when(F.col("gossip") == 0, 0.0).otherwise(F.round(F.col("control") / F.col("gossip"), 6)))
    )


def coverage(copies: DataFrame, nodes: DataFrame) -> DataFrame:
    """msg_id, reached, missing: how many of the online ``nodes`` hold each message."""
    # the number of nodes is one value, joined as a row
    total = nodes.agg(F.count("*").alias("total"))
    reached = copies.join(nodes, "node", "left_semi").groupBy("msg_id").agg(F.count_distinct("node").alias("reached"))
    return reached.join(total, F.lit(True)).select("msg_id", "reached", (F.col("total") - F.col("reached")).alias("missing"))


def last_hop(copies: DataFrame) -> DataFrame:
    """msg_id, last_hop, mean_hops: hops being the order in which nodes first get a message."""
    first = copies.groupBy("msg_id", "node").agg(F.min(F.struct("ts", "seq")).alias("at"))
    hop = F.row_number().over(Window.partitionBy("msg_id").orderBy("at")) - 1
    level = F.floor(F.log2(hop + 1)).cast("long")
    return first.select("msg_id", level.alias("hops")).groupBy("msg_id").agg(
        F.max("hops").alias("last_hop"), F.round(F.avg("hops"), 6).alias("mean_hops")
    )
