"""Topologies as tables of (node, peer, role): admission, promotion, demotion, removal and rebalancing as set operations.

A topology's rows are node, peer, role (eager or lazy), is_ring (whether the peer is a protected ring neighbour) and,
where ranks need it, score. Every step is a join or a window per node over the rows that it has; no pairs are made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gossamer.operators.topology import ring_hash


def ring_flags(known: DataFrame, reach: int = 2) -> DataFrame:
    """Adds is_ring: whether a peer is within ``reach`` places of its node on the ring of the node and its peers."""
    by = Window.partitionBy("node")
    own = F.col("node").cast(known.schema["peer"].dataType)
    hashed = known.withColumn("hash", ring_hash("peer")).withColumn("own", own).withColumn("own_hash", ring_hash("own"))
    ahead = F.struct(F.col("hash").alias("a"), F.col("peer").alias("b")) <= F.struct(F.col("own_hash").alias("a"), F.col("own").alias("b"))
    placed = hashed.withColumns({"at": F.row_number().over(by.orderBy("hash", "peer")), "ahead": F.count_if(ahead).over(by), "n": F.count("*").over(by) + 1})
    # the node itself stands behind the peers ahead of it, and those at or behind its place move on by one
    away = F.pmod(F.when(F.col("at") > F.col("ahead"), F.col("at")).otherwise(F.col("at") - 1) - F.col("ahead"), F.col("n"))
    return placed.withColumn("is_ring", F.least(away, F.col("n") - away) <= reach).select(*known.columns, "is_ring")


def _by_node(joins: DataFrame) -> DataFrame:
    """Known joins, dealt out once by node: every step behind it has its rows at hand."""
    return joins.filter("node IS NOT NULL AND peer IS NOT NULL").repartition("node")


def admit(joins: DataFrame, fanout: int, most: int) -> DataFrame:
    """Each join (node, peer, ts, seq) with its outcome: added_eager, added_lazy, limit_reached or already_exists.

    The first ``fanout`` peers of a node are eager, others lazy up to ``most`` in all; nobody is evicted.
    """
    pair = Window.partitionBy("node", "peer").orderBy("ts", "seq")
    seen = {"again": F.row_number().over(pair), "first_ts": F.first("ts").over(pair), "first_seq": F.first("seq").over(pair)}
    place = F.dense_rank().over(Window.partitionBy("node").orderBy("first_ts", "first_seq", "peer"))
    outcome = (
        F.when(F.col("place") > most, "limit_reached")
        .when(F.col("again") > 1, "already_exists")
        .when(F.col("place") <= fanout, "added_eager")
        .otherwise("added_lazy")
    )
    return _by_node(joins).withColumns(seen).withColumn("place", place).select("node", "peer", "ts", "seq", outcome.alias("outcome"))


def topology(joins: DataFrame, fanout: int, most: int, *measures: Column) -> DataFrame:
    """node, peer, role after all ``joins``, refused (the first peer beyond ``most`` of the node, if any), and ``measures`` over all joins of the pair."""
    pairs = _by_node(joins).groupBy("node", "peer").agg(F.min(F.struct("ts", "seq")).alias("first"), *measures)
    place = F.row_number().over(Window.partitionBy("node").orderBy("first.ts", "first.seq", "peer"))
    known = pairs.withColumn("place", place).filter(F.col("place") <= most + 1)
    known = known.withColumn("refused", F.max(F.when(F.col("place") > most, F.col("peer"))).over(Window.partitionBy("node"))).filter(F.col("place") <= most)
    return known.withColumn("role", F.when(F.col("place") <= fanout, "eager").otherwise("lazy")).select("node", "peer", "role", "refused", *pairs.columns[3:])


def initial_split(known: DataFrame, fanout: int, draw: Column) -> DataFrame:
    """node, peer, role: ``fanout`` peers by a drawn order are eager, all others lazy."""
    r = F.row_number().over(Window.partitionBy("node").orderBy(draw, "peer"))
    return known.select("node", "peer", F.when(r <= fanout, "eager").otherwise("lazy").alias("role"))


def snapshot(roles: DataFrame) -> DataFrame:
    """node, eager, lazy, total: sizes of the two sets; a peer held in both counts as ``torn``."""
    per = roles.groupBy("node", "peer").agg(F.count_if(F.col("role") == "eager").alias("e"), F.count_if(F.col("role") == "lazy").alias("l"))
    return per.groupBy("node").agg(
        F.count_if(F.col("e") > 0).alias("eager"), F.count_if(F.col("l") > 0).alias("lazy"), F.count("*").alias("total"),
        F.count_if((F.col("e") > 0) & (F.col("l") > 0)).alias("torn"),
    )


def members(asked: DataFrame, roles: DataFrame) -> DataFrame:
    """Each asked (node, peer) with its role, null where the peer is unknown."""
    return asked.join(roles.select("node", "peer", "role"), ["node", "peer"], "left")


def promote(roles: DataFrame, asked: DataFrame, max_eager: int) -> DataFrame:
    """Adds changed: lazy peers among ``asked`` (node, peer, seq) become eager in order of seq, while fewer than ``max_eager`` are."""
    first = asked.groupBy("node", "peer").agg(F.min("seq").alias("seq"))
    held = roles.join(first, ["node", "peer"], "left")
    eager = F.count_if(F.col("role") == "eager").over(Window.partitionBy("node"))
    wanted = (F.col("role") == "lazy") & F.col("seq").isNotNull()
    rank = F.row_number().over(Window.partitionBy("node", wanted).orderBy("seq", "peer"))
    out = held.withColumn("changed", wanted & (eager + rank <= max_eager))
    return out.withColumn("role", F.when(F.col("changed"), "eager").otherwise(F.col("role"))).select(*roles.columns, "changed")


def demote(roles: DataFrame, asked: DataFrame | Column) -> DataFrame:
    """Adds changed: eager peers among ``asked`` become lazy; ring neighbours refuse. ``asked`` is a table (node, peer) or a condition on ``roles``."""
    if isinstance(asked, Column):
        held = roles.withColumn("asked", asked)
    else:
        held = roles.join(asked.select("node", "peer", F.lit(True).alias("asked")).distinct(), ["node", "peer"], "left")
    out = held.withColumn("changed", F.coalesce("asked", F.lit(False)) & (F.col("role") == "eager") & ~F.col("is_ring"))
    return out.withColumn("role", F.when(F.col("changed"), "lazy").otherwise(F.col("role"))).select(*roles.columns, "changed")


def remove(roles: DataFrame, asked: DataFrame) -> DataFrame:
    """Each asked (node, peer) once, with its outcome: removed_eager, removed_lazy or not_found."""
    found = members(asked.select("node", "peer").distinct(), roles)
    return found.select("node", "peer", F.coalesce(F.concat(F.lit("removed_"), "role"), F.lit("not_found")).alias("outcome"))


def prefer_ring(roles: DataFrame, fanout: int) -> DataFrame:
    """Adds changed: ring neighbours that are lazy take the place of eager peers that are none, pair by pair; those left over come in up to ``fanout``."""
    by = Window.partitionBy("node")
    up = (F.col("role") == "lazy") & F.col("is_ring")
    down = (F.col("role") == "eager") & ~F.col("is_ring")
    counted = roles.withColumns({
        "ups": F.count_if(up).over(by), "downs": F.count_if(down).over(by), "held": F.count_if(F.col("role") == "eager").over(by),
        "rank": F.row_number().over(Window.partitionBy("node", "role", "is_ring").orderBy("peer")),
    })
    swaps = F.least("ups", "downs")
    changed = (up & (F.col("rank") <= swaps + F.greatest(fanout - F.col("held"), F.lit(0)))) | (down & (F.col("rank") <= swaps))
    out = counted.withColumn("changed", changed)
    role = F.when(F.col("changed"), F.when(F.col("role") == "lazy", "eager").otherwise("lazy")).otherwise(F.col("role"))
    return out.withColumn("role", role).select(*roles.columns, "changed")


def rebalance(roles: DataFrame, target: int, shrink: bool = True) -> DataFrame:
    """Adds changed: each node's eager set grows to ``target`` by ring neighbours, then scores, or shrinks to it by lowest scores outside the ring."""
    by = Window.partitionBy("node")
    counted = roles.withColumns({
        "held": F.count_if(F.col("role") == "eager").over(by),
        "rise": F.row_number().over(Window.partitionBy("node", "role").orderBy(F.desc("is_ring"), F.desc("score"), "peer")),
        "fall": F.row_number().over(Window.partitionBy("node", "role", "is_ring").orderBy("score", "peer")),
    })
    up = (F.col("role") == "lazy") & (F.col("rise") <= target - F.col("held"))
    down = (F.col("role") == "eager") & ~F.col("is_ring") & (F.col("fall") <= F.col("held") - target) & F.lit(shrink)
    out = counted.withColumn("changed", up | down)
    role = F.when(F.col("changed"), F.when(F.col("role") == "lazy", "eager").otherwise("lazy")).otherwise(F.col("role"))
    return out.withColumn("role", role).select(*roles.columns, "changed")


def eviction_pick(roles: DataFrame, newcomers: DataFrame | None = None) -> DataFrame:
    """node, newcomer, evicted: which lazy peer outside the ring goes for a newcomer; null where none may go.

    ``newcomers``: node, newcomer; without it, the column refused of ``roles``. The pick is a hash of the sorted peers and the newcomer, modulo the number of candidates. A node's peers are bounded by its own limit.
    """
    lists = roles.groupBy("node").agg(
        F.sort_array(F.collect_list("peer")).alias("known"),
        F.sort_array(F.collect_list(F.when((F.col("role") == "lazy") & ~F.col("is_ring"), F.col("peer")))).alias("free"),
        *([F.max("refused").alias("newcomer")] if newcomers is None else []),
    )
    lists = lists.filter("newcomer IS NOT NULL") if newcomers is None else newcomers.join(lists, "node")
    text = F.concat_ws(",", F.transform("known", lambda p: p.cast("string")), F.col("newcomer").cast("string"))
    digest = F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")
    n = F.size("free")
    pick = F.when(n > 0, F.try_element_at("free", (F.pmod(digest, F.greatest(n, F.lit(1))) + 1).cast("int")))
    return lists.select("node", "newcomer", pick.alias("evicted"))


def best_from(candidates: DataFrame, scores: DataFrame, initial: float, k: int) -> DataFrame:
    """node, peer, rank: the ``k`` best candidates of each node; those without a fresh score count with the initial one."""
    scored = candidates.join(scores.select("peer", "score"), "peer", "left").withColumn("score", F.coalesce("score", F.lit(initial)))
    r = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("score"), "peer"))
    return scored.withColumn("rank", r.cast("long")).filter(F.col("rank") <= k).select("node", "peer", "rank")


def missing_seeds(seeds: DataFrame, alive: DataFrame, key: str) -> DataFrame:
    """Seeds that are not alive."""
    return seeds.select(key).distinct().join(alive.select(key), key, "left_anti")
