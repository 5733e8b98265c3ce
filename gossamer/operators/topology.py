"""Hash rings of cluster members, their neighbours, hybrid scores, and reachability."""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gossamer.operators.lineage import cut


def ring_hash(column: str) -> Column:
    """A 60-bit hash that other engines can compute too: the head of a SHA-256."""
    return F.conv(F.substring(F.sha2(F.col(column).cast("string"), 256), 1, 15), 16, 10).cast("long")


def ring(peers: DataFrame) -> DataFrame:
    """cluster, node, pos, n: each member's place by (hash, id), and the ring's size."""
    by = Window.partitionBy("cluster")
    order = by.orderBy(ring_hash("node"), "node")
    return peers.select(
        "cluster", "node", (F.row_number().over(order) - 1).cast("long").alias("pos"), F.count("*").over(by).alias("n")
    )


def neighbours(placed: DataFrame) -> DataFrame:
    """cluster, node, kind, step, neighbour: adjacent, second nearest (n > 3), long range (n > 8)."""
    steps = F.concat(
        F.when(F.col("n") >= 2, F.array(F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>")).cast("array<bigint>"),
        F.when(F.col("n") > 3, F.array(F.lit(2), F.lit(-2))).otherwise(F.array().cast("array<int>")).cast("array<bigint>"),
        F.when(F.col("n") > 8, F.array(F.floor(F.col("n") / 4), -F.floor(F.col("n") / 4))).otherwise(F.array().cast("array<bigint>")),
    )
    wanted = placed.withColumn("at", F.explode(F.arrays_zip(F.sequence(F.lit(0), F.size(steps) - 1), steps)))
    kinds = F.when(F.col("at.0") < 2, "adjacent").when(F.col("at.0") < 4, "second").otherwise("long")
    asked = wanted.select("cluster", "node", kinds.alias("kind"), F.col("at.1").alias("step"), F.pmod(F.col("pos") + F.col("at.1"), F.col("n")).alias("pos"))
    there = placed.select("cluster", "pos", F.col("node").alias("neighbour"))
    return asked.join(there, ["cluster", "pos"]).select("cluster", "node", "kind", "step", "neighbour")


def ring_distance(a: Column, b: Column, n: Column) -> Column:
    return F.least(F.pmod(b - a, n), F.pmod(a - b, n))


#: Members of a cluster on each side of one block of pairs, and about as many pairs as a task should make.
BLOCK, TASK_PAIRS = 1_000, 4_000_000


def hybrid_scores(placed: DataFrame, scores: DataFrame) -> DataFrame:
    """cluster, node, peer, is_ring, score for every pair of one cluster: 0.4 nearness on the ring, 0.6 network score.

    The pairs grow with the square of a cluster; they are made in blocks of ``BLOCK`` by ``BLOCK`` members, dealt to as many tasks as
    they need. ``scores``: node, normalized. Where only the best or worst pairs count, ``candidates`` does without the others.
    """
    net = scores.select(F.col("node").alias("peer"), F.least(F.greatest("normalized", F.lit(0.0)), F.lit(1.0)).alias("net"))
    block = lambda c: F.floor(F.col(c) / BLOCK)
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / BLOCK)))
    mine = placed.select("cluster", "node", "pos", "n", block("pos").alias("mine"), blocks.alias("theirs"))
    other = placed.select("cluster", F.col("node").alias("peer"), F.col("pos").alias("peer_pos"), block("pos").alias("theirs"), "n").join(net, "peer", "left")
    other = other.select("cluster", "peer", "peer_pos", "net", "theirs", blocks.alias("mine"))
    pairs = placed.groupBy("cluster").agg(F.max("n").alias("n")).agg(F.sum(F.col("n").cast("double") * F.col("n"))).first()[0] or 0
    key = ["cluster", "mine", "theirs"]
    tasks = max(1, min(int(pairs / TASK_PAIRS) + 1, 50_000))
    d = ring_distance(F.col("pos"), F.col("peer_pos"), F.col("n"))
    near = F.when(F.col("n") > 1, F.least(F.greatest(1 - d / F.floor(F.col("n") / 2), F.lit(0.0)), F.lit(1.0))).otherwise(0.5)
    return (
        mine.repartition(tasks, *key)
        .join(other.repartition(tasks, *key), key)
        .filter("node <> peer")
        .select("cluster", "node", "peer", (d <= 2).alias("is_ring"), (0.4 * near + 0.6 * F.coalesce("net", F.lit(0.5))).alias("score"))
    )


#: Scores are ranked by 9 digits, so that those less than this apart may tie; peers kept beyond the wanted ones for such ties.
TIE, SPARE = 2e-9, 16


def _best(values: np.ndarray, length: int, keep: int) -> np.ndarray:
    """Places of the ``keep`` greatest values of each window of ``length`` that starts 3 after a place of the ring; ``values`` hold it twice.

    Windows of 1, 2, 4 .. places are merged from halves, and a window from those of its length's binary digits.
    """

    def merge(a, b):
        at = np.concatenate([a, b], axis=1)
        if at.shape[1] > keep:
            at = np.take_along_axis(at, np.argpartition(-values[at], keep - 1, axis=1)[:, :keep], axis=1)
        return at

    n = len(values) // 2
    values = np.append(values, -np.inf)  # what lies beyond the end
    level, start, width, found = np.arange(2 * n)[:, None], np.arange(n) + 3, 1, None
    while width <= length:
        if length & width:
            found = level[start] if found is None else merge(found, level[start])
            start = start + width
        level = merge(level, np.concatenate([level[width:], np.full((min(width, 2 * n), level.shape[1]), 2 * n)]))
        width *= 2
    return found


def _candidates(ring: pa.Table, k: int, lowest: bool) -> pa.Table:
    """The rows of ``candidates`` for one cluster."""
    ring = ring.sort_by("pos")
    n, pos, net = ring["n"][0].as_py(), ring["pos"].to_numpy(), ring["net"].to_numpy()
    codes = ring["node"].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy().astype(np.int64)
    sign, m, half = -1.0 if lowest else 1.0, len(pos), n // 2
    plain = m == n and len(np.unique(codes)) == m and codes.min() >= 0
    xs, ys, ss = [], [], []

    def scored(x, y):
        d = np.minimum((pos[y] - pos[x]) % n, (pos[x] - pos[y]) % n)
        near = np.minimum(np.maximum(1 - d / half, 0.0), 1.0) if n > 1 else np.full(d.shape, 0.5)
        fit = (codes[x] != codes[y]) & (codes[x] >= 0) & (codes[y] >= 0)
        return d, 0.4 * near + 0.6 * net[y], fit

    def add(x, y, s):
        xs.append(x), ys.append(y), ss.append(s)

    def scan(x, near_too):
        y = np.arange(m)
        d, s, fit = scored(x, y)
        away = fit & (d > 2)
        value = np.where(away, sign * s, -np.inf)
        least = np.partition(value, m - k)[m - k] if m > k else -np.inf
        chosen = (away & (value >= least - TIE)) | (fit & (d <= 2) & near_too)
        add(np.full(chosen.sum(), x), y[chosen], s[chosen])

    if not plain or n <= 4 * (k + SPARE):
        for x in range(m):
            scan(x, not lowest)
    else:
        x = np.arange(n)[:, None]
        if not lowest:
            y = (x + np.array([1, 2, n - 2, n - 1])) % n
            add(np.repeat(np.arange(n), 4), y.ravel(), scored(x, y)[1].ravel())
        if lowest or k > 4:  # else the four ring neighbours are all that is wanted
            keep, at = k + SPARE, np.arange(2 * n)
            tilt = 0.4 / half * at
            after = _best(sign * (0.6 * np.tile(net, 2) - tilt), half - 2, keep) % n
            before = n - 1 - _best(sign * (0.6 * np.tile(net[::-1], 2) - tilt), n - half - 3, keep)[::-1] % n
            y = np.concatenate([after, before], axis=1)
            s = scored(x, y)[1]
            value = sign * s
            bound = np.partition(value, 2 * keep - k, axis=1)[:, 2 * keep - k, None] - TIE
            # a side whose worst kept peer is out of the question has no further ones
            done = (value[:, :keep].min(axis=1) < bound[:, 0] - TIE) & (value[:, keep:].min(axis=1) < bound[:, 0] - TIE)
            row, column = np.nonzero((value >= bound) & done[:, None])
            add(row, y[row, column], s[row, column])
            for one in np.flatnonzero(~done):
                scan(one, False)
    x, y, s = (np.concatenate([np.zeros(0, t), *z]) for z, t in ((xs, np.int64), (ys, np.int64), (ss, np.float64)))
    d = np.minimum((pos[y] - pos[x]) % n, (pos[x] - pos[y]) % n)
    node = ring["node"].combine_chunks()
    cols = {"cluster": ring["cluster"].combine_chunks().take(pa.array(x)), "node": node.take(pa.array(x)), "peer": node.take(pa.array(y)), "is_ring": pa.array(d <= 2), "score": pa.array(s)}
    return pa.table(cols)


def candidates(placed: DataFrame, scores: DataFrame, k: int, lowest: bool = False) -> DataFrame:
    """The rows of ``hybrid_scores`` that may be among a node's ``k`` to promote or, ``lowest``, to demote, and few others.

    A score falls evenly with the distance on either side, so the best peers of a side are the greatest of a window of
    values that do not depend on the node: one task finds them for a whole ring in n log n steps and about 1 KB a member. A node
    with more ties than are kept is compared with its whole cluster.
    """
    net = scores.select("node", F.least(F.greatest("normalized", F.lit(0.0)), F.lit(1.0)).alias("net"))
    ring = placed.filter("cluster IS NOT NULL").join(net, "node", "left").select("cluster", "node", "pos", "n", F.coalesce("net", F.lit(0.5)).cast("double").alias("net"))
    kind = {f.name: f.dataType.simpleString() for f in placed.schema}
    out = f"cluster {kind['cluster']}, node {kind['node']}, peer {kind['node']}, is_ring boolean, score double"
    return ring.groupBy("cluster").applyInArrow(lambda t: _candidates(t, k, lowest), out)


def promote(candidates: DataFrame, k: int) -> DataFrame:
    """The ``k`` peers that a node should promote: ring neighbours first, then by score, ties by hash."""
    order = Window.partitionBy("node").orderBy(F.desc("is_ring"), F.desc(F.round("score", 9)), ring_hash("peer"))
    return candidates.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)


def demote(candidates: DataFrame, k: int) -> DataFrame:
    """The ``k`` peers that a node should demote: the lowest scores outside its ring neighbours."""
    order = Window.partitionBy("node").orderBy(F.round("score", 9), "peer")
    return candidates.filter(~F.col("is_ring")).withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)


def eager_edges(placed: DataFrame, fanout: int) -> DataFrame:
    """cluster, node, peer: predecessor, successor, their seconds, then long range, distinct, up to ``fanout``."""
    order = F.when(F.col("kind") == "adjacent", F.lit(0)).when(F.col("kind") == "second", 2).otherwise(4) + F.when(F.col("step") < 0, 0).otherwise(1)
    first = neighbours(placed).withColumn("o", order).groupBy("node", "neighbour").agg(F.min("o").alias("o"), F.min("cluster").alias("cluster"))
    w = Window.partitionBy("node").orderBy("o")
    return first.filter("node <> neighbour").withColumn("r", F.row_number().over(w)).filter(F.col("r") <= fanout).select("cluster", "node", F.col("neighbour").alias("peer"))


#: Edges that one task searches at a time; larger parts are searched round by round.
PART_EDGES = 2_000_000


def _search(part: pa.Table, limit: int | None) -> pa.Table:
    """node, round of one part: its edges (source, target), and its sources as targets of rows without a source."""
    ids = pa.chunked_array([*part["source"].chunks, *part["target"].chunks]).combine_chunks().dictionary_encode(null_encoding="encode")
    codes, n = ids.indices.to_numpy().astype(np.int64), len(ids.dictionary)
    begins = part["source"].is_null().to_numpy()
    source, target = codes[: len(begins)][~begins], codes[len(begins) :][~begins]
    order = np.argsort(source, kind="stable")
    first, to = np.searchsorted(source[order], np.arange(n + 1)).tolist(), target[order].tolist()
    queue, rounds = np.unique(codes[len(begins) :][begins]).tolist(), [-1] * n
    for node in queue:
        rounds[node] = 0
    for node in queue:  # which grows as it is read
        for peer in to[first[node] : first[node + 1]]:
            if rounds[peer] < 0:
                rounds[peer] = rounds[node] + 1
                queue.append(peer)
    if limit is not None and queue and rounds[queue[-1]] > limit:
        raise RuntimeError(f"nodes are still reached after {limit} rounds")
    return pa.table({"node": ids.dictionary.take(pa.array(queue, pa.int64())), "round": pa.array([rounds[x] for x in queue], pa.int64())})


def _unfit(edges: DataFrame, sources: DataFrame, part: str) -> DataFrame:
    """The parts that no one task can search: those of too many edges, and those that share a node with another."""
    large = edges.groupBy(part).count().filter(F.col("count") > PART_EDGES).select(part)
    held = edges.select(part, F.explode(F.array("node", "peer")).alias("node")).union(sources.select(part, "node")).distinct()
    shared = held.withColumns({"low": F.min(part).over(Window.partitionBy("node")), "high": F.max(part).over(Window.partitionBy("node"))})
    return large.union(shared.filter("low <> high").select(part)).distinct()


def bfs_rounds(edges: DataFrame, sources: DataFrame, rounds: int | None = None, part: str | None = None) -> DataFrame:
    """node, round: the round in which a message from ``sources`` first reaches each node.

    Where ``edges`` and ``sources`` have a column ``part``, whose values no edge crosses, each part is searched whole by one task,
    however many rounds it takes. Parts of over ``PART_EDGES`` edges, those that share nodes, and edges without parts go round by round:
    a frontier is joined with the edges and what is reached is taken out, until no node is new. ``rounds`` is a guard: where nodes are
    left after so many, an error is raised.
    """
    if part is not None:
        unfit = _unfit(edges, sources, part)
        some = unfit.limit(1).count()
        fit = [df.join(unfit, part, "left_anti") if some else df for df in (edges, sources)]
        node = edges.schema["node"].dataType
        rows = fit[0].filter("node IS NOT NULL AND peer IS NOT NULL").select(part, F.col("node").alias("source"), F.col("peer").alias("target"))
        rows = rows.union(fit[1].select(part, F.lit(None).cast(node).alias("source"), F.col("node").cast(node).alias("target")))
        found = rows.groupBy(part).applyInArrow(lambda t: _search(t, rounds), f"node {node.simpleString()}, round bigint")
        return found.union(bfs_rounds(edges.join(unfit, part, "left_semi"), sources.join(unfit, part, "left_semi"), rounds)) if some else found
    reached = sources.select("node", F.lit(0).cast("long").alias("round")).distinct()
    frontier = reached
    for k in count(1):
        arrived = frontier.select("node").join(edges, "node").select(F.col("peer").alias("node")).distinct()
        frontier = arrived.join(reached, "node", "left_anti").withColumn("round", F.lit(k).cast("long"))
        frontier = cut(frontier)
        if not frontier.limit(1).count():
            return reached
        if rounds is not None and k > rounds:
            raise RuntimeError(f"nodes are still reached after {rounds} rounds")
        reached = reached.union(frontier)
        if k % 4 == 0:
            reached = cut(reached)


def nearest_lazy(placed: DataFrame, eager: DataFrame, fanout: int) -> DataFrame:
    """node, peer: the nearest peer on the ring that is not eager, predecessors before successors.

    A node has ``fanout`` eager peers at most, so one of its ``fanout`` + 1 nearest on either side is lazy: no pairs are made.
    """
    steps = F.array(*[F.struct(F.lit(k).alias("offset"), F.lit(side).alias("side")) for k in range(1, fanout + 2) for side in (0, 1)])
    asked = placed.select("cluster", "node", "pos", "n", F.explode(steps).alias("at"))
    place = F.pmod(F.col("pos") + F.when(F.col("at.side") == 0, -F.col("at.offset")).otherwise(F.col("at.offset")), F.col("n"))
    there = placed.select("cluster", F.col("pos").alias("place"), F.col("node").alias("peer"))
    near = asked.select("cluster", "node", "at", place.alias("place")).join(there, ["cluster", "place"]).filter("node <> peer")
    return near.join(eager, ["node", "peer"], "left_anti").groupBy("node").agg(F.min_by("peer", "at").alias("peer"))


def peer_counts(placed: DataFrame, eager: DataFrame, target: int) -> DataFrame:
    """node, eager, lazy, total, eager_ratio, sufficient (as many eager peers as the target or all)."""
    held = eager.groupBy("node").agg(F.count("*").alias("eager"))
    out = placed.select("node", (F.col("n") - 1).alias("total")).join(held, "node", "left").withColumn("eager", F.coalesce("eager", F.lit(0)))
    return out.select(
        "node", "eager", (F.col("total") - F.col("eager")).alias("lazy"), "total",
        F.round(F.coalesce(F.try_divide("eager", "total"), F.lit(0.0)), 6).alias("eager_ratio"),
        (F.col("eager") >= F.least(F.lit(target), "total")).alias("sufficient"),
    )
