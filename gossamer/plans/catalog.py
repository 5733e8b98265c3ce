"""The registered queries of the dissemination operators, each with the SQL that checks it."""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gossamer import bindings as B
from gossamer.functions import codec, compression
from gossamer.operators import caching, chaos, delivery, monitoring, queueing, scoring, store, topology, tuning
from gossamer.sources import text
from gossamer.streaming import live

#: Clock of the time-dependent queries: 2024-02-01 in ms.
AS_OF = 1_706_745_600_000
HOUR = 3_600_000
DAY = 24 * HOUR

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


M, S, R, P, Q = B.MESSAGES_SQL, B.STORED_SQL, B.REPLICAS_SQL, B.PEERS_SQL, B.QUEUE_SQL


# -- delivery ------------------------------------------------------------


@query(f"WITH {M} SELECT node, msg_id, ts, seq, row_number() OVER (PARTITION BY node, msg_id ORDER BY ts, seq) AS receive_count FROM messages")
def dedup_receive_count(spark: SparkSession, d: str) -> DataFrame:
    return delivery.receive_count(B.messages(spark, d)).select("node", "msg_id", "ts", "seq", "receive_count")


@query(f"""WITH {M}, c AS (SELECT node, msg_id, count(*) AS n FROM messages GROUP BY ALL)
SELECT node, count(*) AS delivered, CAST(sum(n) - count(*) AS BIGINT) AS duplicates,
  round((sum(n) - count(*)) / count(*), 6) AS ratio FROM c GROUP BY node""")
def duplicate_ratio_by_node(spark, d):
    return delivery.duplicate_ratio(B.messages(spark, d))


@query(f"WITH {M} SELECT node, msg_id, arg_min(seq, (ts, seq)) AS parent FROM messages GROUP BY node, msg_id")
def tree_parent(spark, d):
    return delivery.tree_parent(B.messages(spark, d), "seq")


@query(f"""WITH {M}, c AS (SELECT *, row_number() OVER (PARTITION BY node, msg_id ORDER BY ts, seq) AS receive_count FROM messages)
SELECT node, msg_id, seq, receive_count FROM c WHERE receive_count > 1""")
def prune_triggers(spark, d):
    return delivery.prune_triggers(B.messages(spark, d), 1).select("node", "msg_id", "seq", "receive_count")


@query(f"""WITH RECURSIVE {M},
o AS (SELECT node, msg_id, ts, seq, row_number() OVER (PARTITION BY node, msg_id ORDER BY ts, seq) AS k FROM messages),
f AS (
  SELECT node, msg_id, ts, seq, k, ts AS held, true AS taken FROM o WHERE k = 1
  UNION ALL
  SELECT o.node, o.msg_id, o.ts, o.seq, o.k, CASE WHEN o.ts - f.held > {3 * DAY} THEN o.ts ELSE f.held END, o.ts - f.held > {3 * DAY}
  FROM f JOIN o ON o.node = f.node AND o.msg_id = f.msg_id AND o.k = f.k + 1
)
SELECT node, msg_id, ts, seq FROM f WHERE taken""")
def seen_ttl_delivered(spark, d):
    return delivery.seen_ttl(B.messages(spark, d), 3 * DAY)


@query(f"""WITH {M}, n AS (SELECT count(DISTINCT node) AS n FROM messages)
SELECT msg_id, count(*) AS copies, round(count(*) / (max(n.n) - 1) - 1, 6) AS rmr FROM messages, n GROUP BY msg_id""")
def redundancy_rmr(spark, d):
    m = B.messages(spark, d)
    return delivery.redundancy(m, m.agg(F.count_distinct("node")).first()[0])


@query(f"""WITH {M} SELECT node, count(*) FILTER (kind = 'view') AS gossip, count(*) FILTER (kind IN ('click', 'signup', 'error')) AS control,
  CASE WHEN count(*) FILTER (kind = 'view') = 0 THEN 0.0
    ELSE round(count(*) FILTER (kind IN ('click', 'signup', 'error')) / count(*) FILTER (kind = 'view'), 6) END AS overhead
FROM messages GROUP BY node""")
def control_overhead(spark, d):
    return delivery.control_overhead(B.messages(spark, d), B.KIND)


@query(f"""WITH {M}, online AS (SELECT DISTINCT node FROM messages WHERE node % 3 <> 0)
SELECT msg_id, count(DISTINCT node) AS reached, (SELECT count(*) FROM online) - count(DISTINCT node) AS missing
FROM messages SEMI JOIN online USING (node) GROUP BY msg_id""")
def coverage_online(spark, d):
    m = B.messages(spark, d)
    return delivery.coverage(m, m.select("node").distinct().filter("node % 3 <> 0"))


@query(f"""WITH {M}, f AS (SELECT msg_id, node, min((ts, seq)) AS arrived FROM messages GROUP BY msg_id, node),
h AS (SELECT msg_id, CAST(floor(log2(row_number() OVER (PARTITION BY msg_id ORDER BY arrived))) AS BIGINT) AS hops FROM f)
SELECT msg_id, max(hops) AS last_hop, round(avg(hops), 6) AS mean_hops FROM h GROUP BY msg_id""")
def last_delivery_hop(spark, d):
    return delivery.last_hop(B.messages(spark, d))


@query(f"""WITH {M}, subs AS (SELECT DISTINCT node FROM messages WHERE node % 5 = 0)
SELECT kind, count(*) FILTER (subs.node IS NOT NULL) AS delivered, count(*) FILTER (subs.node IS NULL) AS filtered
FROM messages LEFT JOIN subs USING (node) GROUP BY kind""")
def topic_filter(spark, d):
    m = B.messages(spark, d)
    subscribed = F.col("node") % 5 == 0
    return m.groupBy("kind").agg(F.count_if(subscribed).alias("delivered"), F.count_if(~subscribed).alias("filtered"))


# -- stores --------------------------------------------------------------


@query(f"""WITH {S}, r AS (SELECT * FROM stored WHERE ts BETWEEN 100 AND 900 ORDER BY ts, id LIMIT 51 OFFSET 20)
SELECT id, ts, round, row_number() OVER (ORDER BY ts, id) AS row, (SELECT count(*) FROM r) > 50 AS has_more, (SELECT count(*) FROM stored) AS total
FROM r QUALIFY row <= 50""")
def store_range_page(spark, d):
    """A page of the feature's own limit: 50 rows from the 21st of a range."""
    return store.range_page(B.stored(spark, d).drop("payload"), 100, 900, 50, 20).withColumn("row", F.col("row").cast("long"))


@query(f"WITH {S} SELECT id, ts, round FROM stored WHERE ts >= 250")
def store_prune(spark, d):
    return store.prune(B.stored(spark, d), 250).select("id", "ts", "round")


@query(f"""WITH {S}, b AS (SELECT id, ts // 16 AS bucket FROM stored), n AS (SELECT bucket, count(*) AS n FROM b GROUP BY bucket),
k AS (SELECT bucket FROM n QUALIFY sum(n) OVER (ORDER BY bucket DESC) <= 600)
SELECT id, bucket FROM b SEMI JOIN k USING (bucket)""")
def store_capacity_evict(spark, d):
    s = B.stored(spark, d).select("id", F.floor(F.col("ts") / 16).alias("bucket"))
    return store.evict_to_capacity(s, "bucket", 600).select("id", "bucket")


@query(f"WITH {M} SELECT msg_id AS id, min(ts) AS ts, arg_min(node, (ts, seq)) AS node FROM messages GROUP BY msg_id")
def store_first_wins(spark, d):
    m = B.messages(spark, d).withColumnRenamed("msg_id", "id").select("id", "ts", "seq", "node")
    return store.first_wins(m, "ts", "seq").select("id", "ts", "node")


@query(f"WITH {M} SELECT DISTINCT a.node, a.payload FROM messages a WHERE kind = 'click' AND NOT EXISTS (SELECT 1 FROM messages b WHERE b.kind = 'view' AND b.node = a.node AND b.payload = a.payload)")
def ihave_missing(spark, d):
    m = B.messages(spark, d)
    announced = m.filter("kind = 'click'").select("node", "payload").distinct()
    return store.missing(announced, m.filter("kind = 'view'"), "node", "payload")


@query(f"WITH {R} SELECT id, 'a' AS side FROM a ANTI JOIN b USING (id) UNION ALL SELECT id, 'b' AS side FROM b ANTI JOIN a USING (id)")
def sync_anti_entropy(spark, d):
    return store.anti_entropy(B.replica(spark, d, 3), B.replica(spark, d, 7), 100)


@query(f"WITH {R} SELECT b.id, b.ts, b.round FROM b ANTI JOIN a USING (id)")
def sync_pull(spark, d):
    a, b = B.replica(spark, d, 3), B.replica(spark, d, 7)
    return store.pull(store.missing(b, a, "id").select("id"), b).select("id", "ts", "round")


_LANES = ", ".join(f"bit_xor(('0x' || substr(h, {1 + 8 * i}, 8))::BIGINT) AS lane{i}" for i in range(8))


@query(f"WITH {S}, l AS (SELECT round, sha256(id || ':' || payload) AS h FROM stored) SELECT round, count(*) AS n, {_LANES} FROM l GROUP BY round")
def xor_digest(spark, d):
    return store.digest_lanes(B.stored(spark, d), "round")


@query(f"""WITH {R}, x AS (SELECT ts // 100 AS w, sha256(id || ':' || payload) AS h FROM a), y AS (SELECT ts // 100 AS w, sha256(id || ':' || payload) AS h FROM b),
dx AS (SELECT w, count(*) AS n, {_LANES} FROM x GROUP BY w), dy AS (SELECT w, count(*) AS n, {_LANES} FROM y GROUP BY w)
SELECT coalesce(dx.w, dy.w) AS window, coalesce(dx.n, 0) AS n_a, coalesce(dy.n, 0) AS n_b FROM dx FULL JOIN dy ON dx.w = dy.w
WHERE {" OR ".join(f"dx.lane{i} IS DISTINCT FROM dy.lane{i}" for i in range(8))}""")
def digest_differing_windows(spark, d):
    return store.windowed_digests(B.replica(spark, d, 3), B.replica(spark, d, 7), 100)


# -- scores --------------------------------------------------------------


#: The default preset with its times stretched to the days that the tables cover.
PRESET = replace(scoring.DEFAULT, half_life_ms=DAY, max_age_ms=7 * DAY)


def _samples(spark, d):
    return B.messages(spark, d).select(F.col("node").alias("peer"), "ts", "seq", F.col("value").alias("rtt"), (F.col("kind") == "error").alias("failed"))


def _scores(spark, d):
    return scoring.peer_scores(_samples(spark, d), AS_OF, PRESET)


_SCORES = f"""{M}, g AS (
  SELECT node AS peer, list(greatest(value, {scoring.LEAST_RTT}) ORDER BY ts, seq) FILTER (kind <> 'error') AS o,
    coalesce(sum(exp({-math.log(2) / PRESET.half_life_ms!r} * ({AS_OF} - ts))) FILTER (kind = 'error'), 0) AS failures,
    max(ts) FILTER (kind <> 'error') AS last
  FROM messages GROUP BY node
),
f AS (SELECT * REPLACE (CASE WHEN failures < {scoring.LEAST_FAILURES} THEN 0 ELSE failures END AS failures) FROM g),
e AS (SELECT peer, list_reduce(o, lambda a, x: {PRESET.alpha} * x + {1 - PRESET.alpha} * a) AS ema, list_min(o) AS lowest, list_max(o) AS highest,
  len(o) AS samples, failures, last, coalesce(failures / nullif(len(o) + failures, 0), 0) AS loss FROM f),
scores AS (SELECT *, 1000 / pow(greatest(ema, {scoring.LEAST_RTT}) + {PRESET.floor_ms}, {PRESET.exponent}) / (1 + loss * {PRESET.penalty}) AS score FROM e)"""


@query(f"WITH {_SCORES} SELECT peer, round(ema, 6) AS ema, lowest, highest, samples, round(failures, 6) AS failures, round(loss, 6) AS loss, round(score, 6) AS score FROM scores")
def peer_scores(spark, d):
    r = lambda c: F.round(c, 6).alias(c)
    return _scores(spark, d).select("peer", r("ema"), "lowest", "highest", "samples", r("failures"), r("loss"), r("score"))


@query(f"""WITH {_SCORES} SELECT count(*) AS peers, count(*) FILTER (samples >= {PRESET.min_samples}) AS reliable,
  count(*) FILTER ({AS_OF} - last > {PRESET.max_age_ms}) AS stale, round(avg(ema), 6) AS mean_rtt, round(avg(score), 6) AS mean_score FROM scores""")
def scoring_stats(spark, d):
    return scoring.stats(_scores(spark, d), AS_OF, PRESET)


@query(f"WITH {_SCORES} SELECT peer, round(score, 6) AS score FROM scores WHERE {AS_OF} - last <= {PRESET.max_age_ms} ORDER BY scores.score DESC, peer LIMIT 10")
def best_peers(spark, d):
    """Top-k: ten is the feature."""
    return scoring.best(_scores(spark, d), AS_OF, 10, preset=PRESET).select("peer", F.round("score", 6).alias("score"))


@query(f"WITH {_SCORES} SELECT peer, round(score, 6) AS score FROM scores WHERE {AS_OF} - last <= {PRESET.max_age_ms} ORDER BY scores.score, peer LIMIT 10")
def worst_peers(spark, d):
    """Top-k: ten is the feature."""
    return scoring.best(_scores(spark, d), AS_OF, 10, worst=True, preset=PRESET).select("peer", F.round("score", 6).alias("score"))


@query(f"WITH {_SCORES} SELECT peer, round(CASE WHEN {AS_OF} - last <= {PRESET.max_age_ms} THEN coalesce(score / (score + 10), 0.5) ELSE 0.5 END, 6) AS normalized FROM scores")
def normalized_scores(spark, d):
    return scoring.normalized(_scores(spark, d), AS_OF, preset=PRESET).select("peer", F.round("normalized", 6).alias("normalized"))


@query(f"""WITH RECURSIVE {M}, o AS (SELECT node, ts, row_number() OVER (PARTITION BY node ORDER BY ts, seq) AS k FROM messages),
f AS (
  SELECT node, ts, k, 1.0::DOUBLE AS tokens, true AS ok FROM o WHERE k = 1
  UNION ALL
  SELECT node, ts, k, CASE WHEN have >= 1 THEN have - 1 ELSE have END, have >= 1
  FROM (SELECT o.node, o.ts, o.k, least(2.0::DOUBLE, f.tokens + (o.ts - f.ts) / 1000 * 0.00001::DOUBLE) AS have FROM f JOIN o ON o.node = f.node AND o.k = f.k + 1)
)
SELECT node, count(*) FILTER (ok) AS allowed, count(*) FILTER (NOT ok) AS denied FROM f GROUP BY node""")
def token_bucket(spark, d):
    return scoring.token_bucket(B.messages(spark, d), "node", 0.00001, 2.0)


# -- rings ---------------------------------------------------------------

_RING = f"""{P}, ring AS (
  SELECT cluster, node, row_number() OVER (PARTITION BY cluster ORDER BY ('0x' || substr(sha256(node::VARCHAR), 1, 15))::BIGINT, node) - 1 AS pos,
    count(*) OVER (PARTITION BY cluster) AS n FROM peers)"""
_NEAR = f"""{_RING}, steps AS (
  SELECT *, unnest([1, -1]) AS step, 'adjacent' AS kind FROM ring WHERE n >= 2
  UNION ALL SELECT *, unnest([2, -2]) AS step, 'second' AS kind FROM ring WHERE n > 3
  UNION ALL SELECT *, unnest([n // 4, -(n // 4)]) AS step, 'long' AS kind FROM ring WHERE n > 8),
near AS (SELECT s.cluster, s.node, s.kind, CAST(s.step AS BIGINT) AS step, r.node AS neighbour FROM steps s JOIN ring r ON r.cluster = s.cluster AND r.pos = ((s.pos + s.step) % s.n + s.n) % s.n)"""


@query(f"WITH {_RING} SELECT cluster, node, pos, n FROM ring")
def ring_order(spark, d):
    return topology.ring(B.peers(spark, d))


@query(f"WITH {_NEAR} SELECT cluster, node, kind, step, neighbour FROM near")
def ring_neighbours(spark, d):
    return topology.neighbours(topology.ring(B.peers(spark, d)))


def _scored_ring(spark, d):
    scores = B.peers(spark, d).select("node", (F.col("node") % 11 / 10).alias("normalized")).distinct()
    return topology.ring(B.peers(spark, d)), scores


_HYBRID = f"""{_RING}, pairs AS (
  SELECT x.cluster, x.node, y.node AS peer, x.n, least(((y.pos - x.pos) % x.n + x.n) % x.n, ((x.pos - y.pos) % x.n + x.n) % x.n) AS d FROM ring x JOIN ring y USING (cluster) WHERE x.node <> y.node),
hybrid AS (SELECT cluster, node, peer, d <= 2 AS is_ring, 0.4 * greatest(least(1 - d / (n // 2), 1.0), 0.0) + 0.6 * least(peer % 11 / 10, 1.0) AS score FROM pairs)"""


@query(f"WITH {_HYBRID} SELECT cluster, node, peer, is_ring, round(score, 6) AS score FROM hybrid")
def hybrid_score(spark, d):
    return topology.hybrid_scores(*_scored_ring(spark, d)).withColumn("score", F.round("score", 6))


_HASH = "('0x' || substr(sha256(peer::VARCHAR), 1, 15))::BIGINT"


@query(f"WITH {_HYBRID} SELECT node, peer, row_number() OVER (PARTITION BY node ORDER BY is_ring DESC, round(score, 9) DESC, {_HASH}) AS rank FROM hybrid QUALIFY rank <= 3")
def promote_topk(spark, d):
    return topology.promote(topology.candidates(*_scored_ring(spark, d), 3), 3).select("node", "peer", "rank")


@query(f"WITH {_HYBRID} SELECT node, peer, row_number() OVER (PARTITION BY node ORDER BY round(score, 9), peer) AS rank FROM hybrid WHERE NOT is_ring QUALIFY rank <= 2")
def demote_bottomk(spark, d):
    return topology.demote(topology.candidates(*_scored_ring(spark, d), 2, lowest=True), 2).select("node", "peer", "rank")


_EDGES = f"""{_NEAR}, o AS (SELECT node, neighbour, min(CASE kind WHEN 'adjacent' THEN 0 WHEN 'second' THEN 2 ELSE 4 END + CASE WHEN step < 0 THEN 0 ELSE 1 END) AS o
  FROM near WHERE node <> neighbour GROUP BY node, neighbour),
edges AS (SELECT node, neighbour AS peer FROM o QUALIFY row_number() OVER (PARTITION BY node ORDER BY o) <= 2)"""


@query(f"WITH {_EDGES} SELECT node, peer FROM edges")
def eager_topology(spark, d):
    return topology.eager_edges(topology.ring(B.peers(spark, d)), 2).select("node", "peer")


@query(f"""WITH RECURSIVE {_EDGES}, first AS (SELECT min(node) AS node FROM ring GROUP BY cluster),
walk(node, round) USING KEY (node) AS (
  SELECT node, 0 FROM first
  UNION
  SELECT e.peer, min(w.round) + 1 FROM walk w JOIN edges e ON e.node = w.node LEFT JOIN recurring.walk r ON r.node = e.peer WHERE r.node IS NULL GROUP BY e.peer
)
SELECT node, CAST(round AS BIGINT) AS round FROM walk""")
def dissemination_rounds(spark, d):
    placed = topology.ring(B.peers(spark, d))
    return topology.bfs_rounds(topology.eager_edges(placed, 2), placed.groupBy("cluster").agg(F.min("node").alias("node")), part="cluster")


# -- queues --------------------------------------------------------------


@query(f"""WITH {Q} SELECT queue, class, item, row_number() OVER (PARTITION BY queue, class ORDER BY d, item) AS place FROM items
QUALIFY place <= CASE class WHEN 0 THEN 64 WHEN 1 THEN 256 WHEN 2 THEN 512 ELSE 128 END""")
def queue_bounded_push(spark, d):
    return queueing.bounded_push(B.queue_items(spark, d)).select("queue", "class", "item", "place")


@query(f"WITH {Q} SELECT queue, class, item, row_number() OVER (PARTITION BY queue ORDER BY class, d, item) AS place FROM items QUALIFY place <= 100")
def queue_strict_pop(spark, d):
    return queueing.strict_pop(B.queue_items(spark, d), 100).select("queue", "class", "item", "place")


@query(f"""WITH {Q}, p AS (SELECT *, row_number() OVER (PARTITION BY queue, class ORDER BY d, item) <= CASE class WHEN 0 THEN 16 WHEN 1 THEN 8 WHEN 2 THEN 4 ELSE 2 END AS by_quota FROM items)
SELECT queue, class, item, by_quota, row_number() OVER (PARTITION BY queue ORDER BY by_quota DESC, class, d, item) AS place FROM p QUALIFY place <= 30""")
def queue_quota_pop(spark, d):
    return queueing.quota_pop(B.queue_items(spark, d), 30).select("queue", "class", "item", "by_quota", "place")


@query(f"""WITH {M}, b AS (SELECT node, ts, (row_number() OVER (PARTITION BY node ORDER BY ts, seq) - 1) // 16 AS batch FROM messages WHERE kind = 'click')
SELECT node, batch, count(*) AS n, min(ts) AS first, max(ts) AS last FROM b GROUP BY node, batch""")
def ihave_batches(spark, d):
    return queueing.fifo_batches(B.messages(spark, d).filter("kind = 'click'"), "node", 16)


@query(f"""WITH {M}, t AS (SELECT node, seq, ts, unnest(range(1, 6)) AS attempt FROM messages WHERE kind = 'signup'),
y AS (SELECT *, CAST(least(500 * pow(2, attempt - 1), 5000) AS BIGINT) AS delay FROM t)
SELECT node, seq, ts, attempt, delay, CAST(ts + sum(delay) OVER (PARTITION BY node, seq ORDER BY attempt) AS BIGINT) AS due FROM y""")
def graft_backoff(spark, d):
    return queueing.backoff_schedule(B.messages(spark, d).filter("kind = 'signup'").select("node", "seq", "ts"), 500, 5000, 5)


@query(f"""WITH {M}, e AS (SELECT node, ts AS t, 1 AS d FROM messages UNION ALL SELECT node, ts + CAST(floor(value * 60000) AS BIGINT), -1 FROM messages),
c AS (SELECT node, sum(d) OVER (PARTITION BY node ORDER BY t, d ROWS UNBOUNDED PRECEDING) AS active FROM e)
SELECT node, CAST(max(active) AS BIGINT) AS peak FROM c GROUP BY node""")
def peak_concurrency(spark, d):
    m = B.messages(spark, d).withColumn("duration", F.floor(F.col("value") * 60000))
    return queueing.peak_concurrency(m, "node")


# -- monitoring ----------------------------------------------------------


@query(f"WITH {M} SELECT kind, ts // {HOUR} * {HOUR} AS bucket, count(*) AS n, round(count(*) * 1000 / {HOUR}, 6) AS per_s FROM messages GROUP BY ALL")
def rate_hourly(spark, d):
    return monitoring.tumbling_counts(B.messages(spark, d), HOUR, "kind")


@query(f"""WITH {M}, c AS (SELECT kind, ts // {HOUR} * {HOUR} AS bucket, count(*) AS n FROM messages GROUP BY ALL)
SELECT kind, bucket, n, round((n + CASE WHEN lag(bucket) OVER w = bucket - {HOUR} THEN lag(n) OVER w ELSE 0 END) * 1000 / {2 * HOUR}, 6) AS rate
FROM c WINDOW w AS (PARTITION BY kind ORDER BY bucket)""")
def rate_two_buckets(spark, d):
    return monitoring.two_bucket_rate(monitoring.tumbling_counts(B.messages(spark, d), HOUR, "kind").drop("per_s"), HOUR, "kind")


_BOUNDS = [5.0, 10.0, 25.0, 50.0, 100.0, 250.0]
_HIST = f"""{M}, h AS (SELECT kind, unnest({[*_BOUNDS]} || ['inf'::DOUBLE]) AS le, unnest([{", ".join(f"count(*) FILTER (value <= {b})" for b in _BOUNDS)}, count(value)]) AS n FROM messages GROUP BY kind)"""


@query(f"WITH {_HIST} SELECT kind, le, n FROM h WHERE le < 'inf'::DOUBLE")
def histogram_buckets(spark, d):
    return monitoring.histogram(B.messages(spark, d), "value", _BOUNDS, "kind").filter(F.col("le") < float("inf"))


@query(f"""WITH {_HIST}, r AS (SELECT *, 0.95 * max(n) OVER (PARTITION BY kind) AS rank, coalesce(lag(le) OVER w, 0) AS lower, coalesce(lag(n) OVER w, 0) AS below FROM h WINDOW w AS (PARTITION BY kind ORDER BY le))
SELECT kind, round(CASE WHEN le = 'inf'::DOUBLE THEN lower ELSE lower + (le - lower) * (rank - below) / (n - below) END, 6) AS quantile FROM r WHERE n >= rank AND below < rank""")
def histogram_p95(spark, d):
    return monitoring.histogram_quantile(monitoring.histogram(B.messages(spark, d), "value", _BOUNDS, "kind"), 0.95, "kind")


@query(f"""WITH {M}, c AS (SELECT kind, ts // {HOUR} * {HOUR} AS bucket, count(*) AS n FROM messages GROUP BY ALL),
i AS (SELECT *, bucket - row_number() OVER (PARTITION BY kind ORDER BY bucket) * {HOUR} AS island FROM c WHERE n >= 3)
SELECT kind, min(bucket) AS first, max(bucket) AS last, count(*) AS buckets FROM i GROUP BY kind, island HAVING count(*) >= 2""")
def alert_islands(spark, d):
    counts = monitoring.tumbling_counts(B.messages(spark, d), HOUR, "kind")
    return monitoring.alert_islands(counts, F.col("n") >= 3, HOUR, 2, "kind")


_HEALTH = """SELECT node, count(DISTINCT msg_id) AS peers, count(*) FILTER (kind = 'view') AS eager,
  round(count(*) FILTER (kind = 'error') / count(*), 6) AS failure_rate, count(*) FILTER (kind = 'click') AS pending, avg(value) / 500 AS cache_use FROM messages GROUP BY node"""


@query(f"""WITH {M}, h AS ({_HEALTH}) SELECT node, peers, eager, failure_rate, pending,
  CASE WHEN peers = 0 OR failure_rate > 0.8 THEN 'unhealthy' WHEN eager = 0 OR failure_rate > 0.3 OR pending > 50 OR cache_use > 0.95 OR peers < 3 THEN 'degraded' ELSE 'healthy' END AS status FROM h""")
def health_status(spark, d):
    m = B.messages(spark, d)
    nodes = m.groupBy("node").agg(
        F.count_distinct("msg_id").alias("peers"),
        F.count_if(F.col("kind") == "view").alias("eager"),
        F.round(F.count_if(F.col("kind") == "error") / F.count("*"), 6).alias("failure_rate"),
        F.count_if(F.col("kind") == "click").alias("pending"),
        (F.avg("value") / 500).alias("cache_use"),
        F.lit(False).alias("shutdown"),
    )
    return monitoring.health(nodes).select("node", "peers", "eager", "failure_rate", "pending", "status")


# -- wire ----------------------------------------------------------------

_HEX = lambda c, n: f"lower(lpad(to_hex({c}), {2 * n}, '0'))"


def _frames(spark, d):
    m = B.messages(spark, d)
    kind = F.create_map(*[F.lit(x) for pair in B.KIND.items() for x in pair])[F.col("kind")]
    framed = m.withColumn("k", kind).filter("k <> 'sync'")
    return framed.withColumn("frame", codec.encode_message(F.col("k"), codec.encode_id(F.col("ts"), F.col("seq"), F.col("node")), F.col("seq") % 8, F.col("payload")))


@query(f"""WITH {M}, i AS (SELECT *, {_HEX('ts', 8)} || {_HEX('seq', 8)} || {_HEX('node', 8)} AS id FROM messages WHERE kind <> 'purchase')
SELECT seq, CASE kind WHEN 'view' THEN '01' || id || {_HEX('seq % 8', 4)} || {_HEX('octet_length(encode(payload))', 4)} || lower(hex(encode(payload)))
  WHEN 'click' THEN '02' || {_HEX('seq % 8', 4)} || '0001' || id WHEN 'signup' THEN '03' || id || {_HEX('seq % 8', 4)} ELSE '04' END AS frame FROM i""")
def codec_encode(spark, d):
    return _frames(spark, d).select("seq", "frame")


@query(f"""WITH {M} SELECT seq, CASE kind WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS tag,
  CASE WHEN kind <> 'error' THEN ts END AS ts, CASE WHEN kind <> 'error' THEN seq END AS counter, CASE WHEN kind <> 'error' THEN node END AS rnd,
  CASE WHEN kind <> 'error' THEN seq % 8 END AS round, CASE WHEN kind = 'view' THEN payload END AS payload FROM messages WHERE kind <> 'purchase'""")
def codec_roundtrip(spark, d):
    x = _frames(spark, d).select("seq", codec.decode_message(F.col("frame")).alias("x"))
    return x.select("seq", F.col("x.tag").cast("int").alias("tag"), "x.ts", "x.counter", "x.rnd", "x.round", "x.payload")


@query(f"""WITH {M} SELECT kind, count(*) AS n, CAST(sum(CASE kind WHEN 'view' THEN 33 + octet_length(encode(payload)) WHEN 'click' THEN 31 WHEN 'signup' THEN 29 ELSE 1 END) AS BIGINT) AS bytes
FROM messages WHERE kind <> 'purchase' GROUP BY kind""")
def codec_lengths(spark, d):
    f = _frames(spark, d).withColumn("len", codec.encoded_length(F.col("k"), F.col("payload"), F.lit(1)))
    return f.groupBy("kind").agg(F.count("*").alias("n"), F.sum("len").alias("bytes"))


@query(f"WITH {M} SELECT seq, {_HEX('ts & 4294967295', 4)} || {_HEX('seq & 65535', 2)} || {_HEX('node & 65535', 2)} AS label FROM messages")
def id_labels(spark, d):
    return B.messages(spark, d).select("seq", codec.short_id(F.col("ts"), F.col("seq"), F.col("node")).alias("label"))


# -- faults --------------------------------------------------------------

_DRAW = "('0x' || substr(sha256('seed' || ':' || seq), 1, 8))::BIGINT / 4294967296"


@query(f"WITH {M} SELECT seq, node FROM messages WHERE {_DRAW} >= 0.1")
def chaos_loss(spark, d):
    return chaos.drop(B.messages(spark, d), "seq", 0.1, "seed").select("seq", "node")


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, s_nationkey AS src, c_nationkey AS dst FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
n AS (SELECT n_nationkey AS k, n_regionkey % 2 AS side FROM nation)
SELECT l.* FROM l JOIN n x ON l.src = x.k JOIN n y ON l.dst = y.k WHERE x.side = y.side""")
def chaos_split_brain(spark, d):
    t = lambda n: B.table(spark, d, n)
    sent = (
        t("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
        .join(t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("src")), "l_suppkey")
        .join(t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
        .join(t("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("dst")), "o_custkey")
    )
    sides = t("nation").select(F.col("n_nationkey").alias("node"), (F.col("n_regionkey") % 2).alias("side"))
    return chaos.block(sent, chaos.split_brain(sides)).select("l_orderkey", "l_linenumber", "src", "dst")


@query(f"WITH {M} SELECT seq, ts + CASE WHEN {_DRAW} < 0.2 THEN 50 + CAST(floor({_DRAW} * 5 * 50) AS BIGINT) ELSE 0 END AS deliver_at FROM messages")
def chaos_reorder(spark, d):
    return chaos.reorder(B.messages(spark, d), "seq", 0.2, 50, 100, "seed").select("seq", "deliver_at")


@query(f"""WITH {M}, k AS (SELECT *, 1000 * (node % 7) AS skew, CAST(floor(value * 100) AS BIGINT) AS age FROM messages)
SELECT kind, count(*) FILTER (age - skew BETWEEN 0 AND 20000) AS valid, count(*) FILTER (NOT age - skew BETWEEN 0 AND 20000) AS rejected FROM k GROUP BY kind""")
def skew_validity(spark, d):
    m = B.messages(spark, d).withColumn("age", F.floor(F.col("value") * 100))
    ok = chaos.valid_under_skew(F.col("age"), 1000 * (F.col("node") % 7), F.lit(0), 20000)
    return m.groupBy("kind").agg(F.count_if(ok).alias("valid"), F.count_if(~ok).alias("rejected"))


# -- streams -------------------------------------------------------------


@query(f"WITH {M} SELECT DISTINCT node, msg_id FROM messages")
def stream_distinct_messages(spark, d):
    """The events as a stream: a TTL beyond their span leaves one copy of each."""
    return live.run_available(live.deduplicated(live.event_stream(spark, f"{d}/events.parquet"), "3650 days").select("node", "msg_id"))


# -- caches and tuning ---------------------------------------------------


@query(f"WITH {M} SELECT xor(ts, seq) & 15 AS shard, count(*) AS entries, round(count(*) / 10000, 6) AS share, round(count(*) / 10000, 6) > 0.8 AS near_capacity FROM messages GROUP BY ALL")
def seen_shards(spark, d):
    m = B.messages(spark, d).withColumn("shard", caching.shard_index(F.col("ts"), F.col("seq")))
    return caching.utilization(m, "shard", 10_000)


@query(f"""WITH {M}, s AS (SELECT seq, ts, xor(ts, seq) & 15 AS shard FROM messages)
SELECT seq, shard FROM s QUALIFY row_number() OVER (PARTITION BY shard ORDER BY ts, seq) > floor(count(*) OVER (PARTITION BY shard) * 0.1)""")
def emergency_evict(spark, d):
    m = B.messages(spark, d).withColumn("shard", caching.shard_index(F.col("ts"), F.col("seq")))
    return caching.emergency_evict(m, "shard").select("seq", "shard")


@query(f"WITH {M}, l AS (SELECT kind, node, max(ts) AS last FROM messages GROUP BY ALL) SELECT kind, arg_min(node, (last, node)) AS victim FROM l GROUP BY kind")
def lru_pick(spark, d):
    return caching.least_recently_used(B.messages(spark, d), "kind", "node")


@query(f"WITH {M} SELECT node, max(ts) AS last FROM messages GROUP BY node HAVING {AS_OF} - max(ts) > {4 * DAY}")
def idle_cleanup(spark, d):
    return caching.idle(B.messages(spark, d), "node", AS_OF, 4 * DAY)


@query(f"""WITH {M} SELECT node, seq, CAST(sum(33 + octet_length(encode(payload))) OVER (PARTITION BY node ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used
FROM messages QUALIFY used <= 980""")
def budget_packing(spark, d):
    m = B.messages(spark, d).withColumn("size", (33 + F.octet_length("payload")).cast("long"))
    return caching.pack(m, "node", "size", int(1400 * 0.7)).select("node", "seq", "used")


@query(f"WITH {P} SELECT cluster, node, row_number() OVER (PARTITION BY cluster ORDER BY sha256('lazy:' || node)) AS rank FROM peers QUALIFY rank <= 3")
def lazy_sample(spark, d):
    return caching.sample_peers(B.peers(spark, d), "cluster", "node", 3, "lazy")


@query(f"""WITH RECURSIVE {M}, c AS (SELECT kind, ts // {DAY} * {DAY} AS bucket, count(*) AS n FROM messages GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY bucket) AS k FROM c),
f AS (SELECT kind, bucket, n, k, n::DOUBLE AS ema FROM o WHERE k = 1
  UNION ALL SELECT o.kind, o.bucket, o.n, o.k, 0.25::DOUBLE * o.n + 0.75::DOUBLE * f.ema FROM f JOIN o ON o.kind = f.kind AND o.k = f.k + 1)
SELECT kind, bucket, round(ema, 6) AS ema, CASE WHEN k <= 3 THEN 'unknown' WHEN ema - lag(ema) OVER w > 0.5 THEN 'up' WHEN ema - lag(ema) OVER w < -0.5 THEN 'down' ELSE 'flat' END AS trend
FROM f WINDOW w AS (PARTITION BY kind ORDER BY bucket)""")
def rate_trend(spark, d):
    counts = monitoring.tumbling_counts(B.messages(spark, d), DAY, "kind")
    out = tuning.trend(tuning.smoothed(counts, "kind", "n", 0.25), "kind", 0.5, 3)
    return out.select("kind", "bucket", F.round("ema", 6).alias("ema"), "trend")


@query(f"""WITH {M}, a AS (SELECT node, payload, min(ts) AS requested FROM messages WHERE kind = 'signup' GROUP BY ALL),
f AS (SELECT a.node, a.payload, min(m.ts) AS came FROM a JOIN messages m ON m.node = a.node AND m.payload = a.payload AND m.kind = 'view' AND m.ts BETWEEN a.requested AND a.requested + {7 * DAY} GROUP BY ALL)
SELECT a.node, a.payload, requested, came - requested AS latency FROM a LEFT JOIN f USING (node, payload)""")
def graft_outcomes(spark, d):
    m = B.messages(spark, d)
    return tuning.graft_outcomes(m.filter("kind = 'signup'"), m.filter("kind = 'view'"), 7 * DAY)


@query(f"""WITH {M}, alt AS (SELECT payload, list_sort(list(DISTINCT node)) AS alts FROM messages WHERE kind = 'click' GROUP BY payload)
SELECT m.seq, r.retry, CASE WHEN coalesce(len(alts), 0) > 0 THEN alts[(r.retry - 1) % len(alts) + 1] ELSE m.node END AS peer
FROM messages m LEFT JOIN alt USING (payload), (SELECT unnest(range(1, 4)) AS retry) r WHERE m.kind = 'signup'""")
def retry_alternates(spark, d):
    m = B.messages(spark, d)
    alts = m.filter("kind = 'click'").groupBy("payload").agg(F.sort_array(F.collect_set("node")).alias("alts"))
    asked = m.filter("kind = 'signup'").join(alts, "payload", "left").withColumn("retry", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(3).cast("long"))))
    return asked.select("seq", "retry", tuning.alternate(F.coalesce("alts", F.array().cast("array<bigint>")), F.col("node"), F.col("retry")).alias("peer"))


@query(f"""WITH {M}, r AS (SELECT node, kind = 'view' AS eager, lag(kind = 'view') OVER (PARTITION BY node ORDER BY ts, seq) AS before FROM messages)
SELECT node, count(*) FILTER (before <> eager) AS flaps FROM r GROUP BY node""")
def role_flaps(spark, d):
    return tuning.role_flaps(B.messages(spark, d), "node", F.col("kind") == "view")


@query(f"""WITH {M}, h AS ({_HEALTH})
SELECT node, round(greatest(4, least(64, 16 * CASE WHEN cache_use * 500 < 20 THEN 0.75 WHEN cache_use * 500 > 200 THEN 1.5 ELSE 1.0 END
  * CASE WHEN pending > 20 AND 1 - failure_rate < 0.8 THEN 0.6 + 0.4 * (1 - failure_rate) ELSE 1.0 END
  * CASE WHEN peers > 100 THEN 1 + 0.2 * ln(peers / 100) ELSE 1.0 END)), 6) AS size FROM h""")
def adaptive_batch_size(spark, d):
    n = B.messages(spark, d).groupBy("node").agg(
        F.count_distinct("msg_id").alias("peers"),
        F.round(F.count_if(F.col("kind") == "error") / F.count("*"), 6).alias("failure"),
        F.count_if(F.col("kind") == "click").alias("pending"),
        F.avg("value").alias("latency"),
    )
    size = tuning.batch_size(F.lit(16), F.col("latency"), F.col("pending"), 1 - F.col("failure"), F.col("peers"))
    return n.select("node", F.round(size, 6).alias("size"))


@query(f"""WITH {Q} SELECT queue, count(*) FILTER (class = 0) AS critical, count(*) FILTER (class = 1) AS high, count(*) FILTER (class = 2) AS normal,
  count(*) FILTER (class = 3) AS low FROM items GROUP BY queue""")
def queue_depths(spark, d):
    names = ["critical", "high", "normal", "low"]
    label = F.element_at(F.array(*[F.lit(x) for x in names]), F.col("class") + 1)
    return B.queue_items(spark, d).withColumn("label", label).groupBy("queue").pivot("label", names).count().na.fill(0)


@query(f"""WITH {M} SELECT 'messages_' || kind || '_total' AS metric, node::VARCHAR AS label, count(*)::DOUBLE AS number, 'counter' AS kind FROM messages GROUP BY messages.kind, node""")
def metrics_text(spark, d):
    """Exposition lines written from the counts, then parsed."""
    counts = B.messages(spark, d).groupBy("kind", "node").count()
    lines = counts.select(F.format_string('messages_%s_total{node="%d"} %d', "kind", "node", "count").alias("value"))
    return text.parse_metrics(lines.union(lines.select(F.concat(F.lit("# HELP "), "value"))))


@query(f"WITH {S} SELECT id, octet_length(encode(payload)) AS size, true AS same FROM stored")
def compression_roundtrip(spark, d):
    s = B.stored(spark, d).withColumn("raw", F.col("payload").cast("binary"))
    packed = s.withColumn("packed", compression.pack("raw"))
    return packed.select("id", F.length("raw").cast("long").alias("size"), (compression.unpack("packed") == F.col("raw")).alias("same"))


@query()
def compression_ratio(spark, d):
    """bytes in and out, compressed and skipped payloads per round (gzip's own bytes differ between builds: rows only)."""
    s = B.stored(spark, d).select("round", F.col("payload").cast("binary").alias("raw")).withColumn("packed", compression.pack("raw"))
    flag = F.substring("packed", 1, 1) == F.lit(bytearray([3]))
    return s.groupBy("round").agg(
        F.sum(F.length("raw")).alias("bytes_in"), F.sum(F.length("packed")).alias("bytes_out"), F.count_if(flag).alias("compressed"), F.count_if(~flag).alias("skipped")
    )


# -- frames, peers, caches and ratios --------------------------------------


def _envelopes(spark, d):
    return _frames(spark, d).withColumn("envelope", codec.encode_envelope(F.col("node"), F.col("frame")))


@query(f"""WITH {M} SELECT seq, node AS sender, CASE kind WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS tag,
  CASE kind WHEN 'view' THEN 33 + octet_length(encode(payload)) WHEN 'click' THEN 31 WHEN 'signup' THEN 29 ELSE 1 END + 9 AS bytes,
  CASE kind WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS bare_tag, true AS framed, true AS cut_is_null, true AS other_is_null
FROM messages WHERE kind <> 'purchase'""")
def envelope_roundtrip(spark, d):
    """Envelopes and bare frames decoded again; cut-off ones and another magic byte give null."""
    x = _envelopes(spark, d).withColumn("x", codec.decode_envelope(F.col("envelope")))
    return x.select(
        "seq", "x.sender", F.col("x.message.tag").cast("int").alias("tag"),
        codec.envelope_length(codec.encoded_length(F.col("k"), F.col("payload"), F.lit(1))).alias("bytes"),
        codec.decode_bare(codec.encode_bare(F.col("frame")))["tag"].cast("int").alias("bare_tag"),
        codec.is_frame(F.col("envelope")).alias("framed"),
        codec.decode_envelope(F.substring("envelope", 1, 18)).isNull().alias("cut_is_null"),
        codec.decode_envelope(F.concat(F.lit("4f"), F.substr("envelope", F.lit(3)))).isNull().alias("other_is_null"),
    )


@query(f"""WITH {M}, b AS (SELECT node, seq, {_HEX('ts', 8)} || {_HEX('seq', 8)} || {_HEX('node', 8)} AS id,
  (row_number() OVER (PARTITION BY node ORDER BY ts, seq) - 1) // 16 AS batch FROM messages WHERE kind = 'click')
SELECT node, batch, id, count(*) OVER (PARTITION BY node, batch) AS ids FROM b""")
def announcement_ids(spark, d):
    """Announcements of up to 16 ids each, encoded and taken apart again."""
    m = B.messages(spark, d).filter("kind = 'click'").withColumn("id", codec.encode_id(F.col("ts"), F.col("seq"), F.col("node")))
    w = Window.partitionBy("node").orderBy("ts", "seq")
    dealt = m.withColumn("batch", F.floor((F.row_number().over(w) - 1) / 16)).groupBy("node", "batch").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    found = dealt.withColumn("ids", codec.announced_ids(codec.encode_announcement(F.col("ids"), F.lit(0))))
    return found.select("node", "batch", F.explode("ids").alias("id"), F.size("ids").cast("long").alias("ids"))


@query(f"""WITH {M} SELECT CASE kind WHEN 'signup' THEN 'critical' WHEN 'view' THEN 'high' WHEN 'error' THEN 'low' ELSE 'normal' END AS priority, count(*) AS n FROM messages GROUP BY ALL""")
def message_priority(spark, d):
    kind = F.create_map(*[F.lit(x) for pair in B.KIND.items() for x in pair])[F.col("kind")]
    return B.messages(spark, d).groupBy(codec.priority(kind).alias("priority")).agg(F.count("*").alias("n"))


@query(f"""WITH {M}, c AS (SELECT node, count(*) FILTER (kind = 'view') AS succeeded, count(*) FILTER (kind = 'error') AS failed, count(*) FILTER (kind = 'click') AS retried,
  count(*) FILTER (kind = 'signup') AS added, count(*) FILTER (kind = 'purchase') AS removed FROM messages GROUP BY node)
SELECT node, round(succeeded / nullif(succeeded + failed, 0), 6) AS success, round(succeeded / (succeeded + failed + 0.001), 6) AS guarded_success,
  round(retried / nullif(succeeded + failed, 0), 6) AS retry_rate, added + removed AS churn, round(added / nullif(removed, 0), 6) AS promotion_ratio,
  CASE WHEN retried = 0 THEN NULL ELSE least(round(succeeded / retried, 6), 1.0) END AS health,
  CASE WHEN failed / nullif(succeeded + failed, 0) > 0.3 THEN 'critical' WHEN failed / nullif(succeeded + failed, 0) > 0.1 THEN 'warning' ELSE 'ok' END AS severity FROM c""")
def repair_ratios(spark, d):
    of = lambda kind: F.count_if(F.col("kind") == kind)
    c = B.messages(spark, d).groupBy("node").agg(
        of("view").alias("succeeded"), of("error").alias("failed"), of("click").alias("retried"), of("signup").alias("added"), of("purchase").alias("removed"),
        of("signup").alias("promoted"), of("purchase").alias("demoted"), of("view").alias("delivered"), of("click").alias("sent"),
    )
    out = monitoring.repair_ratios(c)
    failing = F.try_divide("failed", F.col("succeeded") + F.col("failed"))
    return out.select("node", "success", "guarded_success", "retry_rate", "churn", "promotion_ratio", "health", monitoring.severity(failing, 0.1, 0.3).alias("severity"))


@query(f"""WITH {M}, r AS (SELECT node, ts, CAST(floor(value) AS BIGINT) AS reading, lag(CAST(floor(value) AS BIGINT)) OVER (PARTITION BY node ORDER BY ts, seq) AS before FROM messages),
s AS (SELECT node, ts // {DAY} * {DAY} AS bucket, CASE WHEN before IS NULL THEN 0 WHEN reading < before THEN reading ELSE reading - before END AS step FROM r)
SELECT node, bucket, CAST(sum(step) AS BIGINT) AS increase, round(sum(step) * 1000 / {DAY}, 6) AS per_s FROM s GROUP BY node, bucket""")
def counter_rates(spark, d):
    m = B.messages(spark, d).filter("value IS NOT NULL").withColumn("reading", F.floor("value"))
    return monitoring.counter_rates(m, DAY, "node")


@query(f"""WITH {_EDGES}, c AS (SELECT node, count(*) AS eager FROM edges GROUP BY node)
SELECT node, coalesce(eager, 0) AS eager, n - 1 - coalesce(eager, 0) AS lazy, n - 1 AS total,
  CASE WHEN n = 1 THEN 0.0 ELSE round(coalesce(eager, 0) / (n - 1), 6) END AS eager_ratio, coalesce(eager, 0) >= least(2, n - 1) AS sufficient FROM ring LEFT JOIN c USING (node)""")
def peer_counts(spark, d):
    placed = topology.ring(B.peers(spark, d))
    return topology.peer_counts(placed, topology.eager_edges(placed, 2), 2)


@query(f"""WITH {_EDGES}, p AS (SELECT x.node, y.node AS peer, (x.pos - y.pos + x.n) % x.n AS back, (y.pos - x.pos + x.n) % x.n AS ahead FROM ring x JOIN ring y USING (cluster) WHERE x.node <> y.node)
SELECT node, arg_min(peer, (least(back, ahead), CASE WHEN back <= ahead THEN 0 ELSE 1 END)) AS peer FROM p ANTI JOIN edges USING (node, peer) GROUP BY node""")
def nearest_lazy(spark, d):
    placed = topology.ring(B.peers(spark, d))
    return topology.nearest_lazy(placed, topology.eager_edges(placed, 2), 2)


@query(f"""WITH {M} SELECT msg_id, min(ts) AS first FROM messages GROUP BY msg_id HAVING min(ts) >= {AS_OF} - {30 * DAY} ORDER BY first DESC, msg_id LIMIT 200""")
def cache_fifo(spark, d):
    """A cache's own capacity: 200 entries."""
    return caching.fifo_cache(B.messages(spark, d), "msg_id", AS_OF, 30 * DAY, 200)


@query(f"""WITH {M}, f AS (SELECT msg_id, min(ts) AS first FROM messages WHERE kind = 'view' GROUP BY msg_id)
SELECT m.seq, m.msg_id, coalesce(m.ts - f.first BETWEEN 0 AND {DAY}, false) AS hit FROM messages m LEFT JOIN f USING (msg_id) WHERE m.kind = 'view'""")
def cache_get(spark, d):
    m = B.messages(spark, d).filter("kind = 'view'").select("seq", "msg_id", "ts")
    return caching.cache_get(m, m.groupBy("msg_id").agg(F.min("ts").alias("first")), "msg_id", DAY).select("seq", "msg_id", "hit")


@query(f"WITH {_SCORES} SELECT peer, highest - lowest AS rtt_range FROM scores WHERE {AS_OF} - last <= {PRESET.max_age_ms}")
def fresh_ranges(spark, d):
    """What is left when stale scores are dropped, with the range of each peer's round trips."""
    return scoring.drop_stale(_scores(spark, d), AS_OF, PRESET).select("peer", (F.col("highest") - F.col("lowest")).alias("rtt_range"))
