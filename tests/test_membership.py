"""Topologies, frames and checks against results worked out by hand."""

from pyspark.sql import functions as F

from gossamer.functions import checks, codec
from gossamer.operators import chaos, membership

ROLES = "node long, peer long, role string, is_ring boolean, score double"


def held(df):
    return {r["peer"]: (r["role"], r["changed"]) for r in df.collect()}


def test_admission(spark):
    joins = spark.createDataFrame([(1, p, t, t) for t, p in enumerate([5, 6, 5, 7, 8, 8, 6])], "node long, peer long, ts long, seq long")
    got = [(r["peer"], r["outcome"]) for r in membership.admit(joins, 1, 3).orderBy("seq").collect()]
    assert got == [(5, "added_eager"), (6, "added_lazy"), (5, "already_exists"), (7, "added_lazy"), (8, "limit_reached"), (8, "limit_reached"), (6, "already_exists")]
    assert membership.topology(joins.limit(0), 1, 3).count() == 0


def test_changes(spark):
    rows = [(1, 1, "eager", False, 0.1), (1, 2, "eager", True, 0.0), (1, 3, "lazy", True, 0.5), (1, 4, "lazy", False, 0.9), (1, 5, "lazy", True, 0.2)]
    roles = spark.createDataFrame(rows, ROLES)
    asked = lambda *peers: spark.createDataFrame([(1, p, i) for i, p in enumerate(peers)], "node long, peer long, seq long")
    up = held(membership.promote(roles, asked(4, 1, 3, 9), 3))
    assert up[4] == ("eager", True) and up[3] == ("lazy", False) and up[1] == ("eager", False) and 9 not in up
    assert {p for p, x in held(membership.demote(roles, asked(1, 2, 4))).items() if x[1]} == {1}
    assert {r["peer"]: r["outcome"] for r in membership.remove(roles, asked(1, 4, 9)).collect()} == {1: "removed_eager", 4: "removed_lazy", 9: "not_found"}
    assert {p: r for p, (r, c) in held(membership.prefer_ring(roles, 2)).items() if c} == {1: "lazy", 3: "eager"}
    assert {p: r for p, (r, c) in held(membership.prefer_ring(roles, 3)).items() if c} == {1: "lazy", 3: "eager", 5: "eager"}
    assert {p for p, x in held(membership.rebalance(roles, 4)).items() if x[1]} == {3, 5}
    assert {p: r for p, (r, c) in held(membership.rebalance(roles, 0)).items() if c} == {1: "lazy"}
    torn = spark.createDataFrame([*rows, (1, 1, "lazy", False, 0.1)], ROLES)
    assert [r["torn"] for r in membership.snapshot(torn).collect()] == [1]


def test_isolation(spark):
    m = spark.createDataFrame([(1, 2, 5), (2, 3, 5), (3, 1, 15), (2, 3, 15), (3, 1, 25)], "src long, dst long, ts long")
    failed = spark.createDataFrame([(1, 10), (2, 20)], "node long, failed_at long")
    got = [(r["src"], r["dst"], r["ts"]) for r in chaos.under_isolation(m, failed, 20).filter("blocked").collect()]
    assert got == [(3, 1, 15)]


def test_push_limits(spark):
    row = F.struct(F.lit("ab" * 24).alias("id"), F.lit(3).cast("long").alias("round"), F.lit("é").alias("payload"))
    x = spark.range(1).select(
        *[codec.decode_sync_push(codec.encode_sync_push(F.array_repeat(row, n))).alias(f"n{n}") for n in (0, 2, 50, 51)],
        codec.decode_sync_push(F.lit("07")).alias("tag"), codec.decode_sync_push(F.lit("08")).alias("cut"), codec.decode_sync_push(F.lit("080002")).alias("none"),
    ).first()
    assert x["n0"] == [] and [tuple(r) for r in x["n2"]] == [("ab" * 24, 3, "é")] * 2 and len(x["n50"]) == 50
    assert x["n51"] is None and x["tag"] is None and x["cut"] is None and x["none"] is None


def test_texts(spark):
    rows = [("250ms", "h:80"), ("12", "[::1]:65535"), ("-1ms", "h:65536"), ("ms", "h"), (None, None), ("1s", "::1:80")]
    x = spark.createDataFrame(rows, "d string, a string").select(codec.duration_ms(F.col("d")).alias("d"), codec.socket_address(F.col("a")).alias("a")).collect()
    assert [r["d"] for r in x] == [250, 12, None, None, None, None]
    assert [r["a"] and tuple(r["a"]) for r in x] == [("h", 80), ("[::1]", 65535), None, None, None, None]


def test_first_failure_wins(spark):
    x = spark.createDataFrame([(0, 0), (1, 0), (1, None), (1, 2)], "eager_fanout int, max_peers int")
    got = [r[0] for r in x.select(checks.config_error({c: F.col(c) for c in x.columns})).collect()]
    assert got == ["eager_fanout must be > 0", "max_peers must be > 0 when set", None, None]


def test_ring_flags_by_places(spark):
    import hashlib

    head = lambda x: (int(hashlib.sha256(str(x).encode()).hexdigest()[:15], 16), x)
    sizes = [1, 2, 3, 4, 5, 9, 30]
    known = [(n, p) for n in range(len(sizes)) for p in range(n % 2, n % 2 + sizes[n])]  # some hold themselves
    wanted = {}
    for n in range(len(sizes)):
        ring = sorted([(*head(p), 0) for m, p in known if m == n] + [(*head(n), 1)])
        own = next(i for i, x in enumerate(ring) if x[2])
        wanted |= {(n, x[1]): min((i - own) % len(ring), (own - i) % len(ring)) <= 2 for i, x in enumerate(ring) if not x[2]}
    got = membership.ring_flags(spark.createDataFrame(known, "node long, peer long")).collect()
    assert {(r["node"], r["peer"]): r["is_ring"] for r in got} == wanted and len(got) == len(known)


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_topologies_deal_their_joins_out_once(spark):
    joins = spark.createDataFrame([(1, p, t, t) for t, p in enumerate([5, 6, 5, 7, 8])], "node long, peer long, ts long, seq long")
    roles = membership.ring_flags(membership.topology(joins, 1, 3, F.bool_or(F.col("seq") == 0).alias("asked")))
    done = membership.demote(roles, F.col("asked"))
    assert exchanges(done) == 1
    assert exchanges(membership.admit(joins, 1, 3)) == 1
    assert {(r["peer"], r["role"], r["refused"]) for r in roles.collect()} == {(5, "eager", 8), (6, "lazy", 8), (7, "lazy", 8)}


def test_eviction_picks_deal_their_joins_out_once(spark):
    joins = spark.createDataFrame([(1, p, t, t) for t, p in enumerate([5, 6, 7, 8, 9, 10, 11, 12, 12])] + [(2, 5, 0, 0)], "node long, peer long, ts long, seq long")
    roles = membership.ring_flags(membership.topology(joins, 1, 7))
    picked = membership.eviction_pick(roles)
    first = spark.createDataFrame([(1, 12)], "node long, newcomer long")
    assert exchanges(picked) == 1
    assert picked.collect() == membership.eviction_pick(roles, first).collect() and picked.first()["newcomer"] == 12
