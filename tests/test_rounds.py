"""Breadth-first rounds reach everything, however far it is."""

import pytest

from gossamer.operators import topology


def ring_of(spark, n):
    return spark.range(n).selectExpr("id AS node", f"explode(array((id + 1) % {n}, (id + {n} - 1) % {n})) AS peer").coalesce(1)


def test_a_ring_of_more_rounds_than_a_limit(spark):
    n = 135  # its far side is 67 rounds away
    got = {r["node"]: r["round"] for r in topology.bfs_rounds(ring_of(spark, n).cache(), spark.createDataFrame([(0,)], "node long")).collect()}
    assert got == {i: min(i, n - i) for i in range(n)}


def test_a_guard_raises(spark):
    source = spark.createDataFrame([(0,)], "node long")
    assert topology.bfs_rounds(ring_of(spark, 9), source, rounds=4).count() == 9
    with pytest.raises(RuntimeError):
        topology.bfs_rounds(ring_of(spark, 9), source, rounds=3)


def test_parts_are_searched_without_rounds(spark, monkeypatch):
    n = 135
    two = ring_of(spark, n).selectExpr("explode(array(0, 1)) AS part", "node", "peer").selectExpr("part", f"node + part * {n} AS node", f"peer + part * {n} AS peer")
    source = spark.createDataFrame([(0, 0), (1, n)], "part int, node long")
    wanted = {i + p * n: min(i, n - i) for i in range(n) for p in (0, 1)}
    rounds = lambda **k: {r["node"]: r["round"] for r in topology.bfs_rounds(two, source, part="part", **k).collect()}
    with monkeypatch.context() as m:
        m.setattr(topology, "cut", lambda df: pytest.fail("a round was run"))
        assert rounds() == wanted and rounds(rounds=67) == wanted
        with pytest.raises(Exception, match="still reached"):
            rounds(rounds=66)


def test_parts_that_are_large_or_share_nodes(spark, monkeypatch):
    rows = [(0, 0, 1), (0, 1, 2), (1, 2, 3), (2, 7, 8), (2, 8, 9), (2, 9, 7), (3, 20, 21)]
    source = spark.createDataFrame([(0, 0), (2, 7), (3, 20)], "part int, node long")
    monkeypatch.setattr(topology, "PART_EDGES", 2)
    got = topology.bfs_rounds(spark.createDataFrame(rows, "part int, node long, peer long").coalesce(1), source, part="part").collect()
    assert sorted(map(tuple, got)) == [(0, 0), (1, 1), (2, 2), (3, 3), (7, 0), (8, 1), (9, 2), (20, 0), (21, 1)]
