"""Ring scores on rings of odd and even sizes."""

import pytest

from gossamer.operators import topology


@pytest.mark.parametrize("n", [1, 2, 3, 5, 6, 9])
def test_hybrid_scores_by_whole_half_rings(spark, n):
    placed = topology.ring(spark.range(n).selectExpr("1 AS cluster", "id AS node"))
    scores = spark.range(n).selectExpr("id AS node", "0.0 AS normalized")
    pos = {r["node"]: r["pos"] for r in placed.collect()}
    got = {(r["node"], r["peer"]): r["score"] for r in topology.hybrid_scores(placed, scores).collect()}
    assert len(got) == n * (n - 1)
    for (a, b), score in got.items():
        d = min((pos[a] - pos[b]) % n, (pos[b] - pos[a]) % n)
        assert abs(score - 0.4 * min(1.0, max(0.0, 1 - d / (n // 2)))) < 1e-9


@pytest.mark.parametrize("nets", ["id % 11 / 10", "0.5", "least(id * 0.4 / 45 / 0.6, 1.0)"])
def test_candidates_hold_the_best_and_the_worst(spark, nets):
    """Many peers tie, so that some nodes are compared with their whole ring."""
    placed = topology.ring(spark.range(95).selectExpr("id % 91 DIV 90 AS cluster", "id AS node")).cache()
    scores = spark.range(95).filter("id <> 7").selectExpr("id AS node", f"CAST({nets} AS DOUBLE) AS normalized")
    pairs = topology.hybrid_scores(placed, scores).cache()
    rows = lambda df: sorted((r["node"], r["peer"], r["rank"], r["is_ring"], round(r["score"], 12)) for r in df.collect())
    for k in (2, 6):
        assert rows(topology.promote(topology.candidates(placed, scores, k), k)) == rows(topology.promote(pairs, k))
        assert rows(topology.demote(topology.candidates(placed, scores, k, lowest=True), k)) == rows(topology.demote(pairs, k))


def test_candidates_are_no_pairs(spark):
    placed = topology.ring(spark.range(400).selectExpr("1 AS cluster", "id AS node"))
    scores = spark.range(400).selectExpr("id AS node", "id % 11 / 10D AS normalized")
    assert topology.candidates(placed, scores, 3).count() == 4 * 400
    assert topology.candidates(placed, scores, 2, lowest=True).count() < 4 * 400


def test_pairs_are_made_in_blocks_by_many_tasks(spark, monkeypatch):
    placed = topology.ring(spark.range(50).selectExpr("1 AS cluster", "id AS node"))
    scores = spark.range(50).selectExpr("id AS node", "id % 11 / 10D AS normalized")
    rows = lambda df: sorted((r["node"], r["peer"], r["is_ring"], r["score"]) for r in df.collect())
    whole = rows(topology.hybrid_scores(placed, scores))
    monkeypatch.setattr(topology, "BLOCK", 7)
    monkeypatch.setattr(topology, "TASK_PAIRS", 500)
    pairs = topology.hybrid_scores(placed, scores)
    assert pairs.rdd.getNumPartitions() >= 5
    assert rows(pairs) == whole and len(whole) == 50 * 49
