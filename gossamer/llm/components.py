"""Connected components over a table of links, as joins and grouping alone.

Alternating large-star and small-star steps (Kiveris et al., 2014): each step regroups the
links around the smallest neighbour of every node, with a map-side minimum, and writes the
links to the shared folder. Only the number of links that changed reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gossamer.llm.common import materialize


def _star(directed: DataFrame) -> DataFrame:
    """For every node u of (u, v): links from its neighbours v to the smallest of u and them."""
    least = directed.groupBy("u").agg(F.min("v").alias("m"))
    # the hot side of this join is a hub's links, which adaptive execution may split
    return directed.join(least, "u").select("u", "v", F.least("u", "m").alias("m"))


def _large(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    stars = _star(both).filter(F.col("v") > F.col("u"))
    return stars.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    stars = _star(down)
    moved = stars.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(stars.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def _shape(links: DataFrame) -> tuple:
    row = links.agg(
        F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    ).first()
    return row[0], row[1]


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of links (u, v) of one type; component is the smallest node reachable.

    Null ends, self-links and repeated links are ignored; no links give no rows.
    """
    current = materialize(
        links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links"
    )
    shape = _shape(current)
    for _ in range(rounds):
        if shape[0] == 0:
            break
        current = materialize(_small(_large(current)), "links")
        following = _shape(current)
        if following == shape:
            break
        shape = following
    else:
        raise RuntimeError("components did not settle")
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
