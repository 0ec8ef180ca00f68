"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def _with_least(edges: DataFrame, one: bool) -> DataFrame:
    """Each (u, v) with the smallest of u and all its neighbours as ``m``.

    The least is a map-side aggregate of one row for each node and task, so a
    hub costs its task no more than any other node. It is stored, so that the
    join back is of two plain shuffles, which Spark splits where u is skewed.
    Few edges are ``one`` partition, which needs neither.
    """
    edges = _partition(edges, one)
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(least if one else stored(least, "cc-least"), "u")


def _partition(edges: DataFrame, one: bool) -> DataFrame:
    return edges.coalesce(1) if one else edges


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def large_star(edges: DataFrame, one: bool = False) -> DataFrame:
    """Link every larger neighbour of u to u's least neighbour."""
    found = _with_least(_both_ways(edges), one).filter("v > u")
    return found.select(F.col("v").alias("u"), F.col("m").alias("v"))


def small_star(edges: DataFrame, one: bool = False) -> DataFrame:
    """Link u and every smaller neighbour of it to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    found = _with_least(down, one)
    both = found.select(F.col("v").alias("u"), F.col("m").alias("v")).union(found.select("u", F.col("m").alias("v")))
    return _partition(both, one).filter("u <> v").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60, few: int = 0) -> DataFrame:
    """(``node``, ``root``): the smallest node reachable, for each node with a link.

    Nodes of one type that has an order. Self links and nulls are left out; no
    links give no rows. Every round writes its edges to the shared folder, so
    lineage stays short; it ends when every edge points at a root. Up to
    ``few`` edges are one partition, for which Spark plans no shuffle.
    """
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    edges = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    one = few > 0 and edges.count() <= few
    for _ in range(rounds):
        at = _partition(edges, one)
        # A star forest: every u has one edge, and none of its v is a u.
        roots = at.select(F.col("v").alias("u")).distinct()
        loose = at.groupBy("u").count().filter("count > 1").select("u").union(at.select("u").distinct().join(roots, "u", "left_semi"))
        if loose.isEmpty():
            break
        before = edges
        edges = stored(small_star(stored(large_star(at, one).distinct(), "cc"), one), "cc")
        discard(before)
    else:
        raise RuntimeError(f"no star forest after {rounds} rounds")
    at = _partition(edges, one)
    return at.select(F.col("u").alias("node"), F.col("v").alias("root")).union(at.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
