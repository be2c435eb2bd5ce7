"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash


def connected_components(links: DataFrame, max_rounds: int = 40) -> DataFrame:
    """node, root for every node in links (columns a, b of type long); root is the smallest node reachable.

    Each round points every node's larger neighbours at its smallest neighbour (large star), then its smaller neighbours
    likewise (small star), until the link table is a forest of stars. Every round is two
    aggregations with map-side combining and two joins whose other side has one row for each key and is written first, so
    Spark can split the tasks of a hub with many links. Lineage is cut by the written tables. Self-links and repeated links do no harm.
    """
    edges = stash(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    rounds = 0
    while not _all_stars(edges):
        if rounds == max_rounds:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
        rounds += 1
        # large star: for node x with smallest neighbour-or-self m, link each larger neighbour to m
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stash(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m")))
        large = stash(edges.hint("merge").join(low.hint("merge"), edges["v"] == low["x"]).select("u", F.col("m").alias("v")).where("u <> v").distinct())
        # small star: for node x, link its smaller neighbours and itself to the smallest of them
        least = stash(large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), "m"))
        joined = large.hint("merge").join(least.hint("merge"), large["u"] == least["x"])
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select(F.col("x").alias("u"), F.col("m").alias("v")))
        edges = stash(small.distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _all_stars(edges: DataFrame) -> bool:
    """Whether every u stands in one link only; as v < u in all links, each component then is one star around its smallest node."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("outer")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("outer")))
    return ends.groupBy("x").agg(F.count(F.lit(1)).alias("n"), F.max("outer").alias("outer")).where("outer = 1 and n > 1").isEmpty()
