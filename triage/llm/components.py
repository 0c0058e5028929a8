"""Connected components by alternating large and small stars, lineage cut after each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

# Nodes with more than 1 of HUBS links are joined without a shuffle; they are fewer than HUBS.
HUBS = 1024


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (src, dst: long); component is its smallest node.

    Self-links and repeated links are allowed. Each round hangs a node's larger neighbours, then its
    smaller ones, below the smallest; it ends when nothing moves, after a number of rounds that
    grows with the logarithm of the size. Edges stay distributed; the driver sees two numbers.
    """
    links = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
    links = cut(links.filter(F.col("u") > F.col("v")).distinct())
    before = None
    while True:
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before or state[0] == 0:
            break
        before = tuple(state)
        most = 2 * state[0]  # links of any step of the round, at most
        links = cut(_small_star(cut(_large_star(links, most)), most).distinct())
    roots = links.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _large_star(links: DataFrame, most: int) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = cut(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n")))
    found = _with_least(both, least, most)
    return found.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame, most: int) -> DataFrame:
    """Links point down (u > v); the results do too."""
    least = cut(links.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
    moved = _with_least(links, least, most).filter(F.col("v") != F.col("m"))
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))


def _with_least(links: DataFrame, least: DataFrame, most: int) -> DataFrame:
    """``links`` with m, the ``least`` of their node u.

    Of at most ``most`` links, fewer than HUBS nodes have more than 1 of HUBS; these are broadcast and
    their links stay where they lie. The links of all other nodes are shuffled, so no task gets those
    of a hub.
    """
    hub = F.col("n") * HUBS > most
    hubs = F.broadcast(least.filter(hub).select("u", "m"))
    rest = least.filter(~hub).select("u", "m")
    return links.join(hubs, "u").unionByName(links.join(hubs, "u", "left_anti").join(rest, "u"))
