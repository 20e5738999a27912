"""Connected components by alternating large and small stars; links never leave the executors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


#: A node with more neighbours than this, and than its share of all links, is joined apart (at most HUBS nodes).
NEIGHBOURS, HUBS = 4096, 1000


def _with_least(both: DataFrame, links: int) -> DataFrame:
    """(u, v) -> (u, v, m): m is the least of u and its neighbours v. Rows of a hub find m by a broadcast of the hubs, of
    which there are at most HUBS, so that they need not meet in one task."""
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    if links <= NEIGHBOURS:
        return both.join(least.drop("n"), "u")
    hubs = least.where(F.col("n") > max(NEIGHBOURS, 2 * links // HUBS)).select("u", F.col("m").alias("hub"))
    marked = both.join(F.broadcast(hubs), "u", "left")
    rest = marked.where("hub is null").drop("hub").join(least.drop("n"), "u")
    return rest.unionByName(marked.where("hub is not null").withColumnRenamed("hub", "m"))


def components(edges: DataFrame) -> DataFrame:
    """(a, b) of longs -> (node, component): for every node of an edge, the smallest node reachable. Loops, repeated
    edges and nulls (dropped) are fine; no edges give no rows. Each round is written to the shared folder; the number
    of rounds grows with the logarithm of the longest chain. Minima are pre-aggregated, and hubs are joined apart."""
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs, seen = common.written(pairs, "links"), None
    links = pairs.count()
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = common.written(_with_least(both, links).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-stars")
        small = _with_least(large, links).select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        after = common.written(small.select("e.u", "e.v").where("u <> v").distinct(), "small-stars")
        state = tuple(after.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        common.discard(pairs, large)
        pairs, links = after, state[0]
        if state == seen:
            break
        seen = state
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def heads(links: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest id of each vector's component in the bipartite graph links (a x b)."""
    big = np.iinfo(np.int64).max
    while True:
        down = np.minimum(b, np.where(links, a[:, None], big).min(axis=0))
        up = np.minimum(a, np.where(links, down[None, :], big).min(axis=1))
        if (up == a).all() and (down == b).all():
            return a, b
        a, b = up, down
