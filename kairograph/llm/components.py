"""Connected components by alternating stars, all in DataFrames.

Each round hooks every vertex's larger neighbours, then its smaller ones, to
the smallest vertex seen; rounds grow with the logarithm of the longest chain.
Every round's edges are written to the shared folder, so lineage stays short
and a lost executor costs a reread.  A vertex's neighbours are reduced with
``min``, which combines before the shuffle, and joined back.  Vertices with more
than their share of all edges (a ``HUBS``-th) are joined by broadcast, so a hub
of any degree is never gathered; there are at most ``HUBS`` of them, which bounds
what is broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

HUBS = 1000
LEAST_HUB = 256  # neighbours; fewer make no hub

def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``edges`` has a, b.  Returns vertex, label (the smallest vertex reachable) for every vertex with an edge to another."""

    def star(e: DataFrame, large: bool, share: int) -> DataFrame:
        # seen from every vertex v: neighbours n with n > v (large) or n <= v (small) are hooked to min(v, all neighbours)
        both = e.select(F.col("a").alias("v"), F.col("b").alias("n")).union(e.select(F.col("b").alias("v"), F.col("a").alias("n")))
        seen = both if large else both.where("n < v")
        least = seen.groupBy("v").agg(F.min("n").alias("m"), F.count("*").alias("d")).select("v", F.least("m", "v").alias("m"), "d")
        hubs = F.broadcast(least.where(F.col("d") > share).select(F.col("v").alias("hub"), F.col("m").alias("hm")))
        known = seen.join(hubs, F.col("v") == F.col("hub"), "left")
        rest = known.where("hub is null").select("v", "n").join(least.where(F.col("d") <= share).select("v", "m"), "v")
        hooked = rest.select("v", "n", "m").union(known.where("hub is not null").select("v", "n", "hm"))
        hooked = hooked.where("n > v") if large else hooked
        out = hooked.select(F.col("n").alias("x"), "m")
        if not large:
            out = out.union(least.select(F.col("v").alias("x"), "m"))
        return out.where("x <> m").select(F.col("x").alias("b"), F.col("m").alias("a")).distinct()

    now = scratch.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("b"), F.least("a", "b").alias("a")).distinct())
    while True:
        share = max(LEAST_HUB, -(-2 * now.count() // HUBS))
        new = scratch.keep(star(star(now, True, share), False, share))
        # settled when every larger end has one smaller end, and no smaller end is a larger end elsewhere
        loose = new.groupBy("b").agg(F.count("*").alias("n")).where("n > 1").limit(1).union(
            new.select(F.col("a").alias("b")).distinct().join(new.select("b").distinct(), "b", "left_semi").select("b", F.lit(1).cast("long")).limit(1)
        )
        done = not loose.take(1)
        scratch.drop(now)
        now = new
        if done:
            break
    return now.select(F.col("b").alias("vertex"), F.col("a").alias("label")).union(now.select(F.col("a"), F.col("a")).distinct())
