"""Connected components of an edge table, without gathering any part of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, component) for each node of ``edges`` (a long, b long); component is its smallest node.

    Each round points every node to the neighbour (or itself) of least
    pseudo-random rank and contracts the edges along these pointers; in random
    order that removes a constant share of the nodes, also on paths, and a star
    vanishes in two rounds.  Minima are combined before they are shuffled, and
    the joins have plain keys on both sides, so that a hub's rows can be split.
    """
    rank = lambda c: F.struct(F.xxhash64(c).alias("r"), F.col(c).alias("n"))
    live, steps = edges.select("a", "b").where("a <> b"), []
    while True:
        both = live.union(live.select("b", "a")).toDF("x", "y")
        to = both.groupBy("x").agg(F.min(rank("y")).alias("least"))
        to = scratch.save(to.select("x", F.least("least", rank("x"))["n"].alias("p")))
        moved = live.join(to.toDF("a", "pa"), "a").join(to.toDF("b", "pb"), "b")
        moved = moved.where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
        contracted = scratch.save(moved.distinct())
        if steps:
            scratch.free(live)
        live = contracted
        steps.append(to)
        if live.isEmpty():
            break
    whole = steps[0].toDF("node", "top")
    for to in steps[1:]:
        whole = whole.join(to.toDF("top", "p"), "top", "left").select("node", F.coalesce("p", "top").alias("top"))
    least = whole.groupBy("top").agg(F.min("node").alias("component"))
    out = scratch.save(whole.join(least, "top").select("node", "component"))
    scratch.free(live, *steps)
    return out
