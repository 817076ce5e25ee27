"""Connected components over an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash

ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(a, b) undirected edges of bigint nodes -> (node, label): label is the smallest node reachable.

    Each round hangs every node on that of its neighbours (or itself) whose hash is least, and rewrites both ends of every
    edge to where they hang; loops and repeats go, so the edge table shrinks by a factor a round and a star is gone after
    one or two. The rounds' maps are composed from the last to the first. Loops, repeated edges and null ends are
    ignored; a node without an edge to another one has no row; no edges give no rows. Raises if edges are left after
    ROUNDS rounds instead of returning partial components.
    """
    ends = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    left = stash(edges.where("a <> b").select(*ends).distinct(), "edges")
    maps: list[DataFrame] = []
    while not left.isEmpty():
        if len(maps) == ROUNDS:
            raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
        both = left.union(left.select("b", "a"))
        pick = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b").alias("h"), "b")).alias("m"))
        hang = stash(pick.select(F.col("a").alias("node"), F.when(F.col("m.h") < F.xxhash64("a"), F.col("m.b")).otherwise(F.col("a")).alias("next")), "hang")
        maps.append(hang)
        moved = left.join(hang.toDF("a", "x"), "a").select("x", "b").join(hang.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
        left = stash(moved.where("a <> b").select(*ends).distinct(), "edges")
    if not maps:
        return left.select(F.col("a").alias("node"), F.col("b").alias("label"))
    whole = maps.pop()
    while maps:  # a node that hangs on one that no later round has seen has arrived
        after = whole.toDF("next", "last")
        whole = stash(maps.pop().join(after, "next", "left").select("node", F.coalesce("last", "next").alias("next")), "composed")
    least = whole.groupBy("next").agg(F.min("node").alias("label"))
    return whole.join(least, "next").select("node", "label")
