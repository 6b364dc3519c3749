"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014).

Nothing here is broadcast: the tables grow with the corpus, and a side that happens to be small isn't built on the driver either.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.session import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star links each node's greater neighbours, small star its lesser ones and itself, to its least neighbour.

    `edges` has a > b. The least neighbour comes from an aggregation with map-side combining, so a
    node of a million neighbours isn't gathered anywhere.
    """
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("least"))
    joined = both.join(least.hint("merge"), both.a == least.node)
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("least").alias("b")).union(joined.select("a", F.col("least").alias("b")))
    return out.where("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the least node of the component.

    No edges give no rows. Each star is written to the shared folder; rounds grow with the logarithm of the
    longest chain, and a group of copies around one document takes one round and the proof.
    """
    scratch = Scratch(edges.sparkSession)
    e = scratch.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        large = scratch.keep(_star(e, large=True), "large")
        scratch.drop(e)
        e = scratch.keep(_star(large, large=False), "small")
        scratch.drop(large)
        now = e.agg(F.count("*"), F.sum("b"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == mark:
            break
        mark = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select("b", "b").distinct())


def forest_roots(parents: DataFrame) -> DataFrame:
    """(node, root) for every node of a forest of edges (a, b) in which each b has one lesser parent a.

    Pointer jumping: each round halves the depths, and a forest of stars takes one round.
    """
    scratch = Scratch(parents.sparkSession)
    f = parents.select(F.col("b").alias("node"), F.col("a").alias("root"))
    while True:
        up = f.select(F.col("node").alias("root"), F.col("root").alias("up")).hint("merge")
        moved = scratch.keep(f.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")), "forest")
        scratch.drop(f)
        f = moved
        if f.where("moved").isEmpty():
            return f.select("node", "root").union(f.select("root", "root").distinct())


def merged_roots(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """The (node, root) of `roots` after its groups are joined along further edges (a, b); new nodes are added."""
    scratch = Scratch(roots.sparkSession)
    ra, rb = (roots.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")).hint("merge") for x in "ab")
    known = edges.join(ra, "a", "left").join(rb, "b", "left").select("a", "b", F.coalesce("ra", "a").alias("ra"), F.coalesce("rb", "b").alias("rb"))
    known = scratch.keep(known, "known")
    top = connected_components(known.select(F.col("ra").alias("a"), F.col("rb").alias("b"))).select(F.col("node").alias("top"), F.col("root").alias("final"))
    new = known.select(F.col("a").alias("node"), F.col("ra").alias("root")).union(known.select("b", "rb"))
    every = roots.union(new.join(roots.select("node").hint("merge"), "node", "left_anti").distinct())
    return every.join(top.hint("merge"), every.root == top.top, "left").select("node", F.coalesce("final", "root").alias("root"))
