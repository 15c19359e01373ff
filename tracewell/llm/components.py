"""Connected components by alternating large-star and small-star, as joins and grouped minima only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each node of a link reaches. A node without links has no row.

    Nulls and self links are left out; repeated and reversed links count once. No group is ever collected: each
    round takes the minimum of every node's neighbours (partial aggregates) and joins it back, so that a hub of
    any degree is split over tasks by the adaptive skew join. Rounds grow with the logarithm of the longest path.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where((F.col(a) != F.col(b)))
    e = materialise(e.distinct())
    state = _state(e)
    while state[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialise(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        before, state = state, _state(e)
        if state == before:
            break
    leaves = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return leaves.unionByName(roots)


def joined_components(comps: DataFrame, links: DataFrame) -> DataFrame:
    """The components (node, component) that result when links (a, b) are added to comps; only components that a
    link joins are worked on. A node of a link that comps does not have is a component of its own so far."""
    ca, cb = (comps.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in ("a", "b"))
    between = links.join(ca, "a", "left").join(cb, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a != b")
    moved = connected_components(between)
    known = comps.join(moved.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    new = moved.join(comps.select("node"), "node", "left_anti")
    return materialise(known.unionByName(new.select("node", "component")))
