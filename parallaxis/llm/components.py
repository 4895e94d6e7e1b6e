"""Connected components of a link table by alternating star contractions, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .runtime import BROADCAST_BYTES, Scratch, materialise

#: Bytes that a row of two longs may take when it is broadcast.
ROW_BYTES = 32


def _kept(scratch: Scratch, edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges, written, and what tells them from others: their number and two sums, observed while they are written."""
    seen = Observation()
    sums = F.count("*").alias("n"), F.expr("bit_xor(xxhash64(hi, lo))").alias("x"), F.expr("sum(cast(xxhash64(lo, hi) as decimal(38,0)))").alias("s")
    table = scratch.keep(edges.observe(seen, *sums))
    return table, tuple(seen.get[c] for c in ("n", "x", "s"))


def _components(links: DataFrame, a: str, b: str, scratch: Scratch) -> DataFrame:
    edges, state = _kept(scratch, links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct())
    while state[0]:
        # The least neighbour of each node: broadcast while there are few links, joined by a shuffle else.
        few = F.broadcast if 2 * state[0] * ROW_BYTES <= BROADCAST_BYTES else lambda df: df
        # Large star: larger neighbours move to the smallest of the neighbourhood.
        both = edges.union(edges.select("lo", "hi"))
        least = both.groupBy("hi").agg(F.min("lo").alias("m")).select(F.col("hi").alias("at"), F.least("hi", "m").alias("m"))
        large = both.where("lo > hi").join(few(least), F.col("hi") == F.col("at")).select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi <> lo")
        # Small star: smaller neighbours, and the node, move to the smallest.
        low = large.groupBy("hi").agg(F.min("lo").alias("m")).select(F.col("hi").alias("at"), "m")
        small = large.join(few(low), F.col("hi") == F.col("at")).select("hi", "lo", "m")
        moved = small.select("hi", F.col("m").alias("lo")).union(small.select(F.col("lo").alias("hi"), F.col("m").alias("lo")))
        before, old = state, edges
        edges, state = _kept(scratch, moved.where("hi <> lo").distinct())
        scratch.drop(old)
        if before == state:
            break
    roots = edges.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(roots)


def connected_components(links: DataFrame, a: str = "a", b: str = "b", scratch: Scratch | None = None) -> DataFrame:
    """(node, root) for every node of the links (a, b); root is the smallest node that can be reached.

    A step replaces a node's links by links to its smallest neighbour. The number of links never
    grows, rows of one node are only ever reduced by a partial aggregate or joined, and each step is
    written to the shared folder and replaces the one before. Links of a node with itself and null ends are left out; an
    empty table gives an empty table. With a scratch the result is one of its tables.
    """
    if scratch is not None:
        return scratch.keep(_components(links, a, b, scratch))
    own = Scratch(links.sparkSession)
    try:
        return materialise(_components(links, a, b, own))
    finally:
        own.clear()


def joined_components(roots: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) as connected_components gives it, for known roots and more links (a, b)."""
    of = lambda x: roots.select(F.col("node").alias(f"n{x}"), F.col("root").alias(f"r{x}"))
    named = links.join(of("a"), F.col("a") == F.col("na"), "left").join(of("b"), F.col("b") == F.col("nb"), "left")
    new = connected_components(named.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")), scratch=scratch)
    up = new.select(F.col("node").alias("at"), F.col("root").alias("top"))
    moved = roots.join(up, F.col("root") == F.col("at"), "left").select("node", F.coalesce("top", "root").alias("root"))
    return scratch.keep(moved.union(new.join(roots.select("node"), "node", "left_anti")))
