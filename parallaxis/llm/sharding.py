"""Sharding by a keyed permutation of global row numbers, in DataFrame operations only.

Row numbers are permuted by a Feistel network over a rectangle just larger than the row count; numbers that leave the range walk on along
their cycle. Permuted number p lies in shard p mod n at slot p div n, so counts differ by one at most.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .runtime import shielded

#: Rows of a bucket, on average, in which rows are numbered; only the buckets' counts are summed in one place.
BUCKET_ROWS = 256
#: Buckets at most: their counts are broadcast.
BUCKETS = 1 << 18
ROUNDS = 6
#: Steps of a walk that the plan has room for. A longer one has odds below 2^-(6 * 64) and stops the query.
WALK = 64


def permute(number: Column, n: int, seed: int, rounds: int = ROUNDS) -> Column:
    """The image of a number in 0..n-1 under the permutation of this range that the seed names."""
    a = max(1, isqrt(max(n, 1) - 1) + 1)
    b = -(-max(n, 1) // a)

    def network(x: Column) -> Column:
        # left counts modulo a, right modulo b; each round adds a hash of the one to the other, which can be undone.
        right = F.pmod(x, F.lit(b)).cast("long")
        pair = F.struct(((x - right) / F.lit(b)).cast("long").alias("l"), right.alias("r"))
        steps = F.sequence(F.lit(1), F.lit(rounds))

        def turn(acc: Column, i: Column) -> Column:
            to_left = F.pmod(acc["l"] + F.pmod(F.xxhash64(F.lit(seed), i, acc["r"]), F.lit(a)), F.lit(a))
            to_right = F.pmod(acc["r"] + F.pmod(F.xxhash64(F.lit(seed), i, acc["l"]), F.lit(b)), F.lit(b))
            return F.struct(F.when(i % 2 == 1, to_left).otherwise(acc["l"]).cast("long").alias("l"), F.when(i % 2 == 0, to_right).otherwise(acc["r"]).cast("long").alias("r"))

        return F.aggregate(steps, pair, turn, lambda acc: acc["l"] * F.lit(b) + acc["r"])

    walk = min(WALK, max(0, a * b - n))
    first = network(number)
    if not walk:
        return first
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(walk)), first, lambda acc, _: F.when(acc < n, acc).otherwise(network(acc)))
    return F.when(first < n, first).when(walked < n, walked).otherwise(F.raise_error(F.lit("a walk was longer than the plan has room for")).cast("long"))


def shard_rows(df: DataFrame, shards: int = 16, seed: int = 11, key_cols: list[str] | None = None, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """The input with row_number, shard and slot; slots of a shard run from 0 without gaps, counts differ by one at most.

    Rows are numbered bucket by bucket of a hash of the key columns (all, if none are named), inside a bucket by these columns,
    so the numbers depend on the rows only and reruns agree. Rows alike in all key columns are interchangeable:
    they get different numbers in any order. Nulls count as values of their own. An empty table gives an empty table; input columns
    named like a result are replaced.
    """
    held, at = shielded(df)
    keys = [at[c.lower()] for c in key_cols or df.columns]
    n = df.count()
    buckets = min(BUCKETS, n // BUCKET_ROWS + 1)
    dealt = held.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    counts = dealt.groupBy("bucket").agg(F.count("*").alias("n"))
    # BUCKETS rows at most, whatever the input: summed up in one task and broadcast.
    bases = counts.select(F.col("bucket").alias("b"), (F.sum("n").over(W.orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n")).alias("base"))
    inside = F.row_number().over(W.partitionBy("bucket").orderBy(*keys)) - 1
    numbered = dealt.withColumn("inside", inside).join(F.broadcast(bases), F.col("bucket") == F.col("b")).withColumn("number", F.col("inside") + F.col("base"))
    placed = numbered.withColumn("place", permute(F.col("number"), n, seed))
    made = {"row_number", shard.lower(), slot.lower()}
    keep = [F.col(at[c.lower()]).alias(c) for c in df.columns if c.lower() not in made]
    return placed.select(*keep, F.col("number").alias("row_number"), (F.col("place") % shards).cast("int").alias(shard), F.floor(F.col("place") / shards).cast("long").alias(slot))
