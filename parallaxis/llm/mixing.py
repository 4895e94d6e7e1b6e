"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

A document's expected copies follow the square root of its length within its source, so that short scraps
repeat less than full texts, up to a limit. Whole copies are certain; for the rest documents are ranked by
random odds over inclusion odds, and the lowest are taken until the source's words are used up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .runtime import free_name, materialise, shielded

WORD = r"[^\x20\x09-\x0D]+"
#: Ranges of the rank that a source's sizes are summed over before any row is ordered.
RANGES = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, source_col: str, size_col: str, weights: tuple[int, ...], limit: int) -> DataFrame:
    """(source, source_size, target): words by weight, none above limit times its size; the excess is shared again by weight.

    The share of a unit of weight is the largest of what would be left for it with the k tightest
    sources at their limits. One row for each source, so frames over all of them are small.
    """
    own = sized.groupBy(F.col(source_col).alias("source")).agg(F.sum(size_col).alias("source_size"))
    turn = F.row_number().over(W.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int"))
    ranked = own.withColumn("weight", weight)
    tight = W.orderBy((F.col("source_size") / F.col("weight")), F.asc_nulls_last("source"))
    before = F.coalesce(F.sum("source_size").over(tight.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(tight.rowsBetween(W.currentRow, W.unboundedFollowing))
    everything = F.sum("source_size").over(W.partitionBy())
    share = ranked.withColumn("share", (everything - F.lit(limit) * before) / left).withColumn("share", F.max("share").over(W.partitionBy()))
    target = F.least((F.col("source_size") * limit).cast("double"), F.col("share") * F.col("weight"))
    return share.select("source", "source_size", target.alias("target"))


def _draw(id_col: Column, text: Column | None, seed: int) -> Column:
    """A number in (0, 1) fixed by the id and the seed, where the id is null by the text."""
    key = id_col.cast("string")
    if text is not None:
        key = F.coalesce(key, F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key, F.lit(""))).cast("binary")), 1, 13), 16, 10)
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def mix_sources(df: DataFrame, id_col: str = "doc_id", text_col: str | None = "text", source_col: str = "source", size_col: str | None = None, weights: tuple[int, ...] = (5, 2, 1), limit: int = 3, seed: int = 7) -> DataFrame:
    """The input with size (words, unless a column holds them), source_size, target (words of its source) and copies.

    Sources in the order of their code points, null last, have the weights in turn and share as many words as there are
    in all. copies is what the mix takes of a document, at most limit; a source's taken words miss its target by half
    a document's length at most, or by a group of rows alike in id and length. Reruns agree: the draw depends on
    the id (where it is null, on the text) and the seed, and rows alike in these and in length are taken alike. Documents
    without words have no copies. An empty table gives an empty table; input columns named like a result are replaced.
    """
    made = ["size", "source_size", "target", "copies"]
    held, at = shielded(df)
    source, text = F.col(at[source_col.lower()]), F.col(at[text_col.lower()]) if text_col else None
    sized = held.withColumn("_words", F.coalesce(F.col(at[size_col.lower()]).cast("long"), F.lit(0).cast("long")) if size_col else word_count(text))
    drawn = sized.withColumn("_u", _draw(F.col(at[id_col.lower()]), text, seed))
    narrow = materialise(drawn.select(source.alias("source"), F.col("_words").alias("size"), F.col("_u").alias("u")))
    targets = source_targets(narrow, "source", "size", weights, limit)
    # Expected copies are least(limit, rate * root): the rate is the largest of what is left with the longest documents at the limit.
    sizes = narrow.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n"))
    root = F.floor(F.sqrt("size")).cast("long")
    longest = W.partitionBy("source").orderBy(F.desc("size"))
    full = F.coalesce(F.sum(F.col("size") * F.col("n")).over(longest.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("size") * F.col("n") * root).over(longest.rowsBetween(W.currentRow, W.unboundedFollowing))
    steps = sizes.withColumn("full", full).withColumn("rest", rest).withColumnRenamed("source", "s")
    rates = steps.join(targets, F.col("s").eqNullSafe(F.col("source"))).groupBy("s").agg(F.max((F.col("target") - F.lit(limit) * F.col("full")) / F.col("rest")).alias("rate"))
    plan = materialise(targets.join(rates, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "source_size", "target", F.coalesce("rate", F.lit(0.0)).alias("rate")))

    def ranked(rows: DataFrame, size: str, u: str) -> DataFrame:
        expected = F.least(F.lit(float(limit)), F.col("rate") * F.floor(F.sqrt(F.col(size))))
        rows = rows.withColumn("_sure", F.floor(expected).cast("long")).withColumn("_odd", expected - F.floor(expected))
        odds = (F.col(u) / (1 - F.col(u))) / (F.col("_odd") / (1 - F.col("_odd")))
        rows = rows.withColumn("_rank", F.when((F.col("_odd") > 0) & (F.col(size) > 0), odds / (1 + odds)))
        return rows.withColumn("_range", F.floor(F.col("_rank") * RANGES).cast("long"))

    placed = ranked(narrow.withColumnRenamed("source", "s").join(plan, F.col("s").eqNullSafe(F.col("source"))).drop("s"), "size", "u")
    sure = placed.groupBy("source").agg(F.first("target").alias("target"), F.sum(F.col("_sure") * F.col("size")).alias("sure"))
    left = sure.select(F.col("source").alias("s"), (F.col("target") - F.col("sure")).alias("left"))
    ranges = placed.where("_rank is not null").groupBy("source", "_range").agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(W.partitionBy("source").orderBy("_range").rowsBetween(W.unboundedPreceding, W.currentRow))
    cut = ranges.withColumn("upto", upto).join(left, F.col("source").eqNullSafe(F.col("s")))
    # The first range that goes beyond what is left is the only one whose rows are ordered.
    edge = cut.where("upto > left and upto - words <= left").select(F.col("s").alias("es"), F.col("_range").alias("edge"), (F.col("left") - F.col("upto") + F.col("words")).alias("room"))
    edge = materialise(edge)
    inside = placed.join(edge, F.col("source").eqNullSafe(F.col("es")) & (F.col("_range") == F.col("edge"))).groupBy("es", "_rank", "room").agg(F.sum("size").alias("words"))
    middle = F.sum("words").over(W.partitionBy("es").orderBy("_rank").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("words") / 2
    last = inside.withColumn("middle", middle).where("middle <= room").groupBy("es").agg(F.max("_rank").alias("last")).withColumnRenamed("es", "ls")
    params = plan.join(edge, F.col("source").eqNullSafe(F.col("es")), "left").join(last, F.col("source").eqNullSafe(F.col("ls")), "left")
    params = materialise(params.select(F.col("source").alias("_ps"), "source_size", "target", "rate", "edge", "last"))

    joined = drawn.join(params, source.eqNullSafe(F.col("_ps")))
    chosen = F.col("_rank").isNotNull() & (F.col("edge").isNull() | (F.col("_range") < F.col("edge")) | ((F.col("_range") == F.col("edge")) & (F.col("_rank") <= F.coalesce("last", F.lit(-1.0)))))
    out = ranked(joined, "_words", "_u").withColumn("copies", F.col("_sure") + F.when(chosen, 1).otherwise(0))
    keep = [F.col(at[c.lower()]).alias(c) for c in df.columns if c.lower() not in made]
    return out.select(*keep, F.col("_words").alias("size"), "source_size", "target", "copies")


def take_copies(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of each row as often as copies says; a row of 0 or null copies goes."""
    copy = free_name(mixed, "_copy")
    return mixed.where("copies > 0").withColumn(copy, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*columns)
