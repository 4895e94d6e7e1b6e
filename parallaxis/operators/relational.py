"""Joins, ordinals and set operations on frames and poses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import matrix_to_quat, resize_crop


def ordinal(df: DataFrame, order: list[str], out: str = "frame_idx") -> DataFrame:
    """0-based position in the given order (W1, W2). One row a frame, so a single ordered pass."""
    return df.withColumn(out, F.row_number().over(W.orderBy(*order)) - 1)


def sample_frames(df: DataFrame, idx: str, video_fps: float, fps: float, video: str | None = None) -> DataFrame:
    """Every interval-th frame and the running index of those kept, in each video if one is named; the interval is the rates' quotient, at least 1
    (C1, W1). Frames that are missing leave no gap in the index."""
    interval = max(1, int(video_fps / fps))
    order = (W.partitionBy(video) if video else W).orderBy(idx)
    return df.where(F.col(idx) % interval == 0).withColumn("saved_idx", F.row_number().over(order) - 1)


def nth(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The row at 0-based position n (O2)."""
    return df.orderBy(*order).offset(n).limit(1)


def last_wins(df: DataFrame, key: str, position: str) -> DataFrame:
    """One row a key, that of the last position, by a partial aggregate."""
    rest = [x for x in df.columns if x != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(position)).alias("r")).select(key, *(F.col(f"r.{x}").alias(x) for x in rest))


def zip_shortest(left: DataFrame, left_order: list[str], right: DataFrame, right_order: list[str]) -> DataFrame:
    """Rows at equal positions, as many as the shorter side has."""
    return ordinal(left, left_order, "pos").join(ordinal(right, right_order, "pos"), "pos")


def pairs(df: DataFrame, idx: str, scene: str = "complete", window: int = 3) -> DataFrame:
    """Ordered pairs (i, j) of frames, both ways: all, a cyclic window, or those with frame 0.

    `complete` is as many rows as frames squared by definition; windows are made by generating neighbours.
    """
    i = df.select(F.col(idx).cast("int").alias("i"))
    if scene == "swin":
        n = df.agg(F.count("*").alias("n"))
        near = i.crossJoin(F.broadcast(n)).select("i", "n", F.explode(F.sequence(F.lit(1), F.lit(window))).alias("d")).select("i", F.pmod(F.col("i") + F.col("d"), F.col("n")).cast("int").alias("j")).where("i <> j")
        return near.union(near.select("j", "i")).distinct()
    if scene == "oneref":
        rest = i.where("i <> 0")
        return rest.select(F.lit(0).alias("i"), F.col("i").alias("j")).union(rest.select("i", F.lit(0).alias("j")))
    return i.join(i.select(F.col("i").alias("j")), F.col("i") != F.col("j"))


def candidates(points: DataFrame, masks: DataFrame, keys: list[str]) -> DataFrame:
    """Confident points whose pixel the mask covers; both filters run before the join."""
    return points.where("conf").join(masks.where("m > 0.5").select(*keys).distinct(), keys, "left_semi")


def with_rasters(poses: DataFrame, masks: DataFrame, depths: DataFrame, key: str = "filename") -> DataFrame:
    """Every pose with its mask (default 0) and depth; a depth counts only if there is a mask."""
    both = poses.join(masks.withColumn("has_mask", F.lit(True)), key, "left").join(depths, key, "left")
    depth = F.when(F.col("has_mask"), F.coalesce("depth", F.lit(0.0))).otherwise(F.lit(0.0))
    return both.withColumn("mask", F.coalesce("mask", F.lit(0))).withColumn("depth", depth).drop("has_mask")


def union_masks(detections: DataFrame, keys: list[str], threshold: float = 0.3) -> DataFrame:
    """Union of the masks that score above the threshold; an accepted empty mask still gives rows of 0."""
    return detections.where(F.col("score") > threshold).groupBy(*keys).agg(F.max(F.col("m").cast("int")).alias("m"))


def painted(df: DataFrame, keys: list[str]) -> DataFrame:
    """Pixels that any point lands on, once each (A5)."""
    return df.select(*keys).distinct()


def fixed_sample(df: DataFrame, n: int, key: Column) -> DataFrame:
    """n rows in hash order, all if there are no more; the same rows on every run (O3)."""
    return df.orderBy(F.md5(key.cast("string").cast("binary")), key).limit(n)


def coloured_union(whole: DataFrame, part: DataFrame, n: int, order: list[str]) -> DataFrame:
    """Both geometries, tagged; the second recoloured and cut to half of n."""
    a = whole.withColumns({"tag": F.lit("full"), "r": F.coalesce(F.col("r"), F.lit(1.0)), "g": F.coalesce(F.col("g"), F.lit(1.0)), "b": F.coalesce(F.col("b"), F.lit(1.0))})
    b = part.orderBy(*order).limit(n // 2).withColumns({"tag": F.lit("segmented"), "r": F.lit(1.0), "g": F.lit(0.45), "b": F.lit(0.0)})
    return a.unionByName(b)


def side_by_side(left: DataFrame, right: DataFrame, width) -> DataFrame:
    """Pixels (v, u, ...) of two images of one height next to each other: the second is moved by the first one's width."""
    return left.unionByName(right.withColumn("u", F.col("u") + width))


def pose_records(scene: DataFrame, frames: DataFrame, image_size: int) -> DataFrame:
    """Pose records in the files' form: scene outputs (pos, rotation r00..r22, tx, ty, tz, focal, processed size) zipped with frames (filename,
    original size) by position, as many as the shorter side has, and the resize and crop that the size implies (C11, K3, J7, F1, F2)."""
    named = frames.select("filename", "original_width", "original_height")
    both = scene.join(ordinal(named, ["filename"], "pos"), "pos")
    q = matrix_to_quat([[F.col(f"r{i}{j}") for j in range(3)] for i in range(3)])
    crop = resize_crop("original_width", "original_height", image_size)
    return both.select(
        F.col("pos").cast("int").alias("frame_idx"), "filename", "tx", "ty", "tz", *(x.alias(n) for x, n in zip(q, ("qx", "qy", "qz", "qw"), strict=True)),
        "focal", "processed_width", "processed_height", "original_width", "original_height", *(x.alias(n) for n, x in crop.items()),
    )


def report(metrics: DataFrame) -> DataFrame:
    """One line of text for the counts of a reprojection check."""
    share = F.when(F.col("n_confident") > 0, F.col("n_inside") * 100.0 / F.col("n_confident")).otherwise(F.lit(0.0))
    return metrics.select(F.format_string("%d points, %d confident, %d in front, %d inside (%.1f%%)", "n_points", "n_confident", "n_front", "n_inside", share).alias("line"))
