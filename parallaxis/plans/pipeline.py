"""Segmenting points by votes, mapping points back to frames, and the reprojection checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import c, depth_agrees, inside_float, nearest_source, quat_to_matrix, to_camera, to_original, truncated
from ..operators.rasters import bilinear, fix_orientation, mask_source_pixel
from ..operators.relational import candidates, last_wins, ordinal, painted
from ..operators.voting import _spread, camera_matrices, literal_cameras, vote_rasters
from ..sources.readers import pixels, read_npz, read_poses


def fitted_mask(height, width) -> Column:
    """The mask in (data, height_m, width_m) at this size, 1 where it is set (F8): as it is if of this size; else, if the pose has
    resized_*, resized to that and cut at crop_left and crop_top, 0 outside; else resized to this size."""
    height, width, mh, mw = c(height), c(width), F.col("height_m"), F.col("width_m")
    rh, rw = F.coalesce("resized_height", height), F.coalesce("resized_width", width)
    resized = F.col("resized_height").isNotNull() & F.col("resized_width").isNotNull()
    top, left = (F.coalesce(x, F.lit(0.0)) for x in ("crop_top", "crop_left"))

    def at(i: Column) -> Column:
        v, u = F.floor(i / width), i % width
        sv, su = mask_source_pixel(v, u, mh, mw, rh, rw, top, left)
        rv, ru = v + F.bround(top), u + F.bround(left)
        cut = F.when((rv >= 0) & (rv < rh) & (ru >= 0) & (ru < rw), F.get("data", sv * mw + su))
        plain = F.get("data", nearest_source(v, height, mh) * mw + nearest_source(u, width, mw))
        value = F.when((mh == height) & (mw == width), F.get("data", i)).when(resized, cut).otherwise(plain)
        return F.coalesce(value > 0.5, F.lit(False)).cast("tinyint")

    return F.transform(F.sequence(F.lit(0), (height * width - 1).cast("int")), at)


def fitted_depth(height: int, width: int) -> Column:
    """The depth in (data, height, width) at this size: as it is, or by a bilinear resize."""
    grid = F.sequence(F.lit(0), F.lit(height * width - 1))
    resized = F.transform(grid, lambda i: bilinear(F.col("data"), F.floor(i / width), i % width, F.col("height"), F.col("width"), height, width).cast("float"))
    return F.when((F.col("height") == height) & (F.col("width") == width), F.col("data")).otherwise(resized)


def segment_points(spark: SparkSession, poses_path: str, masks_dir: str, depths_dir: str, points_dir: str, min_votes: int = 2, depth_abs: float = 0.03, depth_rel: float = 0.05) -> DataFrame:
    """Points under a mask that at least min_votes cameras agree on (x, y, z, votes).

    All cameras use the raster size of the first pose (F6, F11): the size in the pose, else that of its points; masks are
    brought to this size by the pose's resize and crop or by nearest lookup (F8), for candidates to the size of the frame's points, and
    depths by a bilinear resize (F9). Cameras without a mask never vote; without a depth only points near 0 agree.
    """
    poses = ordinal(last_wins(read_poses(spark, poses_path), "filename", "frame_idx"), ["filename"], "cam")
    points = read_npz(spark, points_dir, "pts3d", "*_pts3d.npz", "_pts3d.npz")
    conf = read_npz(spark, points_dir, "mask", "*_pts3d.npz", "_pts3d.npz")
    first = poses.orderBy("cam").join(F.broadcast(points.select("filename", "height", "width")), "filename", "left").orderBy("cam").first()
    if first is None:
        raise ValueError("no poses")
    height, width = first["height"] or first["processed_height"], first["width"] or first["processed_width"]
    if not height or not width:
        raise ValueError("neither points nor the pose give a raster size")
    cameras = camera_matrices(poses, width, height)

    masks = read_npz(spark, masks_dir, "mask").withColumnsRenamed({"height": "height_m", "width": "width_m"})
    posed = masks.join(poses.select("filename", "resized_width", "resized_height", "crop_left", "crop_top"), "filename")
    mask = posed.select("filename", fitted_mask(height, width).alias("mask"))
    depth = read_npz(spark, depths_dir, "depth", "*_depth.npz", "_depth.npz").select("filename", fitted_depth(height, width).alias("depth"))
    rasters = poses.select("filename", "cam").join(mask, "filename").join(depth, "filename", "left").select("cam", "mask", "depth")

    cloud = pixels(points, "x", "y", "z").join(pixels(conf, "c"), ["filename", "v", "u"]).withColumn("conf", F.col("c") > 0)
    sized = posed.join(points.select("filename", "height", "width"), "filename")
    flat = sized.select("filename", "height", "width", fitted_mask("height", "width").alias("data"))
    kept = candidates(cloud.join(poses.select("filename"), "filename", "left_semi"), pixels(flat, "m"), ["filename", "v", "u"])
    keyed = kept.select(F.xxhash64("filename", "v", "u").alias("point"), *(F.col(x).cast("double").alias(x) for x in "xyz"))
    votes = vote_rasters(keyed, cameras, rasters, "point", width, height, min_votes, depth_abs, depth_rel)
    return keyed.join(votes, "point").select("x", "y", "z", "votes")


def project_to_frames(points: DataFrame, poses: DataFrame, depths: DataFrame | None = None, depth_abs: float = 0.03, depth_rel: float = 0.05) -> DataFrame:
    """Pixels (filename, v, u) of the original images that points land on, once each.

    poses hold processed_*, original_* and, in newer files, resized_* and crop_*; depths (filename, v, u, depth) may be lacking for a frame.
    """
    m = quat_to_matrix("qx", "qy", "qz", "qw")
    pw, ph = F.col("processed_width"), F.col("processed_height")
    cams = poses.select("filename", *(m[i][j].alias(f"r{i}{j}") for i in range(3) for j in range(3)), "tx", "ty", "tz", "focal", pw.alias("pw"), ph.alias("ph"), "original_width", "original_height", F.coalesce("resized_width", pw).alias("rw"), F.coalesce("resized_height", ph).alias("rh"), F.coalesce("crop_left", F.lit(0.0)).alias("cl"), F.coalesce("crop_top", F.lit(0.0)).alias("ct"))
    # Frames are few: their poses are counted and broadcast, points are spread and stay where they are.
    small = literal_cameras(cams)
    pairs = _spread(points.select("x", "y", "z")).crossJoin(F.broadcast(small) if small is not cams else small)
    r = [[F.col(f"r{i}{j}") for j in range(3)] for i in range(3)]
    eye = F.struct(*(x.alias(n) for x, n in zip(to_camera(r, ("tx", "ty", "tz"), ("x", "y", "z")), ("x", "y", "z"), strict=True)))
    frame = ["filename", "focal", "pw", "ph", "original_width", "original_height", "rw", "rh", "cl", "ct"]
    # Exploded, so that conditions are not pushed into the join with the values worked out anew for each mention.
    front = pairs.select(*frame, F.explode(F.array(eye)).alias("eye")).where("eye.z > 0 and not isnan(eye.z)")
    pixel = F.struct((F.col("focal") * F.col("eye.x") / F.col("eye.z") + F.col("pw") / 2).alias("u"), (F.col("focal") * F.col("eye.y") / F.col("eye.z") + F.col("ph") / 2).alias("v"))
    seen = front.select(*frame, F.col("eye.z").alias("cz"), F.explode(F.array(pixel)).alias("px")).select(*frame, "cz", F.col("px.u").alias("pu"), F.col("px.v").alias("pv"))
    # Positions in (-1, 0) are cut to 0, so they are inside.
    seen = seen.where("pu > -1 and pu < pw and pv > -1 and pv < ph")
    ui, vi = truncated("pu"), truncated("pv")
    if depths is not None:
        d = depths.select(F.col("filename").alias("df"), F.col("v").alias("dv"), F.col("u").alias("du"), "depth")
        seen = seen.join(d, (F.col("filename") == F.col("df")) & (vi == F.col("dv")) & (ui == F.col("du")), "left").where(F.col("depth").isNull() | depth_agrees("cz", "depth", depth_abs, depth_rel))
    out = seen.select("filename", to_original("pv", "ct", "original_height", "rh").alias("v"), to_original("pu", "cl", "original_width", "rw").alias("u"), "original_width", "original_height")
    return painted(out.where("u >= 0 and u < original_width and v >= 0 and v < original_height"), ["filename", "v", "u"])


def reprojection_metrics(points: DataFrame, pose: DataFrame, width: int, height: int) -> DataFrame:
    """Points in all, confident, in front and inside the image, for one pose."""
    m = quat_to_matrix("qx", "qy", "qz", "qw")
    one = pose.limit(1).select(*(m[i][j].alias(f"r{i}{j}") for i in range(3) for j in range(3)), "tx", "ty", "tz", "focal")
    at = points.crossJoin(F.broadcast(one))
    cx, cy, cz = to_camera([[F.col(f"r{i}{j}") for j in range(3)] for i in range(3)], ("tx", "ty", "tz"), ("x", "y", "z"))
    seen = at.withColumns({"cx": cx, "cy": cy, "cz": cz}).withColumn("ok", F.col("conf") & (F.col("cz") > 0))
    u = F.when(F.col("ok"), F.col("focal") * F.col("cx") / F.col("cz") + width / 2)
    v = F.when(F.col("ok"), F.col("focal") * F.col("cy") / F.col("cz") + height / 2)
    hit = seen.withColumn("hit", F.coalesce(inside_float(u, v, width, height), F.lit(False)))
    return hit.agg(F.count("*").alias("n_points"), F.count_if("conf").alias("n_confident"), F.count_if("ok").alias("n_front"), F.count_if("hit").alias("n_inside"))


__all__ = ["fix_orientation", "project_to_frames", "reprojection_metrics", "segment_points"]
