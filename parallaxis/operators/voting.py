"""Votes of cameras on points: project, look up mask and depth, count agreement."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import depth_agrees, inside_truncated, quat_to_matrix, truncated
from ..runtime import ship_package

CAMERA_FIELDS = ["cam", *(f"r{i}{j}" for i in range(3) for j in range(3)), "tx", "ty", "tz", "fx", "fy", "ux", "uy"]

#: Cameras that may be broadcast; one row has 17 numbers, so this many are a few megabytes.
BROADCAST_CAMERAS = 50_000
#: Cameras that may be a constant of a plan.
LITERAL_CAMERAS = 1_000
#: Bytes of masks and depths that are broadcast at once.
RASTER_BYTES = 64 << 20


def camera_matrices(poses: DataFrame, width: int, height: int) -> DataFrame:
    """One row a camera: rotation, translation, focal lengths and centre for a raster of this size."""
    m = quat_to_matrix("qx", "qy", "qz", "qw")
    pw = F.coalesce("processed_width", F.lit(width)) if "processed_width" in poses.columns else F.lit(width)
    ph = F.coalesce("processed_height", F.lit(height)) if "processed_height" in poses.columns else F.lit(height)
    return poses.select(
        "cam", *(m[i][j].alias(f"r{i}{j}") for i in range(3) for j in range(3)), "tx", "ty", "tz",
        (F.col("focal") * F.lit(width) / pw).alias("fx"), (F.col("focal") * F.lit(height) / ph).alias("fy"),
        F.lit(width / 2).alias("ux"), F.lit(height / 2).alias("uy"),
    )


def literal_cameras(cameras: DataFrame) -> DataFrame:
    """The camera table worked out once and handed back as constants, so that no pair derives it anew. One row a camera."""
    rows = cameras.limit(BROADCAST_CAMERAS + 1).collect()
    if len(rows) > BROADCAST_CAMERAS:
        return cameras
    return cameras.sparkSession.createDataFrame(rows, cameras.schema)


def _tasks(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def projected(points: DataFrame, cameras: DataFrame, key: str, partitions: int | None = None) -> DataFrame:
    """Each point before each camera: cz, u, v for points in front.

    Every point meets every camera by definition. The camera table is broadcast if its counted rows allow. Points, four numbers
    each, are spread over all tasks first: a few files would else mean a few tasks, and the exchange keeps their columns from being worked
    out again for every pair.
    """
    spread = points.select(key, "x", "y", "z").repartition(partitions) if partitions else _spread(points.select(key, "x", "y", "z"))
    small = literal_cameras(cameras)
    pairs = spread.crossJoin(F.broadcast(small) if small is not cameras else small)
    d = [F.col("x") - F.col("tx"), F.col("y") - F.col("ty"), F.col("z") - F.col("tz")]
    eye = F.struct(*((F.col(f"r0{i}") * d[0] + F.col(f"r1{i}") * d[1] + F.col(f"r2{i}") * d[2]).alias(n) for i, n in enumerate(("x", "y", "z"))))
    # Exploded, so that conditions on the values are not pushed into the join with the values worked out anew for each mention.
    front = pairs.select(key, "cam", "fx", "fy", "ux", "uy", F.explode(F.array(eye)).alias("eye")).where("eye.z > 0 and not isnan(eye.z)")
    pixel = F.struct((F.col("fx") * F.col("eye.x") / F.col("eye.z") + F.col("ux")).alias("u"), (F.col("fy") * F.col("eye.y") / F.col("eye.z") + F.col("uy")).alias("v"))
    return front.select(key, "cam", F.col("eye.z").alias("cz"), F.explode(F.array(pixel)).alias("px")).select(key, "cam", "cz", "px.u", "px.v")


def ballots(points: DataFrame, cameras: DataFrame, key: str, width: int, height: int, mask: Callable[..., Column], depth: Callable[..., Column], absolute: float = 0.03, relative: float = 0.05) -> DataFrame:
    """(key, cam) for each vote: in front, in bounds after truncation, on the mask, at the stored depth.

    mask and depth are columns of (cam, u, v): arithmetic, or a lookup in a packed raster.
    """
    seen = projected(points, cameras, key).where(inside_truncated("u", "v", width, height))
    at = seen.select(key, "cam", "cz", truncated("u").alias("ui"), truncated("v").alias("vi"))
    cols = F.col("cam"), F.col("ui"), F.col("vi")
    return at.where(mask(*cols) & depth_agrees("cz", F.coalesce(depth(*cols), F.lit(0.0)), absolute, relative)).select(key, "cam")


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f mentions it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _camera_array(cameras: DataFrame) -> Column | None:
    """All cameras as one constant, if they are LITERAL_CAMERAS at most."""
    rows = cameras.select(*CAMERA_FIELDS).limit(LITERAL_CAMERAS + 1).collect()
    if len(rows) > LITERAL_CAMERAS or not rows:
        return None
    return F.array(*(F.struct(*(F.lit(r[f]).alias(f) for f in CAMERA_FIELDS)) for r in rows))


def votes_in_row(cameras: Column, width: int, height: int, mask: Callable[..., Column], depth: Callable[..., Column], absolute: float = 0.03, relative: float = 0.05) -> Column:
    """Votes of an array of cameras on the point (x, y, z) of a row: nothing is joined, and each value is worked out once."""

    def one(c: Column) -> Column:
        d = [F.col(p) - c[t] for p, t in zip("xyz", ("tx", "ty", "tz"), strict=True)]
        eye = F.struct(*((c[f"r0{i}"] * d[0] + c[f"r1{i}"] * d[1] + c[f"r2{i}"] * d[2]).alias(n) for i, n in enumerate(("x", "y", "z"))))

        def look(e: Column, px: Column) -> Column:
            # Positions in (-1, 0) are cut to 0, so they are inside.
            inside = (px["u"] > -1) & (px["u"] < width) & (px["v"] > -1) & (px["v"] < height)
            at = F.struct(px["u"].cast("int").alias("u"), px["v"].cast("int").alias("v"))
            agrees = lambda at: mask(c["cam"], at["u"], at["v"]) & _once(F.coalesce(depth(c["cam"], at["u"], at["v"]).cast("double"), F.lit(0.0)), lambda z: depth_agrees(e["z"], z, absolute, relative))
            return F.when(inside, _once(at, lambda at: F.when(agrees(at), 1).otherwise(0))).otherwise(0)

        pixel = lambda e: F.struct((c["fx"] * e["x"] / e["z"] + c["ux"]).alias("u"), (c["fy"] * e["y"] / e["z"] + c["uy"]).alias("v"))
        return _once(eye, lambda e: F.when((e["z"] > 0) & ~F.isnan(e["z"]), _once(pixel(e), lambda px: look(e, px))).otherwise(0))

    return F.aggregate(cameras, F.lit(0), lambda n, c: n + one(c))


def vote(points: DataFrame, cameras: DataFrame, key: str, width: int, height: int, mask, depth, min_votes: int = 2, absolute: float = 0.03, relative: float = 0.05) -> DataFrame:
    """(key, votes) of points with min_votes or more; with 0, points without a vote too (A2, A3).

    Up to LITERAL_CAMERAS cameras are a constant of the plan and votes are counted in each point's row, so there is no join and
    points are only spread over the tasks. More cameras are joined and their ballots counted by point.
    """
    cams = _camera_array(cameras)
    if cams is not None:
        votes = votes_in_row(cams, width, height, mask, depth, absolute, relative)
        # Filtered inside explode: a filter behind it would be pushed below and count the votes twice.
        kept = F.explode(F.filter(F.array(votes), lambda n: n >= min_votes)).alias("votes")
        return _spread(points.select(key, "x", "y", "z")).select(key, kept)
    counted = ballots(points, cameras, key, width, height, mask, depth, absolute, relative).groupBy(key).agg(F.count("*").cast("int").alias("votes"))
    if min_votes <= 0:
        return points.select(key).join(counted, key, "left").select(key, F.coalesce("votes", F.lit(0)).alias("votes"))
    return counted.where(F.col("votes") >= min_votes)


def _spread(points: DataFrame) -> DataFrame:
    """The points over all tasks, if they lie in fewer partitions than there are."""
    if points.isStreaming:
        return points.repartition(_tasks(points))
    if points.rdd.getNumPartitions() >= points.sparkSession.sparkContext.defaultParallelism:
        return points
    return points.repartition(_tasks(points))


def _count_votes(rows: np.ndarray, p: np.ndarray, width: int, height: int, look: Callable, absolute: float, relative: float) -> np.ndarray:
    """Votes of cameras (rows of CAMERA_FIELDS) on points [3, n]; look(camera's place, u, v) gives mask and depth there."""
    votes = np.zeros(p.shape[1], dtype=np.int32)
    for k, row in enumerate(rows):
        r, t, (fx, fy, ux, uy) = row[1:10].reshape(3, 3), row[10:13], row[13:]
        d = p - t[:, None]
        cx, cy, cz = (r[0, i] * d[0] + r[1, i] * d[1] + r[2, i] * d[2] for i in range(3))
        ok = cz > 0
        with np.errstate(all="ignore"):
            u, v = np.trunc(fx * cx / cz + ux), np.trunc(fy * cy / cz + uy)
        at = np.flatnonzero(ok & (u >= 0) & (u < width) & (v >= 0) & (v < height))
        on, z = look(k, u[at].astype(int), v[at].astype(int))
        votes[at] += on & (np.abs(cz[at] - z) <= np.maximum(absolute, relative * z))
    return votes


def _camera_rows(cameras: DataFrame) -> np.ndarray:
    """Cameras as an array, one row each; more than BROADCAST_CAMERAS are refused, as each point meets each of them."""
    rows = cameras.select(*CAMERA_FIELDS).limit(BROADCAST_CAMERAS + 1).collect()
    if len(rows) > BROADCAST_CAMERAS:
        raise ValueError(f"more than {BROADCAST_CAMERAS} cameras")
    return np.array([[r[f] for f in CAMERA_FIELDS] for r in rows], dtype=float).reshape(-1, len(CAMERA_FIELDS))


def vote_rasters(points: DataFrame, cameras: DataFrame, rasters: DataFrame, key: str, width: int, height: int, min_votes: int = 2, absolute: float = 0.03, relative: float = 0.05) -> DataFrame:
    """Votes against packed rasters: rasters(cam, mask array<tinyint>, depth array<float>), row-major.

    Cameras go in blocks whose rasters have RASTER_BYTES at most; each block is broadcast and adds its votes to the points where they
    lie, so points are never shuffled by camera or by point. A camera without a mask never votes; without a depth only points within the
    absolute tolerance of 0 agree.
    """
    ship_package(points.sparkSession)
    with_raster = cameras.join(rasters.select("cam").distinct(), "cam", "left_semi").orderBy("cam")
    rows = _camera_rows(with_raster)
    per = max(1, RASTER_BYTES // (5 * width * height))
    name = points.schema[key].dataType.simpleString()
    at = _spread(points.select(key, *(F.col(c).cast("double").alias(c) for c in "xyz")).withColumn("votes", F.lit(0)))
    for lo in range(0, len(rows), per):
        block = rows[lo : lo + per]
        masks, depths = np.zeros((len(block), height * width), dtype=bool), np.zeros((len(block), height * width), dtype=np.float32)
        place = {int(r[0]): i for i, r in enumerate(block)}
        for r in rasters.where(F.col("cam").isin(list(place))).select("cam", "mask", "depth").toLocalIterator():
            for to, values in ((masks, r["mask"]), (depths, r["depth"])):
                if values is not None:
                    flat = np.array([x or 0 for x in values][: height * width])
                    to[place[int(r["cam"])], : len(flat)] = flat > 0 if to is masks else flat
        held = points.sparkSession.sparkContext.broadcast((block, masks, depths))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            block, masks, depths = held.value
            look = lambda k, u, v: (masks[k, v * width + u], depths[k, v * width + u].astype(float))
            for batch in batches:
                p = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3)])
                votes = batch.column(4).to_numpy(zero_copy_only=False) + _count_votes(block, p, width, height, look, absolute, relative)
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(votes, pa.int32())], names=[key, "x", "y", "z", "votes"])

        at = at.mapInArrow(run, f"`{key}` {name}, x double, y double, z double, votes int")
    return at.select(key, "votes").where(F.col("votes") >= min_votes)


def vote_arrow(points: DataFrame, cameras: DataFrame, key: str, width: int, height: int, mask, depth, min_votes: int = 2, absolute: float = 0.03, relative: float = 0.05) -> DataFrame:
    """The same votes by a numpy kernel over Arrow batches, as a cross-check (X1). mask and depth take arrays (cam, u, v)."""
    ship_package(points.sparkSession)
    rows = _camera_rows(cameras)
    look = lambda k, u, v: (mask(int(rows[k, 0]), u, v), depth(int(rows[k, 0]), u, v))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_count_votes(rows, p, width, height, look, absolute, relative))], names=[key, "votes"])

    name = points.schema[key].dataType.simpleString()
    return _spread(points.select(key, *(F.col(c).cast("double").alias(c) for c in "xyz"))).mapInArrow(run, f"`{key}` {name}, votes int").where(F.col("votes") >= min_votes)
