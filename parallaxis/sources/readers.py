"""Readers. Files are opened by Spark, so any store that it reads will do; a raster is one row."""

from __future__ import annotations

import io
import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship_package
from .schema import KEYFRAMES, POSE, RASTER


def _files(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)


def name_of(path):
    """Last part of a path."""
    return F.element_at(F.split(path, "/"), -1)


def list_frames(spark: SparkSession, folder: str, kind: str = "jpg") -> DataFrame:
    """File names in lexicographic order with 0-based positions and sizes in MiB.

    kind: jpg (exact case), image (jpg, jpeg, png in any case) or all.
    """
    found = _files(spark, folder, "*.jpg" if kind == "jpg" else "*").select(name_of("path").alias("filename"), (F.col("length") / 1048576).alias("size_mb"))
    if kind == "image":
        found = found.where(F.lower("filename").rlike(r"\.(jpg|jpeg|png)$"))
    return found.orderBy("filename")


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """Decoded frames: name, height, width, channels and bytes in BGR order (S3)."""
    return spark.read.format("image").load(folder).select(name_of("image.origin").alias("filename"), "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data")


def read_poses(spark: SparkSession, path: str) -> DataFrame:
    """Pose records of a JSON array; fields that a file lacks are null, a missing file raises."""
    return spark.read.schema(POSE).option("multiLine", True).json(path)


def read_keyframes(spark: SparkSession, path: str) -> DataFrame:
    """Keyframes with their position and the file's sizes; a file without keyframes raises."""
    whole = spark.read.schema(KEYFRAMES).option("multiLine", True).json(path)
    count = F.coalesce(F.size("keyframes"), F.lit(0))
    checked = whole.withColumn("keyframes", F.when(count > 0, F.col("keyframes")).otherwise(F.raise_error(F.lit("no keyframes in file"))))
    return checked.select("width", "height", F.posexplode("keyframes").alias("k", "kf")).select("k", "kf.*", "width", "height")


def _npz(content: bytes, key: str) -> np.ndarray:
    with np.load(io.BytesIO(content), allow_pickle=False) as z:
        return z[key]


def read_npz(spark: SparkSession, folder: str, key: str, glob: str = "*.npz", suffix: str = ".npz", frame_suffix: str = ".jpg") -> DataFrame:
    """One raster a file, named after its frame (S5, S6, S7, S8). A leading axis of length 1 is dropped; none of the files raises."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a = _npz(content, key)
                if a.ndim == 3 and a.shape[0] == 1:
                    a = a[0]
                if a.ndim == 2 and key == "pts3d":
                    a = a[None]
                h, w = a.shape[:2]
                name = path.rsplit("/", 1)[-1].removesuffix(suffix) + frame_suffix
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([h], pa.int32()), pa.array([w], pa.int32()), pa.array([a.shape[2] if a.ndim == 3 else 1], pa.int32()), pa.array([a.astype(np.float32).ravel()], pa.list_(pa.float32()))], names=["filename", "height", "width", "channels", "data"])

    ship_package(spark)
    files = _files(spark, folder, glob).select("path", "content")
    if files.isEmpty():
        raise FileNotFoundError(f"no {glob} in {folder}")
    return files.mapInArrow(run, RASTER)


def pixels(raster: DataFrame, *names: str) -> DataFrame:
    """A packed raster as (filename, v, u, values)."""
    n = len(names)
    at = raster.select("filename", "width", "data", F.explode(F.sequence(F.lit(0), F.col("height") * F.col("width") - 1)).alias("px"))
    return at.select("filename", F.expr("px div width").cast("int").alias("v"), (F.col("px") % F.col("width")).cast("int").alias("u"), *(F.get("data", F.col("px") * n + i).alias(x) for i, x in enumerate(names)))


def glb_points(content: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Positions and RGBA (0..1) of all primitives of a binary glTF file, node transforms applied; points without colour are white."""
    magic, _, length = struct.unpack_from("<4sII", content, 0)
    if magic != b"glTF":
        raise ValueError("not a binary glTF file")
    at, chunks = 12, {}
    while at < length:
        size, kind = struct.unpack_from("<I4s", content, at)
        chunks[kind] = content[at + 8 : at + 8 + size]
        at += 8 + size
    doc, blob = json.loads(chunks[b"JSON"]), chunks.get(b"BIN\0", b"")
    kinds = {5121: np.uint8, 5123: np.uint16, 5125: np.uint32, 5126: np.float32}
    width = {"SCALAR": 1, "VEC2": 2, "VEC3": 3, "VEC4": 4}

    def accessor(i: int) -> np.ndarray:
        a = doc["accessors"][i]
        view = doc["bufferViews"][a["bufferView"]]
        n, dt = width[a["type"]], np.dtype(kinds[a["componentType"]])
        start, stride = view.get("byteOffset", 0) + a.get("byteOffset", 0), view.get("byteStride", n * dt.itemsize)
        return np.ndarray((a["count"], n), dt, blob, start, (stride, dt.itemsize)).copy()

    xyz, rgba = [], []

    def visit(i: int, parent: np.ndarray) -> None:
        node = doc["nodes"][i]
        m = parent @ (np.array(node["matrix"], float).reshape(4, 4).T if "matrix" in node else np.eye(4))
        for prim in doc["meshes"][node["mesh"]]["primitives"] if "mesh" in node else []:
            p = accessor(prim["attributes"]["POSITION"]).astype(float)
            xyz.append(p @ m[:3, :3].T + m[:3, 3])
            col = accessor(prim["attributes"]["COLOR_0"]) if "COLOR_0" in prim["attributes"] else np.ones((len(p), 4))
            col = col / np.iinfo(col.dtype).max if col.dtype.kind == "u" else col.astype(float)
            rgba.append(col if col.shape[1] == 4 else np.c_[col, np.ones(len(col))])
        for child in node.get("children", []):
            visit(child, m)

    for i in doc["scenes"][doc.get("scene", 0)]["nodes"]:
        visit(i, np.eye(4))
    return (np.concatenate(xyz), np.concatenate(rgba)) if xyz else (np.zeros((0, 3)), np.zeros((0, 4)))


def read_glb(spark: SparkSession, folder: str, glob: str = "*.glb") -> DataFrame:
    """Points and colours of glTF scenes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                p, col = glb_points(content)
                cols = [*(p[:, i] for i in range(3)), *(col[:, i] for i in range(4))]
                yield pa.RecordBatch.from_arrays([pa.array([path.rsplit("/", 1)[-1]] * len(p), pa.string()), *(pa.array(x, pa.float64()) for x in cols)], names=["filename", *"xyzrgba"])

    ship_package(spark)
    return _files(spark, folder, glob).select("path", "content").mapInArrow(run, "filename string, " + ", ".join(f"{x} double" for x in "xyzrgba"))


def exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.format("binaryFile").load(path).limit(1).count()
    except AnalysisException:
        return False
    return True
