"""Writers. Rasters are written where they lie, one file a row; tables as Parquet or JSON lines by Spark itself.

A local or mounted folder that all executors see is asked for where single files are written.
"""

from __future__ import annotations

import json
import os
import shutil
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .schema import POSE


def prepare(folder: str, wipe: bool) -> None:
    """Empty the folder, or only make it: files of the same name are then replaced and others stay."""
    if wipe:
        shutil.rmtree(folder, ignore_errors=True)
    os.makedirs(folder, exist_ok=True)


def frame_name(idx):
    """frame_0007.jpg (K1)."""
    return F.format_string("frame_%04d.jpg", idx)


def write_npz(rasters: DataFrame, folder: str, key: str, dtype: str = "float32", suffix: str = ".npz") -> int:
    """One compressed file for each raster row, named by replacing .jpg wherever it stands (K2, K4, K6). Number of files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                shape = (r["height"], r["width"]) if r["channels"] == 1 else (r["height"], r["width"], r["channels"])
                path = os.path.join(folder, r["filename"].replace(".jpg", suffix))
                with open(f"{path}.part", "wb") as f:
                    np.savez_compressed(f, **{key: np.array(r["data"], dtype="float32").reshape(shape).astype(dtype)})
                os.replace(f"{path}.part", path)  # a task that runs twice leaves one file
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return rasters.select("filename", "height", "width", "channels", "data").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def write_poses(poses: DataFrame, path: str) -> None:
    """Poses as one JSON array in frame order, as the readers of such files expect (K3). One record a frame."""
    names = [f for f in POSE.fieldNames() if f in poses.columns]
    rows = [{k: v for k, v in r.asDict().items() if v is not None} for r in poses.select(*names).orderBy("frame_idx").toLocalIterator()]
    with open(path, "w") as f:
        json.dump(rows, f, indent=2)


def write_keyframes(keyframes: DataFrame, path: str, width: int, height: int) -> None:
    """Keyframes as one JSON file; the folder is made if the path names one (K9)."""
    rows = [r.asDict(recursive=True) for r in keyframes.orderBy("k").drop("k", "width", "height").toLocalIterator()]
    if os.path.dirname(path):
        os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        json.dump({"keyframes": rows, "width": width, "height": height}, f, indent=2)


def write_points(points: DataFrame, path: str) -> None:
    """Voted points as Parquet in single precision (K7)."""
    points.select(*(F.col(x).cast("float").alias(x) for x in "xyz")).write.mode("overwrite").parquet(path)


def glb_bytes(xyz: np.ndarray, rgba: np.ndarray) -> bytes:
    """A binary glTF file with one point primitive."""
    p, col = np.ascontiguousarray(xyz, "<f4"), np.ascontiguousarray(rgba, np.uint8)
    blob = p.tobytes() + col.tobytes()
    doc = {
        "asset": {"version": "2.0"}, "scene": 0, "scenes": [{"nodes": [0]}], "nodes": [{"mesh": 0}],
        "meshes": [{"primitives": [{"attributes": {"POSITION": 0, "COLOR_0": 1}, "mode": 0}]}],
        "buffers": [{"byteLength": len(blob)}],
        "bufferViews": [{"buffer": 0, "byteOffset": 0, "byteLength": p.nbytes}, {"buffer": 0, "byteOffset": p.nbytes, "byteLength": col.nbytes}],
        "accessors": [
            {"bufferView": 0, "componentType": 5126, "count": len(p), "type": "VEC3", "min": p.min(0).tolist() if len(p) else [0, 0, 0], "max": p.max(0).tolist() if len(p) else [0, 0, 0]},
            {"bufferView": 1, "componentType": 5121, "count": len(p), "type": "VEC4", "normalized": True},
        ],
    }
    text = json.dumps(doc).encode()
    text += b" " * (-len(text) % 4)
    blob += b"\0" * (-len(blob) % 4)
    body = struct.pack("<I4s", len(text), b"JSON") + text + struct.pack("<I4s", len(blob), b"BIN\0") + blob
    return struct.pack("<4sII", b"glTF", 2, 12 + len(body)) + body


def write_glb(points: DataFrame, path: str, colour: tuple[int, int, int, int] = (255, 140, 0, 255)) -> int:
    """Points of one colour as a scene for viewers (K8, K5). A scene is one file, so its points go through the driver in turn."""
    rows = np.array([tuple(r) for r in points.select("x", "y", "z").toLocalIterator()], dtype=np.float32).reshape(-1, 3)
    with open(path, "wb") as f:
        f.write(glb_bytes(rows, np.tile(np.array(colour, np.uint8), (len(rows), 1))))
    return len(rows)
