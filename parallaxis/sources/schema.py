"""Schemas of the files, in the order their fields are written."""

from __future__ import annotations

from pyspark.sql import types as T

_D, _I, _S = T.DoubleType(), T.IntegerType(), T.StringType()

#: Fields of a pose record; older files lack the processed, resized and crop fields, which then read as null.
POSE = T.StructType(
    [T.StructField("frame_idx", _I), T.StructField("filename", _S)]
    + [T.StructField(n, _D) for n in ("tx", "ty", "tz", "qx", "qy", "qz", "qw", "focal")]
    + [T.StructField(n, _I) for n in ("processed_width", "processed_height", "original_width", "original_height", "resized_width", "resized_height")]
    + [T.StructField(n, _D) for n in ("crop_left", "crop_top", "crop_right", "crop_bottom")]
)

_MATRIX = T.ArrayType(T.ArrayType(_D))
KEYFRAMES = T.StructType(
    [
        T.StructField("keyframes", T.ArrayType(T.StructType([T.StructField("c2w_opencv", _MATRIX), T.StructField("intrinsic", _MATRIX), T.StructField("intrinsic_width", _I), T.StructField("intrinsic_height", _I)]))),
        T.StructField("width", _I),
        T.StructField("height", _I),
    ]
)

RASTER = "filename string, height int, width int, channels int, data array<float>"
"""A raster in one row, row-major; channels is 3 for points and 1 else."""
