"""Raster operators on long tables (filename, v, u, value) and packed arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import c, nearest_source


def resize_nearest(raster: DataFrame, grid: DataFrame, src: tuple, dst: tuple, keys: list[str]) -> DataFrame:
    """Raster at another size: each target pixel looks up its source pixel by an equi-join (F8). grid holds (keys, v, u).

    Both sides are shuffled: rasters made by explode are many times what a plan guesses of them, so a broadcast would fill the driver.
    """
    (sh, sw), (dh, dw) = src, dst
    at = grid.withColumns({"sv": nearest_source("v", dh, sh), "su": nearest_source("u", dw, sw)})
    source = raster.withColumnsRenamed({"v": "sv", "u": "su"})
    return at.join(source.hint("merge"), [*keys, "sv", "su"]).drop("sv", "su")


def mask_source_pixel(v, u, mask_h, mask_w, resized_h, resized_w, crop_top, crop_left) -> tuple[Column, Column]:
    """Mask pixel under a processed pixel: undo the crop (half-even), then the nearest resize (F8)."""
    rv, ru = c(v) + F.bround(c(crop_top)), c(u) + F.bround(c(crop_left))
    return nearest_source(rv, resized_h, mask_h), nearest_source(ru, resized_w, mask_w)


def bilinear(values: Column, v, u, src_h, src_w, dst_h, dst_w) -> Column:
    """Bilinear sample of a packed raster with half-pixel centres and edge clamp."""

    def axis(i, src, dst) -> tuple[Column, Column, Column]:
        s = (c(i) + F.lit(0.5)) * (c(src) / c(dst)) - F.lit(0.5)
        lo = F.floor(s)
        f = s - lo
        a = F.greatest(F.least(lo, c(src) - 1), F.lit(0)).cast("int")
        b = F.greatest(F.least(lo + 1, c(src) - 1), F.lit(0)).cast("int")
        return a, b, f

    v0, v1, fv = axis(v, src_h, dst_h)
    u0, u1, fu = axis(u, src_w, dst_w)
    g = lambda y, x: F.get(values, y * c(src_w) + x)
    return (g(v0, u0) * (1 - fu) + g(v0, u1) * fu) * (1 - fv) + (g(v1, u0) * (1 - fu) + g(v1, u1) * fu) * fv


def fix_orientation(points: DataFrame, image_h, image_w, shape_h, shape_w) -> DataFrame:
    """Swap (v, u) where the transposed raster fits the image's aspect better."""
    image = c(image_w) / c(image_h)
    swap = F.abs(image - c(shape_w) / c(shape_h)) > F.abs(image - c(shape_h) / c(shape_w))
    v, u = F.when(swap, F.col("u")).otherwise(F.col("v")), F.when(swap, F.col("v")).otherwise(F.col("u"))
    return points.withColumns({"swapped": swap, "nv": v, "nu": u}).drop("v", "u").withColumnsRenamed({"nv": "v", "nu": "u"})
