"""Scalar functions by hand-computed cases, and their traps."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from parallaxis.functions import geometry as G
from parallaxis.operators import keyframes as K


def value(spark, **cols):
    return spark.range(1).select(*(c.alias(n) for n, c in cols.items())).first()


def test_truncation_keeps_small_negatives(spark):
    r = value(spark, a=G.inside_truncated(F.lit(-0.7), F.lit(2.0), F.lit(4), F.lit(4)), b=G.inside_float(F.lit(-0.7), F.lit(2.0), F.lit(4), F.lit(4)), c=G.inside_truncated(F.lit(-1.0), F.lit(2.0), F.lit(4), F.lit(4)))
    assert (r.a, r.b, r.c) == (True, False, False)


def test_points_at_and_behind_the_camera_project_to_null(spark):
    r = value(spark, a=G.pinhole(F.lit(1.0), F.lit(0.0), F.lit(2.0), F.lit(0.0)), b=G.pinhole(F.lit(1.0), F.lit(-1.0), F.lit(2.0), F.lit(0.0)), c=G.pinhole(F.lit(1.0), F.lit(2.0), F.lit(2.0), F.lit(3.0)))
    assert (r.a, r.b, r.c) == (None, None, 4.0)


def test_depth_tolerance_is_inclusive_and_null_stays_null(spark):
    r = value(spark, a=G.depth_agrees(F.lit(2.125), F.lit(2.0), 0.03, 0.0625), b=G.depth_agrees(F.lit(0.02), F.lit(None).cast("double")))
    assert r.a is True and r.b is None


def test_rotation_matches_quaternion_and_back(spark):
    rng = np.random.default_rng(1)
    rows = [tuple(map(float, q)) for q in [*rng.normal(size=(20, 4)), (1, 0, 0, 0), (0, 1, 0, 0), (0, 0, 1, 0), (0, 0, 0, 1)]]
    df = spark.createDataFrame(rows, "x double, y double, z double, w double")
    m = G.quat_to_matrix("x", "y", "z", "w")
    back = G.matrix_to_quat(m)
    for r in df.select("x", "y", "z", "w", *(b.alias(f"b{i}") for i, b in enumerate(back))).collect():
        q = np.array(r[:4]) / np.linalg.norm(r[:4])
        assert abs(abs(q @ np.array(r[4:])) - 1) < 1e-9


def test_rotations_and_sizes_round_half_to_even(spark):
    r = value(spark, v=G.rotate_pixel(F.lit(90), F.lit(1), F.lit(2), F.lit(5), F.lit(7))[0], u=G.rotate_pixel(F.lit(90), F.lit(1), F.lit(2), F.lit(5), F.lit(7))[1])
    assert (r.v, r.u) == (2, 3)
    s = value(spark, **G.resize_crop(F.lit(1280), F.lit(720), 512))
    assert (s.resized_width, s.resized_height, s.crop_top, s.crop_bottom) == (512, 288, 0.0, 288.0)


def test_yfov_falls_back(spark):
    r = value(spark, a=G.yfov(F.lit(0.0), F.lit(640.0), F.lit(1.0)), b=G.yfov(F.lit(320.0), F.lit(640.0), F.lit(1.0)))
    assert r.a == pytest.approx(math.pi / 4) and r.b == pytest.approx(math.pi / 2)


def test_cubic_runs_through_knots_and_is_exact_for_cubics():
    x = np.arange(6.0)
    y = np.stack([x**3 - 2 * x, x**2], axis=1)
    co = K.cubic_coefficients(y)
    f = 0.4
    got = np.array([c[0] + f * (c[1] + f * (c[2] + f * c[3])) for c in co])
    t = x[:-1] + f
    assert np.allclose(got, np.stack([t**3 - 2 * t, t**2], axis=1))
    three = K.cubic_coefficients(y[:3, 1:])
    assert np.allclose([c[0] + f * (c[1] + f * c[2]) for c in three], ((x[:2] + f) ** 2)[:, None])


def test_rotation_spline_meets_keyframes_with_continuous_rate():
    rng = np.random.default_rng(3)
    q = np.concatenate([rng.normal(size=(6, 3)) * 0.3, np.ones((6, 1))], axis=1)
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    at = K.rotation_spline(q, np.arange(6.0))
    assert np.allclose(np.abs((at * q).sum(1)), 1)
    e = 1e-4
    rate = lambda t: K._log(K._mul(K.rotation_spline(q, np.array([t])) * [-1, -1, -1, 1], K.rotation_spline(q, np.array([t + e]))))[0] / e
    for k in range(1, 5):
        assert np.allclose(rate(k - 2 * e), rate(k + e), atol=5e-3)


def test_keyframe_undo_of_an_empty_stack_is_nothing(spark):
    rows = [(1, 1, "undo", 10), (1, 2, "append", 20), (1, 3, "append", 30), (1, 4, "undo", 0), (1, 5, "look", 1), (1, 6, "append", 40)]
    got = K.keyframe_stack(spark.createDataFrame(rows, "s int, seq int, act string, x int"), "s", ["seq"], "act", "x").orderBy("pos").collect()
    assert [(r.pos, r.x) for r in got] == [(0, 20), (1, 40)]
