"""Camera paths: sample times, interpolation between keyframes, and the keyframe log."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import c, quat_to_matrix, to_opengl


def sample_times(spark: SparkSession, keyframes: int, n: int) -> DataFrame:
    """n times evenly from the first to the last keyframe; a single one is at 0."""
    step = (keyframes - 1) / (n - 1) if n > 1 else 0.0
    return spark.range(n).select(F.col("id").cast("int").alias("frame"), (F.col("id") * F.lit(step)).alias("t"))


def with_segment(times: DataFrame, frames: DataFrame, keyframes: int, columns: list[str]) -> DataFrame:
    """Each time with the keyframe before it and, as <column>_next, the one after."""
    pairs = frames.select("k", *columns, *(F.lead(x).over(W.orderBy("k")).alias(f"{x}_next") for x in columns))
    seg = F.least(F.floor("t"), F.lit(max(keyframes - 2, 0))).cast("int")
    return times.withColumn("k", seg).join(F.broadcast(pairs), "k").withColumn("f", F.col("t") - F.col("k"))  # one row a keyframe


def lerp(x: str) -> Column:
    """Linear value in the segment."""
    return c(x) + (F.coalesce(c(f"{x}_next"), c(x)) - c(x)) * F.col("f")


def cubic_coefficients(values: np.ndarray) -> np.ndarray:
    """Not-a-knot cubic spline over knots 0..K-1: coefficients [segment, power 0..3, axis]; three knots give a parabola (F16)."""
    y = np.asarray(values, dtype=float)
    n = len(y)
    if n == 3:
        a = (y[0] - 2 * y[1] + y[2]) / 2
        b = (y[2] - y[0]) / 2
        return np.stack([np.stack([y[0], b - 2 * a, a, 0 * a]), np.stack([y[1], b, a, 0 * a])])
    # Unknown second derivatives: continuity inside, equal third derivatives at the second and last but one knot.
    m, rhs = np.zeros((n, n)), np.zeros_like(y)
    for i in range(1, n - 1):
        m[i, i - 1 : i + 2] = 1, 4, 1
        rhs[i] = 6 * (y[i - 1] - 2 * y[i] + y[i + 1])
    m[0, :3] = 1, -2, 1
    m[-1, -3:] = 1, -2, 1
    s = np.linalg.solve(m, rhs)
    d = np.diff(y, axis=0)
    return np.stack([y[:-1], d - (2 * s[:-1] + s[1:]) / 6, s[:-1] / 2, np.diff(s, axis=0) / 6], axis=1)


def spline_positions(times: DataFrame, frames: DataFrame, columns: list[str]) -> DataFrame:
    """Positions along the path: cubic from three keyframes on, else linear (F16). Keyframes are set by hand, so few."""
    rows = frames.orderBy("k").select(*columns).collect()
    k = len(rows)
    if k < 3:
        got = with_segment(times, frames, k, columns)  # one keyframe: itself at every time
        return got.select("frame", "t", *(lerp(x).alias(x) for x in columns))
    co = cubic_coefficients(np.array([[float(v) for v in r] for r in rows]))
    flat = [(i, *(float(v) for v in co[i].T.ravel())) for i in range(k - 1)]
    names = [f"{x}{p}" for x in columns for p in range(4)]
    table = times.sparkSession.createDataFrame(flat, ["k", *names])
    seg = F.least(F.floor("t"), F.lit(k - 2)).cast("long")
    at = times.withColumn("k", seg).join(F.broadcast(table), "k").withColumn("f", F.col("t") - F.col("k"))
    f = F.col("f")
    return at.select("frame", "t", *((F.col(f"{x}0") + f * (F.col(f"{x}1") + f * (F.col(f"{x}2") + f * F.col(f"{x}3")))).alias(x) for x in columns))


# Rotations, as arrays of quaternions (x, y, z, w)


def _mul(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    av, aw, bv, bw = a[..., :3], a[..., 3:], b[..., :3], b[..., 3:]
    return np.concatenate([aw * bv + bw * av + np.cross(av, bv), aw * bw - (av * bv).sum(-1, keepdims=True)], -1)


def _exp(r: np.ndarray) -> np.ndarray:
    a = np.linalg.norm(r, axis=-1, keepdims=True)
    return np.concatenate([r * np.where(a > 1e-9, np.sin(a / 2) / np.where(a > 1e-9, a, 1), 0.5), np.cos(a / 2)], -1)


def _log(q: np.ndarray) -> np.ndarray:
    q = np.where(q[..., 3:] < 0, -q, q)
    s = np.linalg.norm(q[..., :3], axis=-1, keepdims=True)
    return q[..., :3] * np.where(s > 1e-9, 2 * np.arctan2(s, q[..., 3:]) / np.where(s > 1e-9, s, 1), 2.0)


def _rate_matrix(r: np.ndarray) -> np.ndarray:
    """Maps the derivative of a rotation vector to the angular rate in the moving frame."""
    a = np.linalg.norm(r)
    k = np.array([[0, -r[2], r[1]], [r[2], 0, -r[0]], [-r[1], r[0], 0]])
    if a < 1e-6:
        return np.eye(3) - k / 2 + k @ k / 6
    return np.eye(3) - (1 - np.cos(a)) / a**2 * k + (a - np.sin(a)) / a**3 * (k @ k)


def rotation_spline(quats: np.ndarray, times: np.ndarray, steps: int = 60) -> np.ndarray:
    """Rotations through keyframes 0..K-1 with continuous angular rate, a cubic in the rotation vector of each segment.

    Rates at inner knots are those for which the angular acceleration is continuous as well; they are found by damped
    fixed-point steps from the central rates. End rates are those of the first and last arc.
    """
    q = np.asarray(quats, dtype=float)
    q = q / np.linalg.norm(q, axis=1, keepdims=True)
    if len(q) == 1:
        return np.repeat(q, len(times), axis=0)
    inv = q * [-1, -1, -1, 1]
    arc = _log(_mul(inv[:-1], q[1:]))
    n = len(q)
    rate = np.concatenate([arc[:1], (arc[:-1] + arc[1:]) / 2, arc[-1:]])

    def cubics(rate: np.ndarray) -> list[np.ndarray]:
        out = []
        for i in range(n - 1):
            d1 = np.linalg.solve(_rate_matrix(arc[i]), rate[i + 1])
            d0 = rate[i]
            out.append(np.stack([np.zeros(3), d0, 3 * arc[i] - 2 * d0 - d1, d0 + d1 - 2 * arc[i]]))
        return out

    def accel(co: np.ndarray, f: float) -> np.ndarray:
        e = 1e-4
        w = []
        for g in (f - e, f + e):
            r = co[1] * g + co[2] * g**2 + co[3] * g**3
            w.append(_rate_matrix(r) @ (co[1] + 2 * co[2] * g + 3 * co[3] * g**2))
        return (w[1] - w[0]) / (2 * e)

    for _ in range(steps):
        co = cubics(rate)
        gap = np.array([accel(co[i], 0.0) - accel(co[i - 1], 1.0) for i in range(1, n - 1)])
        if not len(gap) or np.abs(gap).max() < 1e-9:
            break
        rate[1:-1] += gap / 8
    co = cubics(rate)
    seg = np.clip(np.floor(times).astype(int), 0, n - 2)
    f = (times - seg)[:, None]
    r = np.stack([co[i][1] for i in seg]) * f + np.stack([co[i][2] for i in seg]) * f**2 + np.stack([co[i][3] for i in seg]) * f**3
    return _mul(q[seg], _exp(r))


def keyframe_stack(log: DataFrame, session: str, order: list[str], action: str, value: str) -> DataFrame:
    """Keyframes that are left after a log of appends and undos, by session with their positions.

    An undo of an empty stack does nothing; other actions are passed over. Depths are running sums held at 0 from below; an append stays
    if the depth never falls below its own again. One ordered pass over a session's events.
    """
    step = F.when(F.col(action) == "append", 1).otherwise(-1)
    events = log.where(F.col(action).isin("append", "undo")).select(F.col(session), *order, F.col(value).alias("_value"), step.alias("_step"))
    past = W.partitionBy(session).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    future = W.partitionBy(session).orderBy(*order).rowsBetween(1, W.unboundedFollowing)
    run = events.withColumn("_sum", F.sum("_step").over(past))
    deep = run.withColumn("_depth", F.col("_sum") - F.least(F.min("_sum").over(past), F.lit(0)))
    left = deep.withColumn("_low", F.min("_depth").over(future)).where("_step = 1 and coalesce(_low, _depth) >= _depth")
    return left.select(session, (F.col("_depth") - 1).cast("int").alias("pos"), F.col("_value").alias(value))


def camera_path(frames: DataFrame, n: int) -> DataFrame:
    """n cameras along keyframes (k, tx, ty, tz, qx, qy, qz, qw, yfov): frame, position, rotation in the graphics convention and field of view (K11,
    F13, F15 to F18). A single keyframe is repeated. Keyframes are set by hand and a path has some hundred frames, so both are small."""
    names = ["tx", "ty", "tz", "qx", "qy", "qz", "qw", "yfov"]
    rows = np.array([[float(r[x]) for x in names] for r in frames.orderBy("k").select(*names).collect()])
    if not len(rows):
        raise ValueError("no keyframes")
    k = len(rows)
    times = np.linspace(0, k - 1, n) if n > 1 else np.zeros(n)
    seg = np.minimum(np.floor(times).astype(int), max(k - 2, 0))
    f = (times - seg)[:, None]
    if k < 3:
        at = rows[seg, :3] + f * (rows[np.minimum(seg + 1, k - 1), :3] - rows[seg, :3])
    else:
        co = cubic_coefficients(rows[:, :3])[seg]
        at = co[:, 0] + f * (co[:, 1] + f * (co[:, 2] + f * co[:, 3]))
    q = rotation_spline(rows[:, 3:7], times)
    fov = np.interp(times, np.arange(k), rows[:, 7])
    table = frames.sparkSession.createDataFrame([(i, *map(float, x)) for i, x in enumerate(np.column_stack([at, q, fov]))], "frame int, " + ", ".join(f"{x} double" for x in names))
    m = to_opengl(quat_to_matrix("qx", "qy", "qz", "qw"))
    return table.select("frame", "tx", "ty", "tz", *(m[i][j].alias(f"r{i}{j}") for i in range(3) for j in range(3)), "yfov")
