"""Camera geometry as column expressions: rotations, rigid transforms, projection, image sizes.

Quaternions are (x, y, z, w), scalar last; poses are camera-to-world. A vector or matrix is a dict or list of
columns, so that whole-stage code generation sees plain arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]
Mat = list[list[Column]]


def c(x: Column | str | float) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def quat_to_matrix(qx, qy, qz, qw) -> Mat:
    """Rotation matrix of a quaternion, normalised first."""
    x, y, z, w = map(c, (qx, qy, qz, qw))
    n = F.sqrt(x * x + y * y + z * z + w * w)
    x, y, z, w = x / n, y / n, z / n, w / n
    one, two = F.lit(1.0), F.lit(2.0)
    return [
        [one - two * (y * y + z * z), two * (x * y - z * w), two * (x * z + y * w)],
        [two * (x * y + z * w), one - two * (x * x + z * z), two * (y * z - x * w)],
        [two * (x * z - y * w), two * (y * z + x * w), one - two * (x * x + y * y)],
    ]


def matrix_to_quat(m: Mat) -> list[Column]:
    """Quaternion of a rotation matrix by its largest component (F2); the sign is that of the branch."""
    t = m[0][0] + m[1][1] + m[2][2]
    best = F.greatest(m[0][0], m[1][1], m[2][2], t)

    def branch(i: int) -> list[Column]:
        j, k = (i + 1) % 3, (i + 2) % 3
        q: list[Column] = [F.lit(0.0)] * 4
        q[i] = 1 - t + 2 * m[i][i]
        q[j] = m[j][i] + m[i][j]
        q[k] = m[k][i] + m[i][k]
        q[3] = m[k][j] - m[j][k]
        return q

    real = [m[2][1] - m[1][2], m[0][2] - m[2][0], m[1][0] - m[0][1], 1 + t]
    options = [branch(0), branch(1), branch(2), real]
    raw = [F.when(best == m[0][0], options[0][i]).when(best == m[1][1], options[1][i]).when(best == m[2][2], options[2][i]).otherwise(options[3][i]) for i in range(4)]
    n = F.sqrt(raw[0] * raw[0] + raw[1] * raw[1] + raw[2] * raw[2] + raw[3] * raw[3])
    return [q / n for q in raw]


def to_camera(m: Mat, t: Vec, p: Vec) -> Vec:
    """World point in the camera's frame: transposed rotation of p - t."""
    d = [c(a) - c(b) for a, b in zip(p, t, strict=True)]
    return tuple(m[0][i] * d[0] + m[1][i] * d[1] + m[2][i] * d[2] for i in range(3))


def inverse_rigid(m: Mat, t: Vec) -> tuple[Mat, Vec]:
    """Inverse of a rigid transform."""
    rt = [[m[j][i] for j in range(3)] for i in range(3)]
    return rt, tuple(-(rt[i][0] * c(t[0]) + rt[i][1] * c(t[1]) + rt[i][2] * c(t[2])) for i in range(3))


def pinhole(cx, cz, focal, centre) -> Column:
    """focal * cx / cz + centre for points in front, else null."""
    return F.when(c(cz) > 0, c(focal) * c(cx) / c(cz) + c(centre))


def truncated(x) -> Column:
    """Integer part toward zero."""
    return c(x).cast("int")


def inside_truncated(u, v, width, height) -> Column:
    """Bounds after truncation, so u in (-1, 0) counts as 0."""
    ui, vi = truncated(u), truncated(v)
    return (ui >= 0) & (ui < c(width)) & (vi >= 0) & (vi < c(height))


def inside_float(u, v, width, height) -> Column:
    """Bounds on the unrounded position."""
    return (c(u) >= 0) & (c(u) < c(width)) & (c(v) >= 0) & (c(v) < c(height))


def depth_agrees(cz, depth, absolute=0.03, relative=0.05) -> Column:
    """Depth within the larger of two tolerances, inclusive; relative to the stored depth (C9). A null depth gives null."""
    return F.abs(c(cz) - c(depth)) <= F.when(c(depth).isNotNull(), F.greatest(F.lit(absolute), F.lit(relative) * c(depth)))


def scaled_focal(focal, size, processed) -> Column:
    """Focal length carried from the processed to the raster size."""
    return c(focal) * c(size) / c(processed)


def resize_crop(width, height, size: int, square_ok: bool = False, patch: int = 16) -> dict[str, Column]:
    """Size after scaling the long side to `size` and the centred crop to multiples of the patch (F1)."""
    w, h = c(width).cast("double"), c(height).cast("double")
    side = F.bround(F.lit(224.0) * F.greatest(w / h, h / w)) if size == 224 else F.lit(float(size))
    scale = side / F.greatest(w, h)
    rw, rh = F.bround(w * scale).cast("int"), F.bround(h * scale).cast("int")
    cx, cy = F.floor(rw / 2).cast("int"), F.floor(rh / 2).cast("int")
    if size == 224:
        halfw = halfh = F.least(cx, cy).cast("double")
    else:
        halfw = F.floor(2 * cx / patch) * patch / 2
        halfh = F.floor(2 * cy / patch) * patch / 2
        if not square_ok:
            halfh = F.when(rw == rh, 3 * halfw / 4).otherwise(halfh)
    return {"resized_width": rw, "resized_height": rh, "crop_left": (cx - halfw).cast("double"), "crop_top": (cy - halfh).cast("double"), "crop_right": (cx + halfw).cast("double"), "crop_bottom": (cy + halfh).cast("double")}


def to_original(u, crop, image_size, resized_size) -> Column:
    """Processed position, not yet truncated, in pixels of the original image."""
    return truncated((c(u) + c(crop)) * (c(image_size) / c(resized_size)))


def nearest_source(dst, dst_size, src_size) -> Column:
    """Source index of a nearest-neighbour resize (F8)."""
    return F.least(F.floor(c(dst) * c(src_size) / c(dst_size)), c(src_size) - 1).cast("int")


def yfov(fx, width, aspect) -> Column:
    """Vertical field of view; a quarter of pi without a focal length."""
    return F.when(c(fx) > 0, 2 * F.atan(F.tan(F.atan(c(width) / (2 * c(fx)))) / c(aspect))).otherwise(F.lit(0.7853981633974483))


def rotate_pixel(angle, v, u, height, width) -> tuple[Column, Column]:
    """(v, u) after turning an image by 90, 180 or 270 degrees clockwise; other angles leave it."""
    a, v, u, h, w = map(c, (angle, v, u, height, width))
    return (F.when(a == 90, u).when(a == 180, h - 1 - v).when(a == 270, w - 1 - u).otherwise(v), F.when(a == 90, h - 1 - v).when(a == 180, w - 1 - u).when(a == 270, v).otherwise(u))


def slerp(q0: list[Column], q1: list[Column], t: Column) -> list[Column]:
    """Shorter arc between two unit quaternions (F17, two keyframes)."""
    dot = q0[0] * q1[0] + q0[1] * q1[1] + q0[2] * q1[2] + q0[3] * q1[3]
    sign = F.when(dot < 0, -1.0).otherwise(1.0)
    d = F.least(F.abs(dot), F.lit(1.0))
    angle = F.acos(d)
    a = F.when(angle > 1e-12, F.sin((1 - t) * angle) / F.sin(angle)).otherwise(1 - t)
    b = F.when(angle > 1e-12, F.sin(t * angle) / F.sin(angle)).otherwise(t)
    return [a * x + b * sign * y for x, y in zip(q0, q1, strict=True)]


def stem(name) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(c(name), r"\.[^.]*$", "")


def to_opengl(m: Mat) -> Mat:
    """Camera-to-world rotation with the second and third axis turned, from the computer-vision to the graphics convention."""
    return [[row[0], -row[1], -row[2]] for row in m]


def to_scene(m: Mat, t: Vec, p: Vec) -> Vec:
    """World point in the frame of the exported scene: that of the first camera, axes turned, half a turn about y."""
    x, y, z = to_camera(m, t, p)
    return -x, -y, z


def moved(m: Mat, t: Vec, step: tuple[float, float, float]) -> Vec:
    """Camera position after a step along its own axes."""
    return tuple(c(t[i]) + m[i][0] * F.lit(step[0]) + m[i][1] * F.lit(step[1]) + m[i][2] * F.lit(step[2]) for i in range(3))


def voter_intrinsic_size(pose, raster) -> Column:
    """Processed size that focal lengths refer to: the pose's, else the raster's."""
    return F.coalesce(c(pose), c(raster))


def voter_raster_size(pose, raster) -> Column:
    """Size of a frame's raster: its own, else the pose's; null says that the run can't go on."""
    return F.coalesce(c(raster), c(pose))


def viewer_size(pose, raster, image) -> Column:
    """Processed size when points are drawn on a frame: the pose's, the raster's, the image's."""
    return F.coalesce(c(pose), c(raster), c(image))


def keyframe_source_size(own, config_intrinsic, config_size, fallback, centre) -> Column:
    """Size that a keyframe's intrinsics refer to: its own, the configuration's two, the fallback; without its own not less than what the
    principal point implies, rounded half to even (F19)."""
    size = F.coalesce(c(own), c(config_intrinsic), c(config_size), c(fallback)).cast("double")
    implied = F.when(c(own).isNull() & (c(centre) > 0), F.bround(2.0 * c(centre) + 1.0))
    return F.coalesce(F.greatest(size, implied), size)


def colour_fraction(value, fill: float = 0.7) -> Column:
    """A colour channel of 0..255 as a fraction; a grey fill where there is none."""
    return F.coalesce(c(value) / F.lit(255.0), F.lit(fill))


def scaled_pixel(cx, cz, focal, centre, image, processed) -> Column:
    """Position on the original image of a point that is in the camera's frame already (F12); null behind the camera."""
    return (F.when(c(cz) > 0, c(focal) * c(cx) / c(cz) + c(centre))) * (c(image) / c(processed))
