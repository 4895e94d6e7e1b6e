"""All queries over the driver tables, by name, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as X
from .functions import geometry as G
from .operators import keyframes as K
from .operators import rasters as R
from .operators import relational as J
from .operators import voting as V
from .plans.pipeline import project_to_frames, reprojection_metrics

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
H, W = X.HEIGHT, X.WIDTH


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _cameras(s: SparkSession, d: str) -> DataFrame:
    return V.camera_matrices(X.poses(s, d), W, H)


def _r(x, n: int = 6):
    return F.round(x, n)


# Votes


@query(f"WITH {X.SEEN_SQL} SELECT point, count(*)::INTEGER AS votes FROM ballots GROUP BY point HAVING count(*) >= 2")
def multiview_vote(s, d):
    return V.vote(X.points(s, d), _cameras(s, d), "point", W, H, X.mask_rule, X.depth_rule)


@query(f"WITH {X.SEEN_SQL}, v AS (SELECT p.point, count(b.cam)::INTEGER AS votes FROM pts p LEFT JOIN ballots b ON p.point = b.point GROUP BY p.point) SELECT votes, count(*) AS n_points FROM v GROUP BY votes")
def vote_histogram(s, d):
    return V.vote(X.points(s, d), _cameras(s, d), "point", W, H, X.mask_rule, X.depth_rule, 0).groupBy("votes").agg(F.count("*").alias("n_points"))


@query(f"WITH {X.SEEN_SQL} SELECT p.point, count(b.cam)::INTEGER AS votes FROM pts p LEFT JOIN ballots b ON p.point = b.point GROUP BY p.point")
def vote_zero_kept(s, d):
    return V.vote(X.points(s, d), _cameras(s, d), "point", W, H, X.mask_rule, X.depth_rule, 0)


@query(f"WITH {X.SEEN_SQL} SELECT point, count(*)::INTEGER AS votes FROM ballots GROUP BY point HAVING count(*) >= 2")
def multiview_vote_arrow(s, d):
    mask, depth = lambda c, u, v: (c * 7 + u * 3 + v * 5) % 4 != 0, lambda c, u, v: 1 + ((c + u + v) % 9) / 4.0
    return V.vote_arrow(X.points(s, d), _cameras(s, d), "point", W, H, mask, depth)


@query(f"WITH {X.SEEN_SQL} SELECT point, count(*)::INTEGER AS votes FROM ballots GROUP BY point HAVING count(*) >= 2")
def multiview_vote_rasters(s, d):
    cams = X.poses(s, d).select("cam")
    px = F.sequence(F.lit(0), F.lit(W * H - 1))
    rasters = cams.select("cam", F.transform(px, lambda i: X.mask_rule(F.col("cam"), i % W, F.floor(i / W)).cast("tinyint")).alias("mask"), F.transform(px, lambda i: X.depth_rule(F.col("cam"), i % W, F.floor(i / W)).cast("float")).alias("depth"))
    return V.vote_rasters(X.points(s, d), _cameras(s, d), rasters, "point", W, H)


# Masks, detections, frames


@query("""WITH p AS (SELECT o_orderkey AS point, o_orderkey % 40 AS f, (o_orderkey // 40) % 30 AS v, (o_orderkey // 1200) % 30 AS u FROM orders WHERE o_orderkey % 3 <> 0),
m AS (SELECT DISTINCT l_orderkey % 40 AS f, l_partkey % 30 AS v, l_suppkey % 30 AS u FROM lineitem WHERE l_discount * 10 > 0.5)
SELECT point, f, v, u FROM p WHERE EXISTS (SELECT 1 FROM m WHERE m.f = p.f AND m.v = p.v AND m.u = p.u)""")
def candidates_mask_conf(s, d):
    p = X.table(s, d, "orders").selectExpr("o_orderkey AS point", "o_orderkey % 40 AS f", "(o_orderkey div 40) % 30 AS v", "(o_orderkey div 1200) % 30 AS u", "o_orderkey % 3 <> 0 AS conf")
    m = X.table(s, d, "lineitem").selectExpr("l_orderkey % 40 AS f", "l_partkey % 30 AS v", "l_suppkey % 30 AS u", "l_discount * 10 AS m")
    return J.candidates(p, m, ["f", "v", "u"]).select("point", "f", "v", "u")


@query("SELECT l_orderkey, l_linenumber, l_discount * 10 AS score FROM lineitem WHERE l_discount * 10 > 0.3")
def score_filter(s, d):
    return X.table(s, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_discount * 10 AS score").where("score > 0.3")


@query("SELECT l_orderkey % 100 AS frame, l_partkey % 24 AS v, l_suppkey % 32 AS u, max((l_linenumber % 2 = 0)::INTEGER) AS m FROM lineitem WHERE l_discount * 10 > 0.3 GROUP BY ALL")
def mask_union(s, d):
    det = X.table(s, d, "lineitem").selectExpr("l_orderkey % 100 AS frame", "l_partkey % 24 AS v", "l_suppkey % 32 AS u", "l_discount * 10 AS score", "l_linenumber % 2 = 0 AS m")
    return J.union_masks(det, ["frame", "v", "u"])


@query("SELECT event_id, (event_id // 14)::INTEGER AS saved_idx, printf('frame_%04d.jpg', event_id // 14) AS filename FROM events WHERE event_id % 14 = 0")
def frame_sampling(s, d):
    got = J.sample_frames(X.table(s, d, "events").select("event_id"), "event_id", 29.97, 2.0)
    return got.select("event_id", "saved_idx", F.format_string("frame_%04d.jpg", "saved_idx").alias("filename"))


@query("SELECT filename, (row_number() OVER (ORDER BY filename) - 1)::INTEGER AS frame_idx FROM (SELECT printf('frame_%04d.jpg', s_suppkey * 37) AS filename FROM supplier)")
def frame_ordinal(s, d):
    return J.ordinal(X.table(s, d, "supplier").select(F.format_string("frame_%04d.jpg", F.col("s_suppkey") * 37).alias("filename")), ["filename"])


@query("SELECT event_id, user_id FROM events ORDER BY ts, event_id LIMIT 1 OFFSET 5")
def nth_frame(s, d):
    return J.nth(X.table(s, d, "events").select("event_id", "user_id", "ts"), ["ts", "event_id"], 5).drop("ts")


@query("""WITH p AS (SELECT p_partkey, (p_size % 5) * 90 AS a, p_partkey % 24 AS v, p_partkey % 31 AS u FROM part)
SELECT p_partkey, a, CASE a WHEN 90 THEN u WHEN 180 THEN 24 - 1 - v WHEN 270 THEN 32 - 1 - u ELSE v END AS nv, CASE a WHEN 90 THEN 24 - 1 - v WHEN 180 THEN 32 - 1 - u WHEN 270 THEN v ELSE u END AS nu FROM p""")
def rotate_pixels(s, d):
    p = X.table(s, d, "part").selectExpr("p_partkey", "(p_size % 5) * 90 AS a", "p_partkey % 24 AS v", "p_partkey % 31 AS u")
    v, u = G.rotate_pixel("a", "v", "u", F.lit(H), F.lit(W))
    return p.select("p_partkey", "a", v.alias("nv"), u.alias("nu"))


@query("""WITH p AS (SELECT n_nationkey AS filename FROM nation), m AS (SELECT s_suppkey % 40 AS filename, max((s_suppkey % 2)::INTEGER) AS mask FROM supplier WHERE s_suppkey % 3 <> 0 GROUP BY 1),
z AS (SELECT s_suppkey % 30 AS filename, max(s_acctbal) AS depth FROM supplier WHERE s_suppkey % 4 <> 0 GROUP BY 1)
SELECT p.filename, coalesce(m.mask, 0) AS mask, CASE WHEN m.filename IS NOT NULL THEN coalesce(z.depth, 0.0::DOUBLE) ELSE 0.0::DOUBLE END AS depth FROM p LEFT JOIN m ON p.filename = m.filename LEFT JOIN z ON p.filename = z.filename""")
def pose_left_mask_depth(s, d):
    sup = X.table(s, d, "supplier")
    m = sup.where("s_suppkey % 3 <> 0").groupBy((F.col("s_suppkey") % 40).alias("filename")).agg(F.max((F.col("s_suppkey") % 2).cast("int")).alias("mask"))
    z = sup.where("s_suppkey % 4 <> 0").groupBy((F.col("s_suppkey") % 30).alias("filename")).agg(F.max("s_acctbal").alias("depth"))
    return J.with_rasters(X.table(s, d, "nation").select(F.col("n_nationkey").alias("filename")), m, z)


@query("SELECT c_nationkey AS filename, max_by(c_name, c_custkey) AS c_name, max(c_custkey) AS c_custkey, max_by(n_name, c_custkey) AS n_name FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY c_nationkey")
def pose_last_wins(s, d):
    poses = J.last_wins(X.table(s, d, "customer").selectExpr("c_nationkey AS filename", "c_name", "c_custkey"), "filename", "c_custkey")
    return poses.join(X.table(s, d, "nation").selectExpr("n_nationkey AS filename", "n_name"), "filename")


@query("WITH a AS (SELECT s_name, row_number() OVER (ORDER BY s_suppkey) - 1 AS pos FROM supplier), b AS (SELECT n_name, row_number() OVER (ORDER BY n_name) - 1 AS pos FROM nation) SELECT pos::INTEGER AS pos, s_name, n_name FROM a JOIN b USING (pos)")
def zip_truncate(s, d):
    return J.zip_shortest(X.table(s, d, "supplier").select("s_suppkey", "s_name"), ["s_suppkey"], X.table(s, d, "nation").select("n_name"), ["n_name"]).select("pos", "s_name", "n_name")


@query("SELECT a.n_nationkey AS i, b.n_nationkey AS j FROM nation a, nation b WHERE a.n_nationkey <> b.n_nationkey")
def pairs_complete(s, d):
    return J.pairs(X.table(s, d, "nation"), "n_nationkey")


@query("SELECT a.n_nationkey AS i, b.n_nationkey AS j FROM nation a, nation b WHERE (a.n_nationkey = 0 OR b.n_nationkey = 0) AND a.n_nationkey <> b.n_nationkey")
def pairs_oneref(s, d):
    return J.pairs(X.table(s, d, "nation"), "n_nationkey", "oneref")


@query("SELECT DISTINCT a.n_nationkey AS i, b.n_nationkey AS j FROM nation a, nation b WHERE a.n_nationkey <> b.n_nationkey AND ((b.n_nationkey - a.n_nationkey + 25) % 25 IN (1, 2, 3) OR (a.n_nationkey - b.n_nationkey + 25) % 25 IN (1, 2, 3))")
def pairs_swin(s, d):
    return J.pairs(X.table(s, d, "nation"), "n_nationkey", "swin")


# Projection


@query(f"WITH {X.SEEN_SQL} SELECT cam, count(*) AS n, sum(point)::BIGINT AS keys FROM uv WHERE conf AND u >= 0 AND u < 32 AND v >= 0 AND v < 24 GROUP BY cam")
def project_float_bounds(s, d):
    seen = V.projected(X.points(s, d).where("conf"), _cameras(s, d), "point").where(G.inside_float("u", "v", W, H))
    return seen.groupBy("cam").agg(F.count("*").alias("n"), F.sum("point").alias("keys"))


@query(f"WITH {X.SEEN_SQL} SELECT cam, count(*) AS n, sum(point)::BIGINT AS keys FROM inb GROUP BY cam")
def project_trunc_bounds(s, d):
    seen = V.projected(X.points(s, d), _cameras(s, d), "point").where(G.inside_truncated("u", "v", W, H))
    return seen.groupBy("cam").agg(F.count("*").alias("n"), F.sum("point").alias("keys"))


def _framed(s, d):
    extra = {"processed_width": W, "processed_height": H, "original_width": 100, "original_height": 80, "resized_width": 36, "resized_height": 28}
    return X.poses(s, d).withColumns({k: F.lit(v) for k, v in extra.items()} | {"crop_left": F.lit(2.0), "crop_top": F.lit(2.0)})


_ORIGINAL = f"""WITH {X.SEEN_SQL}, o AS (SELECT point, cam, trunc((u + 2.0) * (100 / 36.0::DOUBLE))::INTEGER AS ou, trunc((v + 2.0) * (80 / 28.0::DOUBLE))::INTEGER AS ov FROM uv
WHERE trunc(u)::BIGINT >= 0 AND trunc(u)::BIGINT < 32 AND trunc(v)::BIGINT >= 0 AND trunc(v)::BIGINT < 24)"""


@query(f"{_ORIGINAL} SELECT point, cam, ov, ou FROM o WHERE ou >= 0 AND ou < 100 AND ov >= 0 AND ov < 80")
def project_to_original(s, d):
    seen = V.projected(X.points(s, d), _cameras(s, d), "point").where(G.inside_truncated("u", "v", W, H))
    got = seen.select("point", "cam", G.to_original("v", F.lit(2.0), F.lit(80), F.lit(28)).alias("ov"), G.to_original("u", F.lit(2.0), F.lit(100), F.lit(36)).alias("ou"))
    return got.where("ou >= 0 and ou < 100 and ov >= 0 and ov < 80")


@query(f"{_ORIGINAL} SELECT DISTINCT printf('frame_%04d.jpg', cam) AS filename, ov AS v, ou AS u FROM o WHERE ou >= 0 AND ou < 100 AND ov >= 0 AND ov < 80")
def paint_distinct_pixels(s, d):
    return project_to_frames(X.points(s, d), _framed(s, d))


@query("""WITH p AS (SELECT p_partkey, p_partkey % 24 AS v, p_partkey % 31 AS u, p_size + 10 AS ih, (p_size * 7) % 50 + 10 AS iw, p_size % 20 + 5 AS sh, p_size % 13 + 8 AS sw FROM part),
z AS (SELECT *, abs(iw / ih::DOUBLE - sw / sh::DOUBLE) > abs(iw / ih::DOUBLE - sh / sw::DOUBLE) AS swapped FROM p)
SELECT p_partkey, swapped, CASE WHEN swapped THEN u ELSE v END AS v, CASE WHEN swapped THEN v ELSE u END AS u FROM z""")
def orientation_fix(s, d):
    p = X.table(s, d, "part").selectExpr("p_partkey", "p_partkey % 24 AS v", "p_partkey % 31 AS u", "p_size + 10 AS ih", "(p_size * 7) % 50 + 10 AS iw", "p_size % 20 + 5 AS sh", "p_size % 13 + 8 AS sw")
    return R.fix_orientation(p, "ih", "iw", "sh", "sw").select("p_partkey", "swapped", "v", "u")


@query(f"WITH {X.SEEN_SQL}, k AS (SELECT * FROM uv WHERE cam = 0) SELECT (SELECT count(*) FROM pts) AS n_points, (SELECT count(*) FROM pts WHERE conf) AS n_confident, (SELECT count(*) FROM k WHERE conf) AS n_front, (SELECT count(*) FROM k WHERE conf AND u >= 0 AND u < 32 AND v >= 0 AND v < 24) AS n_inside")
def validation_metrics(s, d):
    return reprojection_metrics(X.points(s, d), X.poses(s, d).where("cam = 0"), W, H)


# Sizes and rasters

_SIZES = "WITH p AS (SELECT p_partkey, (p_size * 31 + 200)::DOUBLE AS w, (p_partkey % 977 + 150)::DOUBLE AS h FROM part)"


@query(f"""{_SIZES}, r AS (SELECT p_partkey, round_even(w * (512 / greatest(w, h)), 0)::INTEGER AS rw, round_even(h * (512 / greatest(w, h)), 0)::INTEGER AS rh FROM p),
c AS (SELECT *, rw // 2 AS cx, rh // 2 AS cy FROM r), f AS (SELECT *, ((2 * cx) // 16) * 16 / 2.0::DOUBLE AS fw, CASE WHEN rw = rh THEN 3 * (((2 * cx) // 16) * 16 / 2.0::DOUBLE) / 4 ELSE ((2 * cy) // 16) * 16 / 2.0::DOUBLE END AS fh FROM c)
SELECT p_partkey, rw AS resized_width, rh AS resized_height, cx - fw AS crop_left, cy - fh AS crop_top, cx + fw AS crop_right, cy + fh AS crop_bottom FROM f""")
def resize_crop_512(s, d):
    p = X.table(s, d, "part").selectExpr("p_partkey", "p_size * 31 + 200 AS w", "p_partkey % 977 + 150 AS h")
    return p.select("p_partkey", *(v.alias(k) for k, v in G.resize_crop("w", "h", 512).items()))


@query(f"""{_SIZES}, l AS (SELECT *, round_even(224.0 * greatest(w / h, h / w), 0) / greatest(w, h) AS k FROM p), r AS (SELECT p_partkey, round_even(w * k, 0)::INTEGER AS rw, round_even(h * k, 0)::INTEGER AS rh FROM l),
c AS (SELECT *, rw // 2 AS cx, rh // 2 AS cy, least(rw // 2, rh // 2)::DOUBLE AS f FROM r)
SELECT p_partkey, rw AS resized_width, rh AS resized_height, cx - f AS crop_left, cy - f AS crop_top, cx + f AS crop_right, cy + f AS crop_bottom FROM c""")
def resize_crop_224(s, d):
    p = X.table(s, d, "part").selectExpr("p_partkey", "p_size * 31 + 200 AS w", "p_partkey % 977 + 150 AS h")
    return p.select("p_partkey", *(v.alias(k) for k, v in G.resize_crop("w", "h", 224).items()))


@query("""WITH m AS (SELECT s_suppkey AS f, v, u, ((s_suppkey + v * 3 + u * 5) % 4 <> 0)::INTEGER AS m FROM supplier, range(12) a(v), range(16) b(u)),
g AS (SELECT s_suppkey AS f, v, u FROM supplier, range(9) a(v), range(20) b(u))
SELECT g.f, g.v::INTEGER AS v, g.u::INTEGER AS u, m.m FROM g JOIN m ON g.f = m.f AND m.v = least(g.v * 12 // 9, 11) AND m.u = least(g.u * 16 // 20, 15)""")
def mask_resize_nearest(s, d):
    f = X.table(s, d, "supplier").select(F.col("s_suppkey").alias("f"))

    def grid(h, w):
        return f.select("f", F.explode(F.sequence(F.lit(0), F.lit(h - 1))).alias("v")).select("f", "v", F.explode(F.sequence(F.lit(0), F.lit(w - 1))).alias("u"))

    mask = grid(12, 16).withColumn("m", ((F.col("f") + F.col("v") * 3 + F.col("u") * 5) % 4 != 0).cast("int"))
    return R.resize_nearest(mask, grid(9, 20), (12, 16), (9, 20), ["f"])


@query("""WITH g AS (SELECT s_suppkey AS f, v::INTEGER AS v, u::INTEGER AS u, (v + 0.5::DOUBLE) * 0.75::DOUBLE - 0.5 AS y, (u + 0.5::DOUBLE) * (4 / 3.0::DOUBLE) - 0.5 AS x FROM supplier, range(8) a(v), range(6) b(u)),
h AS (SELECT *, floor(y) AS y0, floor(x) AS x0 FROM g),
k AS (SELECT *, greatest(least(y0, 5), 0)::BIGINT AS a, greatest(least(y0 + 1, 5), 0)::BIGINT AS b, greatest(least(x0, 7), 0)::BIGINT AS c, greatest(least(x0 + 1, 7), 0)::BIGINT AS e FROM h)
SELECT f, v, u, round((((f + a * 8 + c) * 7 % 11) * (1 - (x - x0)) + ((f + a * 8 + e) * 7 % 11) * (x - x0)) * (1 - (y - y0)) + (((f + b * 8 + c) * 7 % 11) * (1 - (x - x0)) + ((f + b * 8 + e) * 7 % 11) * (x - x0)) * (y - y0), 6) AS depth FROM k""")
def depth_bilinear(s, d):
    f = X.table(s, d, "supplier").select(F.col("s_suppkey").alias("f"))
    packed = f.withColumn("data", F.transform(F.sequence(F.lit(0), F.lit(47)), lambda i: ((F.col("f") + i) * 7 % 11).cast("double")))
    grid = packed.withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(7)))).withColumn("u", F.explode(F.sequence(F.lit(0), F.lit(5))))
    return grid.select("f", "v", "u", _r(R.bilinear(F.col("data"), "v", "u", 6, 8, 8, 6)).alias("depth"))


# Rotations and poses

_M = [f"r{i}{j}" for i in range(3) for j in range(3)]


@query(f"WITH {X.CAMERAS_SQL} SELECT cam, {', '.join(f'round({m}, 9) AS {m}' for m in _M)} FROM cams")
def quat_to_matrix(s, d):
    return _cameras(s, d).select("cam", *(_r(m, 9).alias(m) for m in _M))


@query(f"WITH {X.CAMERAS_SQL} SELECT cam, round(a, 9) AS qx, round(b, 9) AS qy, round(c, 9) AS qz, round(d, 9) AS qw FROM q2")
def matrix_to_quat(s, d):
    q = G.matrix_to_quat([[F.col(f"r{i}{j}") for j in range(3)] for i in range(3)])
    return _cameras(s, d).select("cam", *(_r(x, 9).alias(n) for x, n in zip(q, ("qx", "qy", "qz", "qw"), strict=True)))


@query(f"WITH {X.CAMERAS_SQL} SELECT cam, round(-(r00 * tx + r10 * ty + r20 * tz), 9) AS ix, round(-(r01 * tx + r11 * ty + r21 * tz), 9) AS iy, round(-(r02 * tx + r12 * ty + r22 * tz), 9) AS iz FROM cams")
def se3_inverse(s, d):
    _, t = G.inverse_rigid([[F.col(f"r{i}{j}") for j in range(3)] for i in range(3)], ("tx", "ty", "tz"))
    return _cameras(s, d).select("cam", *(_r(x, 9).alias(n) for x, n in zip(t, ("ix", "iy", "iz"), strict=True)))


@query("SELECT n_nationkey AS cam, round((20 + n_nationkey % 5)::DOUBLE * 32 / (40 + n_nationkey), 9) AS fx, round((20 + n_nationkey % 5)::DOUBLE * 24 / (30 + n_nationkey), 9) AS fy, 16.0::DOUBLE AS ux, 12.0::DOUBLE AS uy FROM nation")
def intrinsics_scaled(s, d):
    poses = X.poses(s, d).withColumns({"processed_width": F.col("cam") + 40, "processed_height": F.col("cam") + 30})
    return V.camera_matrices(poses, W, H).select("cam", _r("fx", 9).alias("fx"), _r("fy", 9).alias("fy"), "ux", "uy")


@query("""WITH p AS (SELECT p_partkey, nullif(p_size % 3, 0) AS pose_w, nullif(p_size % 4, 0) AS raster_w, p_size AS image_w FROM part)
SELECT p_partkey, coalesce(pose_w, raster_w, -1) AS voter_k, coalesce(raster_w, pose_w, -1) AS voter_hw, coalesce(pose_w, raster_w, image_w) AS viewer FROM p""")
def size_fallback(s, d):
    p = X.table(s, d, "part").selectExpr("p_partkey", "nullif(p_size % 3, 0) AS pose_w", "nullif(p_size % 4, 0) AS raster_w", "p_size AS image_w")
    none = F.lit(-1)
    return p.select("p_partkey", F.coalesce(G.voter_intrinsic_size("pose_w", "raster_w"), none).alias("voter_k"), F.coalesce(G.voter_raster_size("pose_w", "raster_w"), none).alias("voter_hw"), G.viewer_size("pose_w", "raster_w", "image_w").alias("viewer"))


@query(f"WITH {X.CAMERAS_SQL} SELECT cam, {', '.join(f'round({m if m[2] == chr(48) else chr(45) + m}, 9) AS {m}' for m in _M)} FROM cams")
def gl_flip(s, d):
    m = G.to_opengl([[F.col(f"r{i}{j}") for j in range(3)] for i in range(3)])
    return _cameras(s, d).select("cam", *(_r(m[i][j], 9).alias(f"r{i}{j}") for i in range(3) for j in range(3)))


@query(f"""WITH {X.POINTS_SQL}, {X.CAMERAS_SQL}, k AS (SELECT * FROM cams WHERE cam = 0)
SELECT point, round(-(r00 * (x - tx) + r10 * (y - ty) + r20 * (z - tz)), 6) AS sx, round(-(r01 * (x - tx) + r11 * (y - ty) + r21 * (z - tz)), 6) AS sy, round(r02 * (x - tx) + r12 * (y - ty) + r22 * (z - tz), 6) AS sz FROM pts, k""")
def scene_transform(s, d):
    at = X.points(s, d).crossJoin(F.broadcast(_cameras(s, d).where("cam = 0").limit(1)))
    x, y, z = G.to_scene([[F.col(f"r{i}{j}") for j in range(3)] for i in range(3)], ("tx", "ty", "tz"), ("x", "y", "z"))
    return at.select("point", _r(x).alias("sx"), _r(y).alias("sy"), _r(z).alias("sz"))


@query(f"WITH {X.CAMERAS_SQL} SELECT cam, round(tx + (r00 * 0.5 + r02 * -0.25), 9) AS mx, round(ty + (r10 * 0.5 + r12 * -0.25), 9) AS my, round(tz + (r20 * 0.5 + r22 * -0.25), 9) AS mz FROM cams")
def move_camera(s, d):
    at = G.moved([[F.col(f"r{i}{j}") for j in range(3)] for i in range(3)], ("tx", "ty", "tz"), (0.5, 0.0, -0.25))
    return _cameras(s, d).select("cam", *(_r(x, 9).alias(n) for x, n in zip(at, ("mx", "my", "mz"), strict=True)))


# Keyframes


def _keys(s, d):
    return X.poses(s, d).withColumnRenamed("cam", "k")


@query(f"""WITH {X.CAMERAS_SQL}, t AS (SELECT frame, frame * (24 / 119.0::DOUBLE) AS t FROM range(120) r(frame)), g AS (SELECT frame, t, least(floor(t), 23)::BIGINT AS k FROM t)
SELECT frame::INTEGER AS frame, round(a.tx + (b.tx - a.tx) * (t - k), 9) AS tx, round(a.ty + (b.ty - a.ty) * (t - k), 9) AS ty, round(a.tz + (b.tz - a.tz) * (t - k), 9) AS tz FROM g JOIN q0 a ON a.cam = k JOIN q0 b ON b.cam = k + 1""")
def linspace_lerp(s, d):
    got = K.with_segment(K.sample_times(s, 25, 120), _keys(s, d), 25, ["tx", "ty", "tz"])
    return got.select("frame", *(_r(K.lerp(x), 9).alias(x) for x in ("tx", "ty", "tz")))


@query(f"""WITH {X.CAMERAS_SQL}, e AS (SELECT x.a AS a0, x.b AS b0, x.c AS c0, x.d AS d0, y.a AS a1, y.b AS b1, y.c AS c1, y.d AS d1, acos(least(abs(x.a * y.a + x.b * y.b + x.c * y.c + x.d * y.d), 1.0)) AS w FROM q2 x, q2 y WHERE x.cam = 0 AND y.cam = 7),
f AS (SELECT *, i / 20.0::DOUBLE AS t FROM e, range(21) r(i)), g AS (SELECT *, sin((1 - t) * w) / sin(w) AS p, sin(t * w) / sin(w) AS q FROM f)
SELECT i::INTEGER AS frame, round(p * a0 + q * a1, 6) AS qx, round(p * b0 + q * b1, 6) AS qy, round(p * c0 + q * c1, 6) AS qz, round(p * d0 + q * d1, 6) AS qw FROM g""")
def slerp2(s, d):
    n = F.sqrt(F.expr("qx * qx + qy * qy + qz * qz + qw * qw"))
    q = X.poses(s, d).select("cam", *((F.col(x) / n).alias(x) for x in ("qx", "qy", "qz", "qw")))
    both = q.where("cam = 0").select(*(F.col(x).alias(f"{x}0") for x in q.columns[1:])).crossJoin(q.where("cam = 7").select(*(F.col(x).alias(f"{x}1") for x in q.columns[1:])))
    at = both.withColumn("frame", F.explode(F.sequence(F.lit(0), F.lit(20)))).withColumn("t", F.col("frame") / 20)
    out = G.slerp([F.col(f"{x}0") for x in q.columns[1:]], [F.col(f"{x}1") for x in q.columns[1:]], F.col("t"))
    return at.select("frame", *(_r(v).alias(x) for v, x in zip(out, q.columns[1:], strict=True)))


@query("""WITH k AS (SELECT n_nationkey AS k, (n_nationkey % 4 * 100)::DOUBLE AS fx, (640 + n_nationkey)::DOUBLE AS w FROM nation)
SELECT k, round(CASE WHEN fx > 0 THEN 2 * atan(tan(atan(w / (2 * fx))) / (w / 2 / 480.0::DOUBLE)) ELSE 0.7853981633974483 END, 6) AS yfov FROM k""")
def yfov(s, d):
    k = X.table(s, d, "nation").selectExpr("n_nationkey AS k", "cast(n_nationkey % 4 * 100 AS double) AS fx", "cast(640 + n_nationkey AS double) AS w")
    return k.select("k", _r(G.yfov("fx", "w", F.col("w") / 2 / 480.0)).alias("yfov"))


#: A not-a-knot spline: both end conditions give the second and the last but one curvature at once, a tridiagonal system the others.
_SPLINE = f"""WITH RECURSIVE {X.CAMERAS_SQL}, k AS (SELECT cam AS i, tx AS x, ty AS y, tz AS z FROM q0),
r AS (SELECT b.i, 6 * (a.x - 2 * b.x + c.x) AS x, 6 * (a.y - 2 * b.y + c.y) AS y, 6 * (a.z - 2 * b.z + c.z) AS z FROM k a JOIN k b ON b.i = a.i + 1 JOIN k c ON c.i = b.i + 1),
fw AS (SELECT i, 0.0::DOUBLE AS c, x / 6 AS x, y / 6 AS y, z / 6 AS z FROM r WHERE i = 1
  UNION ALL SELECT r.i, 1 / (4 - f.c), (r.x - f.x) / (4 - f.c), (r.y - f.y) / (4 - f.c), (r.z - f.z) / (4 - f.c) FROM fw f JOIN r ON r.i = f.i + 1 WHERE r.i <= 22),
bw AS (SELECT i, x / 6 AS x, y / 6 AS y, z / 6 AS z FROM r WHERE i = 23
  UNION ALL SELECT f.i, f.x - f.c * b.x, f.y - f.c * b.y, f.z - f.c * b.z FROM bw b JOIN fw f ON f.i = b.i - 1),
s AS (SELECT * FROM bw UNION ALL SELECT 0, 2 * a.x - b.x, 2 * a.y - b.y, 2 * a.z - b.z FROM bw a, bw b WHERE a.i = 1 AND b.i = 2
  UNION ALL SELECT 24, 2 * a.x - b.x, 2 * a.y - b.y, 2 * a.z - b.z FROM bw a, bw b WHERE a.i = 23 AND b.i = 22),
t AS (SELECT frame, frame * (24 / 119.0::DOUBLE) AS t FROM range(120) r(frame)), g AS (SELECT frame, t, least(floor(t), 23)::BIGINT AS i FROM t)
SELECT frame::INTEGER AS frame, round(t, 6) AS t, {", ".join(f"round(a.{x} + (t - g.i) * (b.{x} - a.{x} - (2 * p.{x} + q.{x}) / 6 + (t - g.i) * (p.{x} / 2 + (t - g.i) * (q.{x} - p.{x}) / 6)), 6) AS t{x}" for x in "xyz")}
FROM g JOIN k a ON a.i = g.i JOIN k b ON b.i = g.i + 1 JOIN s p ON p.i = g.i JOIN s q ON q.i = g.i + 1"""


@query(_SPLINE)
def spline_positions(s, d):
    got = K.spline_positions(K.sample_times(s, 25, 120), _keys(s, d), ["tx", "ty", "tz"])
    return got.select("frame", *(_r(x).alias(x) for x in ("t", "tx", "ty", "tz")))


@query()
def spline_rotations(s, d):
    rows = _keys(s, d).orderBy("k").select("qx", "qy", "qz", "qw").collect()  # keyframes are few
    times = np.linspace(0, len(rows) - 1, 120)
    got = K.rotation_spline(np.array([list(map(float, r)) for r in rows]), times)
    return s.createDataFrame([(i, float(t), *map(float, q)) for i, (t, q) in enumerate(zip(times, got, strict=True))], "frame int, t double, qx double, qy double, qz double, qw double")


@query("""WITH e AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'purchase' THEN 1 ELSE -1 END AS v FROM events WHERE event_type IN ('purchase', 'error')),
a AS (SELECT *, sum(v) OVER w AS total FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, total - least(min(total) OVER w, 0) AS depth FROM a WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, (depth - 1)::INTEGER AS pos, event_id AS kf FROM b x WHERE v = 1 AND NOT EXISTS (SELECT 1 FROM b y WHERE y.user_id = x.user_id AND (y.ts, y.event_id) > (x.ts, x.event_id) AND y.depth < x.depth)""")
def keyframe_stack(s, d):
    log = X.table(s, d, "events").select("user_id", "event_id", "ts", F.when(F.col("event_type") == "purchase", "append").when(F.col("event_type") == "error", "undo").otherwise("other").alias("action"))
    return K.keyframe_stack(log.withColumn("kf", F.col("event_id")), "user_id", ["ts", "event_id"], "action", "kf")


@query()
def camera_path(s, d):
    keys = _keys(s, d).withColumn("yfov", F.lit(0.6) + F.col("k") / 100.0)
    return K.camera_path(keys, 120)


@query("""WITH k AS (SELECT n_nationkey AS k, nullif(n_nationkey % 3, 0) * 300 AS own, nullif(n_nationkey % 5, 0) * 200 AS ci, nullif(n_nationkey % 2, 0) * 700 AS cs, (n_nationkey * 37 - 60) / 2.0::DOUBLE AS cx FROM nation)
SELECT k, CASE WHEN own IS NULL AND cx > 0 THEN greatest(coalesce(own, ci, cs, 640)::DOUBLE, round_even(2 * cx + 1, 0)) ELSE coalesce(own, ci, cs, 640)::DOUBLE END AS width FROM k""")
def keyframe_source_size(s, d):
    k = X.table(s, d, "nation").selectExpr("n_nationkey AS k", "nullif(n_nationkey % 3, 0) * 300 AS own", "nullif(n_nationkey % 5, 0) * 200 AS ci", "nullif(n_nationkey % 2, 0) * 700 AS cs", "cast((n_nationkey * 37 - 60) / 2 AS double) AS cx")
    return k.select("k", G.keyframe_source_size("own", "ci", "cs", F.lit(640), "cx").alias("width"))


# Records, reports, pictures


@query(f"""WITH {X.CAMERAS_SQL}, f AS (SELECT printf('frame_%04d.jpg', p_partkey) AS filename, (600 + p_size * 13)::INTEGER AS w, (400 + p_partkey % 300)::INTEGER AS h FROM part),
o AS (SELECT *, row_number() OVER (ORDER BY filename) - 1 AS pos FROM f),
z AS (SELECT j.*, round_even(w * (512.0::DOUBLE / greatest(w, h)), 0)::INTEGER AS rw, round_even(h * (512.0::DOUBLE / greatest(w, h)), 0)::INTEGER AS rh FROM (SELECT cam, o.filename, w, h, a, b, c, d, q2.tx, q2.ty, q2.tz, q2.focal FROM q2 JOIN o ON o.pos = q2.cam) j),
y AS (SELECT *, rw // 2 AS cx, rh // 2 AS cy FROM z), v AS (SELECT *, ((2 * cx) // 16) * 8.0::DOUBLE AS hw, CASE WHEN rw = rh THEN 3 * (((2 * cx) // 16) * 8.0::DOUBLE) / 4 ELSE ((2 * cy) // 16) * 8.0::DOUBLE END AS hh FROM y)
SELECT cam::INTEGER AS frame_idx, filename, round(a, 9) AS qx, round(d, 9) AS qw, focal, w AS original_width, h AS original_height, rw AS resized_width, rh AS resized_height, cx - hw AS crop_left, cy - hh AS crop_top, cx + hw AS crop_right, cy + hh AS crop_bottom FROM v""")
def pose_records(s, d):
    scene = _cameras(s, d).join(X.poses(s, d).select("cam", "focal"), "cam").withColumnsRenamed({"cam": "pos"}).withColumns({"processed_width": F.lit(512), "processed_height": F.lit(384)})
    frames = X.table(s, d, "part").select(F.format_string("frame_%04d.jpg", "p_partkey").alias("filename"), F.expr("cast(600 + p_size * 13 AS int)").alias("original_width"), F.expr("cast(400 + p_partkey % 300 AS int)").alias("original_height"))
    got = J.pose_records(scene, frames, 512)
    return got.select("frame_idx", "filename", _r("qx", 9).alias("qx"), _r("qw", 9).alias("qw"), "focal", "original_width", "original_height", "resized_width", "resized_height", "crop_left", "crop_top", "crop_right", "crop_bottom")


@query("""SELECT p_partkey AS id, p_partkey % 24 AS v, p_partkey % 32 AS u FROM part UNION ALL SELECT s_suppkey AS id, s_suppkey % 24 AS v, s_suppkey % 32 + 32 AS u FROM supplier""")
def side_by_side(s, d):
    left = X.table(s, d, "part").selectExpr("p_partkey AS id", "p_partkey % 24 AS v", "p_partkey % 32 AS u")
    right = X.table(s, d, "supplier").selectExpr("s_suppkey AS id", "s_suppkey % 24 AS v", "s_suppkey % 32 AS u")
    return J.side_by_side(left, right, W)


@query(f"""WITH {X.POINTS_SQL}, a AS (SELECT *, 24 * x / z + 16 AS pu, 24 * y / z + 12 AS pv FROM pts WHERE conf)
SELECT point, trunc(pu * (1280 / 32.0::DOUBLE))::BIGINT AS u, trunc(pv * (720 / 24.0::DOUBLE))::BIGINT AS v FROM a WHERE pu * 40 >= 0 AND pu * 40 < 1280 AND pv * 30 >= 0 AND pv * 30 < 720""")
def camera_frame_points(s, d):
    """Points that are in the camera's frame already, on the original image."""
    p = X.points(s, d).where("conf").select("point", G.scaled_pixel("x", "z", F.lit(24.0), F.lit(16.0), F.lit(1280), F.lit(32)).alias("pu"), G.scaled_pixel("y", "z", F.lit(24.0), F.lit(12.0), F.lit(720), F.lit(24)).alias("pv"))
    return p.where(G.inside_float("pu", "pv", F.lit(1280), F.lit(720))).select("point", F.col("pu").cast("long").alias("u"), F.col("pv").cast("long").alias("v"))


@query(f"""WITH {X.SEEN_SQL}, m AS (SELECT (SELECT count(*) FROM pts) AS n, (SELECT count(*) FROM pts WHERE conf) AS c,
  (SELECT count(*) FROM eye WHERE cam = 0 AND conf AND cz > 0) AS f, (SELECT count(*) FROM uv WHERE cam = 0 AND conf AND u >= 0 AND u < 32 AND v >= 0 AND v < 24) AS i)
SELECT printf('%d points, %d confident, %d in front, %d inside (%.1f%%)', n, c, f, i, CASE WHEN c > 0 THEN i * 100.0::DOUBLE / c ELSE 0.0::DOUBLE END) AS line FROM m""")
def validation_report(s, d):
    return J.report(reprojection_metrics(X.points(s, d), X.poses(s, d).where("cam = 0"), W, H))


@query("SELECT p_partkey, coalesce(nullif(p_size % 4, 0) * 50 / 255.0::DOUBLE, 0.7::DOUBLE) AS r FROM part")
def colour_fill(s, d):
    return X.table(s, d, "part").select("p_partkey", G.colour_fraction(F.expr("nullif(p_size % 4, 0) * 50")).alias("r"))


# Colours, samples, names


@query("""WITH a AS (SELECT p_partkey AS id, 'full' AS tag, CASE WHEN p_size % 3 = 0 THEN 1.0::DOUBLE ELSE p_size / 255.0::DOUBLE END AS r FROM part),
b AS (SELECT s_suppkey AS id, 'segmented' AS tag, 1.0::DOUBLE AS r FROM supplier ORDER BY s_suppkey LIMIT 50)
SELECT id, tag, r, CASE WHEN tag = 'full' THEN r ELSE 0.45 END AS g, CASE WHEN tag = 'full' THEN r ELSE 0.0 END AS b FROM (SELECT * FROM a UNION ALL SELECT * FROM b)""")
def recolor_union(s, d):
    grey = F.when(F.col("p_size") % 3 == 0, F.lit(None)).otherwise(F.col("p_size") / 255.0)
    full = X.table(s, d, "part").select(F.col("p_partkey").alias("id"), grey.alias("r"), grey.alias("g"), grey.alias("b"))
    return J.coloured_union(full, X.table(s, d, "supplier").select(F.col("s_suppkey").alias("id")), 100, ["id"]).select("id", "tag", "r", "g", "b")


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY md5(o_orderkey::VARCHAR), o_orderkey LIMIT 500")
def sample_fixed(s, d):
    return J.fixed_sample(X.table(s, d, "orders").select("o_orderkey", "o_custkey"), 500, F.col("o_orderkey"))


@query(r"""WITH f AS (SELECT p_partkey, printf('frame_%04d', p_partkey) || CASE p_partkey % 5 WHEN 0 THEN '.jpg' WHEN 1 THEN '.JPG' WHEN 2 THEN '.png' WHEN 3 THEN '.jpeg' ELSE '.txt' END AS filename FROM part)
SELECT p_partkey, filename, regexp_replace(filename, '\.[^.]*$', '') AS stem, replace(filename, '.jpg', '.npz') AS mask_name, filename LIKE '%.jpg' AS is_jpg FROM f WHERE regexp_matches(lower(filename), '\.(jpg|jpeg|png)$')""")
def stem_and_name(s, d):
    ext = F.element_at(F.array(*map(F.lit, (".jpg", ".JPG", ".png", ".jpeg", ".txt"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    f = X.table(s, d, "part").select("p_partkey", F.concat(F.format_string("frame_%04d", "p_partkey"), ext).alias("filename"))
    f = f.where(F.lower("filename").rlike(r"\.(jpg|jpeg|png)$"))
    return f.select("p_partkey", "filename", G.stem("filename").alias("stem"), F.replace("filename", F.lit(".jpg"), F.lit(".npz")).alias("mask_name"), F.col("filename").endswith(".jpg").alias("is_jpg"))
