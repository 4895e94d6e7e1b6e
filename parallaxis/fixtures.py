"""Points, cameras, rasters and logs worked out of the driver tables by integer rules that DuckDB follows as well."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH, HEIGHT = 32, 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS point",
        "((o_orderkey * 7919 + o_custkey * 31) % 2001 - 1000) / 500 AS x",
        "((o_orderkey * 6151 + o_custkey * 17) % 2001 - 1000) / 500 AS y",
        "((o_orderkey * 3571 + o_custkey * 13) % 2001) / 1000 + 1 AS z",
        "o_orderkey % 3 <> 0 AS conf",
    )


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").selectExpr(
        "n_nationkey AS cam",
        "format_string('frame_%04d.jpg', n_nationkey) AS filename",
        "cast(n_nationkey % 3 - 1 AS double) AS qx",
        "cast(n_nationkey % 5 - 2 AS double) AS qy",
        "cast(n_nationkey % 7 - 3 AS double) AS qz",
        "cast(20 AS double) AS qw",
        "(n_nationkey % 5 - 2) / 10 AS tx",
        "(n_nationkey % 3 - 1) / 10 AS ty",
        "(n_nationkey % 4) / 10 AS tz",
        "cast(20 + n_nationkey % 5 AS double) AS focal",
    )


def mask_rule(cam: Column, u: Column, v: Column) -> Column:
    return (cam * 7 + u * 3 + v * 5) % 4 != 0


def depth_rule(cam: Column, u: Column, v: Column) -> Column:
    return 1 + ((cam + u + v) % 9) / F.lit(4.0)


#: The same for DuckDB: points, cameras with their matrices, and what each camera sees.
POINTS_SQL = """pts AS (SELECT o_orderkey AS point, ((o_orderkey * 7919 + o_custkey * 31) % 2001 - 1000) / 500.0::DOUBLE AS x,
  ((o_orderkey * 6151 + o_custkey * 17) % 2001 - 1000) / 500.0::DOUBLE AS y, ((o_orderkey * 3571 + o_custkey * 13) % 2001) / 1000.0::DOUBLE + 1 AS z,
  o_orderkey % 3 <> 0 AS conf FROM orders)"""
CAMERAS_SQL = """q0 AS (SELECT n_nationkey AS cam, printf('frame_%04d.jpg', n_nationkey) AS filename, (n_nationkey % 3 - 1)::DOUBLE AS qx, (n_nationkey % 5 - 2)::DOUBLE AS qy, (n_nationkey % 7 - 3)::DOUBLE AS qz, 20.0::DOUBLE AS qw,
  (n_nationkey % 5 - 2) / 10.0::DOUBLE AS tx, (n_nationkey % 3 - 1) / 10.0::DOUBLE AS ty, (n_nationkey % 4) / 10.0::DOUBLE AS tz, (20 + n_nationkey % 5)::DOUBLE AS focal FROM nation),
q1 AS (SELECT *, sqrt(qx * qx + qy * qy + qz * qz + qw * qw) AS n FROM q0),
q2 AS (SELECT cam, filename, qx / n AS a, qy / n AS b, qz / n AS c, qw / n AS d, tx, ty, tz, focal FROM q1),
cams AS (SELECT cam, filename, tx, ty, tz, focal, 1 - 2 * (b * b + c * c) AS r00, 2 * (a * b - c * d) AS r01, 2 * (a * c + b * d) AS r02,
  2 * (a * b + c * d) AS r10, 1 - 2 * (a * a + c * c) AS r11, 2 * (b * c - a * d) AS r12, 2 * (a * c - b * d) AS r20, 2 * (b * c + a * d) AS r21, 1 - 2 * (a * a + b * b) AS r22 FROM q2)"""
SEEN_SQL = f"""{POINTS_SQL}, {CAMERAS_SQL},
eye AS (SELECT point, conf, cam, focal, r00 * (x - tx) + r10 * (y - ty) + r20 * (z - tz) AS cx, r01 * (x - tx) + r11 * (y - ty) + r21 * (z - tz) AS cy, r02 * (x - tx) + r12 * (y - ty) + r22 * (z - tz) AS cz FROM pts, cams),
uv AS (SELECT point, conf, cam, cz, focal * cx / cz + 16 AS u, focal * cy / cz + 12 AS v FROM eye WHERE cz > 0),
seen AS (SELECT point, conf, cam, cz, trunc(u)::BIGINT AS ui, trunc(v)::BIGINT AS vi FROM uv),
inb AS (SELECT * FROM seen WHERE ui >= 0 AND ui < 32 AND vi >= 0 AND vi < 24),
ballots AS (SELECT point, cam FROM inb WHERE (cam * 7 + ui * 3 + vi * 5) % 4 <> 0 AND abs(cz - (1 + ((cam + ui + vi) % 9) / 4.0::DOUBLE)) <= greatest(0.03, 0.05 * (1 + ((cam + ui + vi) % 9) / 4.0::DOUBLE)))"""
