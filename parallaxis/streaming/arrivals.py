"""Points arrive as a stream, cameras are known: votes are counted in event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.voting import ballots


def windowed_votes(points: DataFrame, cameras: DataFrame, key: str, time: str, width: int, height: int, mask, depth, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window, votes) over a stream of points (key, time, x, y, z); points later than the watermark are left out.

    Votes carry no state but the open windows' sums.
    """
    timed = points.withWatermark(time, late).withColumn("_key", F.struct(F.col(time).alias("at"), F.col(key).alias("key")))
    votes = ballots(timed.drop(key).withColumnRenamed("_key", key), cameras, key, width, height, mask, depth)
    return votes.select(F.col(f"{key}.at").alias("at")).groupBy(F.window("at", window)).agg(F.count("*").alias("votes"))
