from parallaxis.fixtures import HEIGHT, WIDTH, depth_rule, mask_rule
from parallaxis.operators.voting import camera_matrices
from parallaxis.streaming.arrivals import windowed_votes
from pyspark.sql import functions as F


def test_stream_counts_like_a_batch(spark, tmp_path):
    pts = spark.range(200).select(F.col("id").alias("point"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), ((F.col("id") * 7 % 21 - 10) / 10).alias("x"), ((F.col("id") * 5 % 17 - 8) / 10).alias("y"), (1 + F.col("id") % 9 / 4).alias("z"))
    pts.coalesce(1).write.parquet(str(tmp_path / "in"))
    poses = spark.createDataFrame([(i, 0.0, 0.0, 0.0, 1.0, 0.1 * i, 0.0, 0.0, 20.0) for i in range(4)], "cam int, qx double, qy double, qz double, qw double, tx double, ty double, tz double, focal double")
    cams = camera_matrices(poses, WIDTH, HEIGHT)
    batch = windowed_votes(pts, cams, "point", "ts", WIDTH, HEIGHT, mask_rule, depth_rule)
    stream = windowed_votes(spark.readStream.schema(pts.schema).parquet(str(tmp_path / "in")), cams, "point", "ts", WIDTH, HEIGHT, mask_rule, depth_rule)
    q = stream.writeStream.format("memory").queryName("votes").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("votes").collect())) == sorted(map(tuple, batch.collect())) != []
