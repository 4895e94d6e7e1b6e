"""Files in and out: rasters, poses, scenes, and the segmenting plan over generated files."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from parallaxis.plans.pipeline import segment_points
from parallaxis.sources import readers as R
from parallaxis.sources import writers as Wr


def pose(i, name, **more):
    return {"frame_idx": i, "filename": name, "tx": 0.1 * i, "ty": 0.0, "tz": 0.0, "qx": 0.0, "qy": 0.0, "qz": 0.0, "qw": 1.0, "focal": 8.0, **more}


def test_segmenting_counts_cameras_that_agree(spark, tmp_path):
    h, w = 6, 8
    for sub in ("masks", "depths", "pts"):
        (tmp_path / sub).mkdir()
    names = [f"frame_{i:04d}.jpg" for i in range(3)]
    (tmp_path / "poses.json").write_text(json.dumps([pose(i, n) for i, n in enumerate(names)], indent=2))
    v, u = np.mgrid[:h, :w]
    for i, n in enumerate(names):
        stem = n[:-4]
        z = np.full((h, w), 2.0, np.float32)
        pts = np.stack([(u + 0.5 - w / 2) / 8 * z + 0.1 * i, (v + 0.5 - h / 2) / 8 * z, z], -1).astype(np.float32)
        np.savez_compressed(tmp_path / "pts" / f"{stem}_pts3d.npz", pts3d=pts, mask=np.ones((h, w), bool))
        np.savez_compressed(tmp_path / "depths" / f"{stem}_depth.npz", depth=z)
        if i < 2:  # the third frame has no mask, so it has no candidates and never votes
            np.savez_compressed(tmp_path / "masks" / f"{stem}.npz", mask=np.ones((1, h, w), np.uint8))
    args = [str(tmp_path / x) for x in ("poses.json", "masks", "depths", "pts")]
    one = segment_points(spark, *args, min_votes=1).collect()
    two = segment_points(spark, *args, min_votes=2).collect()
    assert len(one) == 2 * h * w and max(r.votes for r in one) == 2
    assert len(two) <= len(one) and all(r.votes == 2 for r in two)


def test_old_poses_read_as_null(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps([pose(0, "a.jpg")], indent=2))
    r = R.read_poses(spark, str(tmp_path / "p.json")).first()
    assert r.filename == "a.jpg" and r.processed_width is None and r.crop_left is None


def test_raster_and_scene_round_trips(spark, tmp_path):
    df = spark.createDataFrame([("a.jpg", 2, 3, 1, [0.0, 1.0, 2.0, 3.0, 4.0, 5.0])], "filename string, height int, width int, channels int, data array<float>")
    assert Wr.write_npz(df, str(tmp_path), "depth") == 1
    back = R.read_npz(spark, str(tmp_path), "depth").first()
    assert (back.filename, back.height, back.width, list(back.data)) == ("a.jpg", 2, 3, [0, 1, 2, 3, 4, 5])
    pts = spark.createDataFrame([(1.0, 2.0, 3.0), (4.0, 5.0, 6.0)], "x double, y double, z double")
    assert Wr.write_glb(pts, str(tmp_path / "s.glb")) == 2
    got = R.read_glb(spark, str(tmp_path)).orderBy("x").collect()
    assert [(r.x, r.y, r.z, r.r, round(r.g, 3)) for r in got] == [(1, 2, 3, 1.0, 0.549), (4, 5, 6, 1.0, 0.549)]


def test_missing_files_raise(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        R.read_npz(spark, str(tmp_path), "pts3d")


@pytest.mark.parametrize("case", ["crop", "depth"])
def test_segmenting_undoes_crops_and_resizes_depths(spark, tmp_path, case):
    h, w = 6, 8
    for sub in ("masks", "depths", "pts"):
        (tmp_path / sub).mkdir()
    # Masks of 20 x 24 are resized to 10 x 12, then cut at top 2 and left 2 (2.5 to even).
    more = {"resized_width": 12, "resized_height": 10, "crop_left": 2.5, "crop_top": 2.0} if case == "crop" else {}
    poses = [pose(0, "a.jpg", **more), pose(1, "b.jpg", **more) | {"tx": 0.0}]
    (tmp_path / "poses.json").write_text(json.dumps(poses, indent=2))
    v, u = np.mgrid[:h, :w]
    z = 2.0 + 0.5 * u
    pts = np.stack([(u + 0.5 - w / 2) / 8 * z, (v + 0.5 - h / 2) / 8 * z, z], -1).astype(np.float32)
    big = np.zeros((20, 24), np.uint8)
    big[8:14, 6:14] = 1
    want = big[::2, ::2][2 : 2 + h, 2 : 2 + w] if case == "crop" else np.ones((h, w), np.uint8)
    # A depth of half the width: 2.25 + u, between its columns a plane with half-pixel centres, its ends clamped.
    depth = np.tile(2.25 + np.arange(w // 2), (h, 1)).astype(np.float32) if case == "depth" else z.astype(np.float32)
    if case == "depth":
        want = want * ((u > 0) & (u < w - 1))
    for n in ("a", "b"):
        np.savez_compressed(tmp_path / "pts" / f"{n}_pts3d.npz", pts3d=pts, mask=np.ones((h, w), bool))
        np.savez_compressed(tmp_path / "depths" / f"{n}_depth.npz", depth=depth)
        np.savez_compressed(tmp_path / "masks" / f"{n}.npz", mask=big if case == "crop" else np.ones((h, w), np.uint8))
    got = segment_points(spark, *(str(tmp_path / x) for x in ("poses.json", "masks", "depths", "pts")), min_votes=2, depth_abs=0.01, depth_rel=0.01).collect()
    # Both frames hold the same points.
    assert sorted((round(r.x, 4), round(r.y, 4), round(r.z, 4)) for r in got) == sorted(tuple(round(float(x), 4) for x in pts[i, j]) for i, j in zip(*np.nonzero(want), strict=True) for _ in range(2))


def test_records_and_listings_round_trip(spark, tmp_path):
    from parallaxis.functions.geometry import keyframe_source_size
    from parallaxis.operators.keyframes import camera_path
    from parallaxis.sources.readers import exists, list_frames, read_keyframes, read_poses
    from parallaxis.sources.writers import frame_name, prepare, write_keyframes, write_points, write_poses

    prepare(str(tmp_path / "frames"), wipe=False)
    for name in ("frame_0001.jpg", "frame_0000.jpg", "B.JPG", "c.png", "notes.txt"):
        (tmp_path / "frames" / name).write_bytes(b"x" * 1048576)
    folder = str(tmp_path / "frames")
    assert [r.filename for r in list_frames(spark, folder).collect()] == ["frame_0000.jpg", "frame_0001.jpg"]
    assert [r.filename for r in list_frames(spark, folder, "image").collect()] == ["B.JPG", "c.png", "frame_0000.jpg", "frame_0001.jpg"]
    assert [(r.filename, r.size_mb) for r in list_frames(spark, folder, "all").collect()][-1] == ("notes.txt", 1.0)
    prepare(folder, wipe=True)
    assert not list((tmp_path / "frames").iterdir())
    assert spark.range(1).select(frame_name(F.lit(7)).alias("n")).first().n == "frame_0007.jpg"
    poses = spark.createDataFrame([(1, "b.jpg", 0.5, 32), (0, "a.jpg", 0.25, 32)], "frame_idx int, filename string, tx double, processed_width int")
    write_poses(poses, str(tmp_path / "poses.json"))
    back = read_poses(spark, str(tmp_path / "poses.json")).collect()
    assert [(r.frame_idx, r.filename, r.tx, r.processed_width, r.crop_left) for r in back] == [(0, "a.jpg", 0.25, 32, None), (1, "b.jpg", 0.5, 32, None)]
    eye = [[1.0, 0.0, 0.0, 2.0], [0.0, 1.0, 0.0, 3.0], [0.0, 0.0, 1.0, 4.0], [0.0, 0.0, 0.0, 1.0]]
    lens = [[100.0, 0.0, 320.0], [0.0, 100.0, 240.0], [0.0, 0.0, 1.0]]
    keys = spark.createDataFrame([(0, eye, lens)], "k int, c2w_opencv array<array<double>>, intrinsic array<array<double>>")
    write_keyframes(keys, str(tmp_path / "out" / "keys.json"), 600, 480)
    got = read_keyframes(spark, str(tmp_path / "out" / "keys.json"))
    size = keyframe_source_size("intrinsic_width", F.lit(None), "width", F.lit(1), F.expr("intrinsic[0][2]"))
    assert got.select("k", "c2w_opencv", size.alias("w")).first() == (0, eye, 641.0)
    one = got.selectExpr("k", *(f"c2w_opencv[{i}][3] AS t{x}" for i, x in enumerate("xyz")), "0D AS qx", "0D AS qy", "0D AS qz", "1D AS qw", "0.5D AS yfov")
    assert [(r.frame, r.tx, r.tz, r.r00, r.r11, r.r22, r.yfov) for r in camera_path(one, 3).collect()] == [(i, 2.0, 4.0, 1.0, -1.0, -1.0, 0.5) for i in range(3)]
    write_points(spark.createDataFrame([(1.0, 2.0, 3.0)], "x double, y double, z double"), str(tmp_path / "points"))
    assert spark.read.parquet(str(tmp_path / "points")).first() == (1.0, 2.0, 3.0) and exists(spark, str(tmp_path / "points")) and not exists(spark, str(tmp_path / "none"))
