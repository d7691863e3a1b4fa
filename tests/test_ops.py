"""Operators that SQL can't express, sources and sinks: hand-worked cases, brute force and round trips."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudloom.operators import geometry, rasters, vectors
from cloudloom.sources import arrays, colmap, ply, scenes


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_painting_on_free_pixels_and_box_suppression(spark):
    px = [(0, 1, 0.9, 0, u) for u in range(3)] + [(0, 2, 0.8, 0, u) for u in range(2, 4)] + [(0, 3, 0.7, 0, u) for u in range(3, 7)] + [(0, 4, None, 0, 9)]
    m = spark.createDataFrame(px, "view_idx int, mask_id int, score double, v int, u int")
    # mask 2 has one free pixel left, so it is passed over and mask 3 gets its own
    assert rows(rasters.paint_free(m, 2)) == [(0, 0, 0, 1), (0, 0, 1, 1), (0, 0, 2, 1), (0, 0, 3, 3), (0, 0, 4, 3), (0, 0, 5, 3), (0, 0, 6, 3)]
    b = spark.createDataFrame([("i", 1, 0.0, 0.0, 10.0, 10.0, 0.9), ("i", 2, 1.0, 1.0, 10.0, 10.0, 0.8), ("i", 3, 20.0, 0.0, 30.0, 10.0, 0.1), ("i", 3, 20.0, 0.0, 30.0, 10.0, 0.1), ("i", 4, 0.0, 0.0, 1.0, 1.0, 1.0)], "img string, box_id int, x0 double, y0 double, x1 double, y1 double, score double")
    assert [r[1] for r in rows(rasters.suppress(b, ["img"], 0.5, 4.0))] == [1, 3]
    assert rasters.suppress(b.limit(0), ["img"]).count() == 0 and rasters.paint_free(m.limit(0)).count() == 0


def test_similarity_of_images(spark):
    rng = np.random.default_rng(0)
    a = rng.random((14, 15))
    df = lambda y: spark.createDataFrame([(1, int(v), int(u), float(a[v, u]), float(y[v, u])) for v in range(14) for u in range(15)], "view_idx int, v int, u int, a double, b double")
    assert rasters.ssim(df(a), ["view_idx"], "a", "b").first().ssim == pytest.approx(1.0)
    got = rasters.ssim(df(1 - a), ["view_idx"], "a", "b").first().ssim
    assert got < 0.1


def test_shapes(spark):
    s = [(0, 0, "rectangle", [[1.0, 1.0], [3.0, 2.0]], 6, 5, 1), (0, 1, "point", [[2.0, 2.0]], 6, 5, 2), (0, 2, "polygon", [[0.0, 3.0], [6.0, 3.0], [6.0, 5.0], [0.0, 5.0]], 6, 5, 3), (0, 3, "circle", [[0.0, 0.0]], 6, 5, 4), (0, 4, "line", [[0.0, 0.0], [5.0, 0.0]], 6, 5, 5), (0, 5, "blob", None, 6, 5, 6)]
    got = {(r.v, r.u): r.mask_id for r in rasters.draw_shapes(spark.createDataFrame(s, "view_idx int, shape_no int, kind string, points array<array<double>>, width int, height int, mask_id int")).collect()}
    want = np.zeros((5, 6), dtype=int)
    want[1:3, 1:4], want[2, 2], want[3:5], want[0] = 1, 2, 3, 5
    assert got == {(v, u): want[v, u] for v in range(5) for u in range(6) if want[v, u]}


def test_fits(spark):
    rng = np.random.default_rng(4)
    x = rng.random((80, 3)) * 10
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    y = 1.7 * x @ q.T + [1.0, -2.0, 3.0]
    pairs = spark.createDataFrame([(*map(float, a), *map(float, b)) for a, b in zip(x, y)], "x double, y double, z double, tx double, ty double, tz double")
    scale, rot, shift = geometry.similarity_fit(pairs)
    assert scale == pytest.approx(1.7) and rot == pytest.approx(q) and shift == pytest.approx([1.0, -2.0, 3.0])
    with pytest.raises(ValueError):
        geometry.similarity_fit(pairs.limit(2))


def test_two_levels_and_nearest_in_blocks(spark, monkeypatch):
    df = spark.createDataFrame([(k, [float(k // 4 * 10 + k % 4)], [float(k // 4 * 100)]) for k in range(8)] + [(9, None, [0.0])], "id bigint, f array<double>, p array<double>")
    roots = spark.createDataFrame([(0, [0.0, 0.0]), (1, [10.0, 100.0])], "code bigint, centre array<double>")
    counts = spark.createDataFrame([(0, 2), (1, 1)], "root bigint, n int")
    got = {r.id: (r.root, r.leaf) for r in vectors.two_level(df.where("f is not null"), "id", "f", "p", roots, counts).collect()}
    assert [got[k][0] for k in range(8)] == [0] * 4 + [1] * 4 and {got[k][1] for k in range(4)} == {0, 1} and {got[k][1] for k in range(4, 8)} == {2}
    c = spark.createDataFrame([(k, [float(k)]) for k in range(30)], "code bigint, centre array<double>")
    want = rows(vectors.nearest_of(df, "id", "f", c, "code", "centre", k=2).select("id", "code", "rank"))
    monkeypatch.setattr(vectors, "BLOCK_NUMBERS", 7)
    assert rows(vectors.nearest_of(df, "id", "f", c, "code", "centre", k=2).select("id", "code", "rank")) == want and len(want) == 16
    with pytest.raises(ValueError):
        vectors.seed_similar(df, ["p"], "f", F.lit(False), 0.5)


def test_sources_and_sinks(spark, tmp_path):
    np.save(tmp_path / "m.npy", np.arange(12).reshape(2, 2, 3))
    assert rows(arrays.read_masks(spark, str(tmp_path / "m.npy"), 1).select("v", "u", "mask_id"))[0] == (0, 0, 6)
    np.savez(tmp_path / "v.npz", features=np.eye(2))
    assert [r.feat for r in arrays.read_vectors(spark, str(tmp_path / "v.npz")).orderBy("row").collect()] == [[1.0, 0.0], [0.0, 1.0]]
    (tmp_path / "d.bin").write_bytes(b"2&1&1&" + np.array([1.5, 2.5], dtype="<f4").tobytes())
    assert rows(arrays.read_dense(spark, str(tmp_path / "d.bin")).select("u", "value")) == [(0, 1.5), (1, 2.5)]
    cams = spark.createDataFrame([(2, "PINHOLE", 10, 20, [1.0, 2.0, 3.0, 4.0]), (1, "SIMPLE_PINHOLE", 5, 5, [1.0, 2.0, 3.0])], "camera_id int, model string, width bigint, height bigint, params array<double>")
    assert scenes.write_model(scenes.camera_records(cams), str(tmp_path / "cameras.bin")) == 2
    assert rows(colmap.read_cameras(spark, str(tmp_path / "cameras.bin")).select("camera_id", "model", "params")) == [(1, "SIMPLE_PINHOLE", [1.0, 2.0, 3.0]), (2, "PINHOLE", [1.0, 2.0, 3.0, 4.0])]
    imgs = spark.createDataFrame([(7, [1.0, 0.0, 0.0, 0.0], [1.0, 2.0, 3.0], 2, "a.jpg", [(1.0, 2.0, 5)]), (3, [1.0, 0.0, 0.0, 0.0], [0.0, 0.0, 0.0], 1, None, None)], "image_id int, qvec array<double>, tvec array<double>, camera_id int, name string, points2d array<struct<x:double,y:double,point3d_id:bigint>>")
    scenes.write_model(scenes.image_records(imgs), str(tmp_path / "images.bin"))
    assert rows(colmap.read_images(spark, str(tmp_path / "images.bin")).select("image_id", "name", F.size("points2d"))) == [(3, "", 0), (7, "a.jpg", 1)]
    pts = spark.createDataFrame([(5, 1.0, 2.0, 3.0, 1, None, 3, None, [(7, 0)])], "point3d_id bigint, x double, y double, z double, r smallint, g smallint, b smallint, error double, track array<struct<image_id:int,point2d_idx:int>>")
    scenes.write_model(scenes.point_records(pts), str(tmp_path / "points3D.bin"))
    assert rows(colmap.read_points3d(spark, str(tmp_path / "points3D.bin")).select("point3d_id", "g", "error", F.size("track"))) == [(5, 0, -1.0, 1)]
    (tmp_path / "points3D.txt").write_text("# id\n5 1 2 3 10 20 30 0.5 7 0\n")
    assert rows(colmap.read_points3d_text(spark, str(tmp_path / "points3D.txt")).select("r", "g", "b", "error")) == [(10, 20, 30, 0.5)]


def test_pose_shape_and_listing_files(spark, tmp_path):
    eye = [[1.0, 0, 0, 0], [0, 1.0, 0, 0], [0, 0, 1.0, 2.0], [0, 0, 0, 1.0]]
    (tmp_path / "p.json").write_text(json.dumps({"poses": [{"name": "a", "w2c": eye, "ortho": [0.0, 1.0, 2.0, 3.0]}, {"name": "bad", "w2c": [[1.0]]}]}))
    got = scenes.read_poses(spark, str(tmp_path / "p.json")).collect()
    assert [(r.name, r.w2c[11], r.projection_mode, r.ortho_y_max) for r in got] == [("a", 2.0, "orthographic", 3.0)]
    (tmp_path / "s.json").write_text(json.dumps({"imageHeight": 4, "imageWidth": 4, "shapes": [{"label": "roof", "shape_type": "point", "points": [[1.0, 2.0]]}]}))
    assert rows(scenes.read_shapes(spark, str(tmp_path / "s.json")).select("label", "kind", "width")) == [("roof", "point", 4)]
    (tmp_path / "pose.txt").write_text("1 0 0 5\n0 1 0 6\n0 0 1 7\n0 0 0 1\n")
    m = scenes.read_matrix_text(spark, str(tmp_path / "pose.txt")).select(F.lit("s").alias("scene"), F.lit("f0").alias("name"), "m")
    doc = json.loads(scenes.transforms_json(m, ["scene"], 10, 20, 1.0, 1.0, 5.0, 10.0).first().json)
    assert doc["w"] == 10 and doc["frames"][0]["transform_matrix"][1] == [0.0, -1.0, 0.0, 6.0]
    paths = spark.createDataFrame([("r/3_roof/b.ply",), ("r/3_roof/a.ply",), ("r/4/x.ply",), ("r/other/y.ply",)], "path string")
    assert rows(scenes.class_folders(paths)) == [(3, "roof", "r/3_roof/a.ply"), (4, "", "r/4/x.ply")]
    kinds = spark.createDataFrame([("a", "a/sparse/0/cameras.bin"), ("b", "b/transforms_train.json"), ("c", "c/x")], "scene string, path string")
    assert rows(scenes.scene_kinds(kinds)) == [("a", "colmap"), ("b", "blender"), ("c", "unknown")]
    assert scenes.random_cloud(spark, 100).where("abs(x) <= 1.3 and red between 0 and 255").count() == 100


def test_ply_formats(spark, tmp_path):
    big = tmp_path / "big.ply"
    big.write_bytes(b"ply\nformat binary_big_endian 1.0\nelement vertex 1\nproperty float x\nend_header\n" + b"\0\0\0\0")
    with pytest.raises(ValueError):
        ply.read_header(str(big))
    late = tmp_path / "late.ply"
    late.write_bytes(b"ply\nformat binary_little_endian 1.0\nelement info 2\nproperty int a\nelement vertex 1\nproperty float x\nend_header\n" + np.array([7, 8], dtype="<i4").tobytes() + np.array([1.5], dtype="<f4").tobytes())
    assert [r.x for r in ply.read_ply(spark, str(late)).collect()] == [1.5]
