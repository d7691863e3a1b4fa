import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudloom.functions import exprs as X
from cloudloom.operators import drift, references, spatial, tracks, views, voxels
from cloudloom.operators import points as P
from cloudloom.sources import colmap, ply

DATA = "/root/testdata/sf0.001"
T0, T1, T2 = "2024-01-01 00:00:00", "2024-02-01 00:00:00", "2024-03-01 00:00:00"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_dangling_references(spark):
    cams = spark.sql(f"select * from values (1, timestamp'{T0}', null), (2, timestamp'{T2}', null), (3, timestamp'{T0}', timestamp'{T1}') t(camera_id, loaded_at, deleted_at)").withColumn("deleted_at", F.col("deleted_at").cast("timestamp"))
    imgs = spark.sql(
        f"""select image_id, camera_id, timestamp'{T1}' loaded_at, cast(null as timestamp) deleted_at, cast(null as array<struct<x:double,y:double,point3d_id:bigint>>) points2d, 'extra' scene
        from values (10, 1), (11, 2), (12, 3), (13, 99), (14, -1), (15, null), (13, 99) t(image_id, camera_id)"""
    )
    pts = spark.sql(f"select cast(5 as bigint) point3d_id, array(named_struct('image_id', 10, 'point2d_idx', 0), named_struct('image_id', 10, 'point2d_idx', 1), named_struct('image_id', 77, 'point2d_idx', 0)) track, timestamp'{T1}' loaded_at, cast(null as timestamp) deleted_at")
    found = references.dangling(*references.scene_references(cams, imgs, pts)).select("src_field", "src_id", "ref_id", "ref_state")
    assert rows(found) == [
        ("images.camera_id", 11, 2, "late"),
        ("images.camera_id", 12, 3, "deleted"),
        ("images.camera_id", 13, 99, "missing"),
        ("sparse_points.track", 5, 77, "missing"),
    ]
    empty = references.dangling(*references.scene_references(cams.limit(0), imgs.limit(0), pts.limit(0)))
    assert empty.count() == 0


def test_schema_drift(spark):
    head = lambda *p: "ply\nformat ascii 1.0\ncomment property float old\nelement vertex 2\n" + "".join(f"property {x}\n" for x in p) + "element face 1\nproperty list uchar int vertex_indices\nend_header\n"
    files = spark.createDataFrame(
        [(1, "s", head("float x", "float opacity", "uchar red")), (2, "s", head("float32 x", "double alpha", "int n")), (3, "t", None), (None, "t", None)], "file_id bigint, series string, ply_header string"
    ).withColumns({"written_at": F.timestamp_seconds("file_id"), "loaded_at": F.timestamp_seconds(F.lit(1))})
    verts = spark.createDataFrame(
        [(1, 0, "1.0 0.5 7"), (1, 1, "2,0 NA 9"), (2, 0, "1.000 5e-1 3"), (2, 1, "2 0.7 4"), (2, 1, "2 0.7 4"), (2, 2, None)], "file_id bigint, vertex_idx int, record_text string"
    )
    fs = drift.files(files)
    maps = drift.vertex_maps(verts, fs)
    found = drift.changes(fs, verts)
    got = rows(found.select("file_id", "change_kind", "old_field", "new_field"))
    assert got == [(2, "added", "", "n"), (2, "removed", "red", ""), (2, "renamed", "opacity", "alpha"), (2, "retyped", "opacity", "alpha")]
    stats = {(r["file_id"], r["field"]): r for r in drift.type_statistics(maps, fs).collect()}
    assert stats[(1, "opacity")]["n_missing"] == 1 and stats[(1, "x")]["max_value"] == 2.0
    long = drift.consistent(maps, drift.lineage(fs, found))
    assert {r["path"] for r in long.where("file_id = 2").collect()} == {"x", "opacity", "n"}


def _series(spark, *files):
    """Files of one series: (properties, lines of values)."""
    head = lambda p: "ply\nformat ascii 1.0\nelement vertex 9\n" + "".join(f"property {x}\n" for x in p) + "end_header\n"
    f = spark.createDataFrame([(k, "s", head(p)) for k, (p, _) in enumerate(files)], "file_id bigint, series string, ply_header string")
    v = spark.createDataFrame([(k, i, t) for k, (_, lines) in enumerate(files) for i, t in enumerate(lines)], "file_id bigint, vertex_idx int, record_text string")
    return drift.files(f.withColumns({"written_at": F.timestamp_seconds("file_id"), "loaded_at": F.timestamp_seconds(F.lit(1))})), v


def test_a_renamed_name_may_come_again(spark):
    fs, v = _series(spark, (["float x", "float a"], ["1 5", "2 6"]), (["float x", "float b"], ["1 5", "2 6"]), (["float x", "float b", "float a"], ["1 5 70", "2 6 80"]), (["float x", "float b", "float a"], ["1 5 71"]))
    found = drift.changes(fs, v)
    assert rows(found.select("file_id", "change_kind", "old_field", "new_field")) == [(1, "renamed", "a", "b"), (2, "added", "", "a")]
    lines = {(r.file_id, r.field): r.path for r in drift.lineage(fs, found).collect()}
    assert (lines[1, "b"], lines[3, "b"], lines[2, "a"], lines[3, "a"]) == ("a", "a", "a#2", "a#2")
    long = drift.consistent(drift.vertex_maps(v, fs), drift.lineage(fs, found))
    assert {(r.path, r.value) for r in long.where("file_id = 2 and vertex_idx = 0").collect()} == {("x", 1.0), ("a", 5.0), ("a#2", 70.0)}


def test_double_names_short_rows_and_failed_casts(spark):
    fs, v = _series(spark, (["uchar r", "float r", "float y", "int n"], ["999 1 2 3", "7 1 1e39 2.5", "NA 1", "x 1 2 3"]))
    stats = {r.field: r for r in drift.type_statistics(drift.vertex_maps(v, fs), fs).collect()}
    assert (stats["r"].type, stats["r"].n_values, stats["r"].n_missing, stats["r"].n_failed_cast) == ("uchar", 4, 1, 2)
    assert (stats["y"].n_values, stats["y"].n_failed_cast, stats["n"].n_failed_cast) == (3, 1, 1)
    long = drift.consistent(drift.vertex_maps(v, fs), drift.lineage(fs, drift.changes(fs, v)))
    assert {(r.path, r.failed) for r in long.where("vertex_idx = 1").collect()} == {("r", False), ("y", True), ("n", True)}
    assert drift.changes(*_series(spark, (["float x"], []), (["float z"], []))).count() == 2


def test_expressions(spark):
    r = spark.range(1).select(
        X.sigmoid(F.lit(0.0)).alias("s"), X.logit(F.lit(0.5)).alias("l"), X.logit(F.lit(0.0)).alias("n"), X.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0))).alias("c"),
        X.normalise(F.array(F.lit(3.0), F.lit(4.0))).alias("u"), X.safe_name(F.lit("  a b/c ")).alias("name"), X.safe_name(F.lit("//")).alias("none"), X.stem(F.lit("p\\q/a.b.JPG")).alias("stem"),
        X.linear_to_srgb(X.srgb_to_linear(F.lit(0.3))).alias("srgb"), X.focal(X.fov(F.lit(500.0), F.lit(640)), F.lit(640)).alias("f"),
    ).first()
    assert (r.s, r.l, r.n, r.c, r.u, r.name, r.none, r.stem) == (0.5, 0.0, None, 0.0, [0.6, 0.8], "a_b_c", "unnamed", "a.b")
    assert r.srgb == pytest.approx(0.3) and r.f == pytest.approx(500)
    q = spark.range(1).select(*[c.alias(f"r{i}") for i, c in enumerate(X.rotation(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(2.0)))]).first()
    assert list(q) == pytest.approx([-1, 0, 0, 0, -1, 0, 0, 0, 1])


def test_quarters_partition_and_ties(spark):
    df = spark.createDataFrame([(1, "s", 0.0, 0.0, 0.0), (2, "s", 1.0, 1.0, 0.0), (3, "s", 2.0, 2.0, 0.0)], "point_id bigint, scene string, x double, y double, z double")
    assert rows(P.quarters(df, ["scene"]).select("point_id", "quarter")) == [(1, 0), (2, 0), (3, 3)]
    assert P.quarters(df.limit(0), ["scene"]).count() == 0
    assert rows(P.min_max(df.withColumn("z", F.lit(5.0)), ["x", "z"], ["scene"]).select("x", "z")) == [(0.0, 0.0), (0.5, 0.0), (1.0, 0.0)]
    assert rows(P.core_points(df, "point_id", ["scene"], F.lit(1.0), 0.3, 2, 10).select("point_id")) == [(1,), (2,)]
    assert P.sample_n(df, "point_id", 2).count() == 2


def test_zbuffer_and_votes(spark):
    ident = [1.0 if i % 5 == 0 else 0.0 for i in range(16)]
    pts = spark.createDataFrame([(1, "s", 0.0, 0.0, 2.0), (2, "s", 0.0, 0.0, 2.0), (3, "s", 0.0, 0.0, 1.0), (4, "s", 0.0, 0.0, -1.0), (5, "s", None, 0.0, 1.0)], "point_id bigint, scene string, x double, y double, z double")
    cols = "view_idx int, scene string, w2c array<double>, fx double, fy double, cx double, cy double, width int, height int, projection_mode string, ortho_x_min double, ortho_x_max double, ortho_y_min double, ortho_y_max double, ortho_v_mode string"
    vw = spark.createDataFrame([(0, "s", ident, None, None, None, None, 10, 10, None, 0.0, 0.0, 0.0, 0.0, "auto"), (1, "s", ident, 1.0, 1.0, 5.0, 5.0, 10, 10, "orthographic", -1.0, 1.0, -1.0, 1.0, "auto")], cols)
    seen = views.nearest_per_pixel(views.project(pts, vw))
    assert rows(seen.select("view_idx", "point_id")) == [(0, 3), (1, 1), (1, 2), (1, 3)]
    v = spark.createDataFrame([(1, 7, 5, 3), (1, 4, 5, 1), (2, 1, 1, 0)], "cluster int, mask_id int, n bigint, first_view int")
    s = {r["cluster"]: r for r in views.vote_stats(v, 2, 0.5).collect()}
    assert (s[1]["top1"], s[1]["top2"], s[1]["label"], s[2]["label"], s[2]["top2"]) == (4, 7, 4, 255, -1)


def test_dbscan_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.random((150, 3)) * 4
    df = spark.createDataFrame([(i, "s", *map(float, p)) for i, p in enumerate(x)], "point_id bigint, scene string, x double, y double, z double")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    core = (d <= 0.5).sum(1) >= 4
    comp = np.where(core, np.arange(150), 10**6)
    for _ in range(150):
        comp = np.where(core, np.where((d <= 0.5) & core[None], comp[None], 10**6).min(1), comp)
    border = np.where((d <= 0.5) & core[None], comp[None], 10**6).min(1)
    want = [None if v == 10**6 else int(v) for v in np.where(core, comp, border)]
    got = dict(rows(spatial.dbscan(df, "point_id", ["scene"], 0.5, 4).na.fill(-1)))
    assert [None if got[i] == -1 else got[i] for i in range(150)] == want


def test_columns_relabel_and_faces(spark):
    df = spark.createDataFrame([(1, "s", 2, 0.1, 0.1), (2, "s", 1, 0.2, 0.2), (3, "s", 0, 0.2, 0.2)], "point_id bigint, scene string, inst int, x double, y double")
    assert rows(spatial.column_owner(df, ["scene"], "inst", 1.0)) == [("s", 0, 0, 1)]
    assert rows(spatial.relabel(df, "inst", 2, ["scene"]).select("point_id", "new_label")) == [(1, 0), (2, 0), (3, 0)]
    vox = spark.createDataFrame([("s", 0, 0, 0), ("s", 1, 0, 0)], "scene string, i int, j int, k int")
    assert voxels.exposed_faces(vox, ["scene"]).count() == 10 and voxels.erode(vox, ["scene"]).count() == 0


def test_composite_rules(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0, 1.0), (2, 2.0, 0.001, 1.0), (3, 3.0, 0.99, 1.0), (4, 4.0, 0.5, 1.0)], "id int, z double, a double, c double")
    r = df.agg(voxels.composite(F.col("a"), F.col("c"), F.col("z")).alias("s")).first().s
    # the first is capped at 0.99, the second skipped, the third would leave 1e-4 (not below), the fourth would go under it
    assert r.colour == pytest.approx(0.99 + 0.01 * 0.99, abs=1e-3) and r.left == pytest.approx(1e-4, rel=0.2)


def test_confusion_and_tracks(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (0, 2), (None, 1)], "t int, g int")
    assert rows(tracks.confusion(df, "t", "g").select("cls", "hit", "union_n")) == [(1, 1, 2), (2, 1, 2)]
    sp = spark.sql("select cast(1 as bigint) point3d_id, array(named_struct('image_id', 4, 'point2d_idx', 0), named_struct('image_id', 4, 'point2d_idx', 1)) track union all select 2, null")
    assert rows(tracks.edges(sp)) == [(1, 4), (1, 4)]


def test_ply_round_trip(spark, tmp_path):
    df = spark.range(10).select((F.col("id") / 2).cast("float").alias("x"), F.col("id").cast("short").alias("red"), F.lit(0.5).cast("float").alias("ins_feat_10"), F.lit(0.25).cast("float").alias("ins_feat_2"))
    assert ply.write_ply(df, str(tmp_path), [("x", "float"), ("red", "uchar"), ("ins_feat_10", "float"), ("ins_feat_2", "float")]).agg(F.sum("n")).first()[0] == 10
    back = ply.gather(ply.read_ply(spark, str(tmp_path)))
    assert rows(back.select("x", "red")) == [(i / 2, i) for i in range(10)]
    assert back.first().ins_feat == [0.25, 0.5] and back.first().f_rest == []


def test_colmap_binary_and_text(spark, tmp_path):
    (tmp_path / "cameras.bin").write_bytes(struct.pack("<Q", 2) + struct.pack("<iiQQ4d", 1, 1, 640, 480, 1, 2, 3, 4) + struct.pack("<iiQQ3d", 2, 0, 10, 20, 5, 6, 7))
    assert rows(colmap.read_cameras(spark, str(tmp_path / "cameras.bin")).select("camera_id", "model", F.size("params"))) == [(1, "PINHOLE", 4), (2, "SIMPLE_PINHOLE", 3)]
    img = struct.pack("<Q", 1) + struct.pack("<i7di", 9, 1, 0, 0, 0, 1, 2, 3, 1) + b"a.jpg\0" + struct.pack("<Q", 1) + struct.pack("<ddq", 1.5, 2.5, -1)
    (tmp_path / "images.bin").write_bytes(img)
    full = colmap.read_images(spark, str(tmp_path / "images.bin")).first()
    assert (full.image_id, full.name, full.points2d[0].point3d_id) == (9, "a.jpg", -1)
    assert "points2d" not in colmap.read_images(spark, str(tmp_path / "images.bin"), points=False).columns
    (tmp_path / "points3D.bin").write_bytes(struct.pack("<Q", 1) + struct.pack("<QdddBBBd", 3, 1, 2, 3, 4, 5, 255, 0.5) + struct.pack("<Q", 2) + struct.pack("<4i", 9, 0, 9, 1))
    p = colmap.read_points3d(spark, str(tmp_path / "points3D.bin")).first()
    assert (p.point3d_id, p.b, len(p.track)) == (3, 255, 2)
    two = img[8:] + img[8:].replace(b"a.jpg", b"b.jpg")
    (tmp_path / "images.bin").write_bytes(struct.pack("<Q", 2) + two)
    kept = colmap.read_images(spark, str(tmp_path / "images.bin"), keep=lambda image_id, name: name == "b.jpg").collect()
    assert [(r.name, len(r.points2d)) for r in kept] == [("b.jpg", 1)]
    assert colmap.read_points3d(spark, str(tmp_path / "points3D.bin"), keep=lambda x, y, z: x > 1).count() == 0
    (tmp_path / "cameras.txt").write_text("# c\n1 PINHOLE 640 480 1 2 3 4\nshort 1\n")
    assert rows(colmap.read_cameras_text(spark, str(tmp_path / "cameras.txt")).select("camera_id", "width")) == [(1, 640)]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_stream_and_batch_votes_agree(spark, tmp_path):
    from cloudloom.streaming.votes import running_votes

    data = spark.createDataFrame([(1, 7, 3), (1, 7, 2), (2, 5, 1), (None, 5, 1)], "cluster int, mask_id int, view_idx int")
    for k in range(2):
        data.write.mode("append").parquet(str(tmp_path / "in"))
    stream = running_votes(spark.readStream.schema(data.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("votes_so_far").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert rows(spark.table("votes_so_far")) == rows(running_votes(spark.read.parquet(str(tmp_path / "in")))) == [(1, 7, 4, 2), (2, 5, 2, 1)]


def test_fusion_depends_on_order_and_graph_does_not(spark):
    from cloudloom.operators import instances

    a, b, c = range(0, 10), range(5, 15), range(10, 20)
    masks = [("s", v, 1, p) for v, m in enumerate((a, b, c)) for p in m]
    df = spark.createDataFrame(masks, "scene string, view_idx int, mask_id int, point_id bigint")
    got = instances.fuse(df, "scene", 3, 0.3)
    assert got.select("instance").distinct().count() == 2  # the third mask no longer overlaps the grown set enough
    assert instances.fuse_by_graph(df, "scene", 3, 0.3).select("instance").distinct().count() == 1
    best = dict((r.point_id, r.instance) for r in instances.best_instance(got, ["scene"], 2).collect())
    assert best[0] == 0 and best[7] == 1
    assert instances.fuse(df.limit(0), "scene", 3, 0.3).count() == 0
    assert rows(instances.unpack(instances.pack(spark.range(3), "id", 4)).select("digits", "code")) == [("0000", 0), ("0001", 1), ("0010", 2)]


def test_fusion_by_rounds_equals_the_fold_mask_by_mask(spark):
    import random

    from cloudloom.operators import instances

    r = random.Random(5)
    data = []
    for g in ("a", None):
        for v in range(9):
            for k in range(4):
                c = r.randrange(40)
                data += [(g, v, k, c + r.randrange(12)) for _ in range(r.randrange(20))]
    masks: dict = {}
    for g, v, k, p in data:
        masks.setdefault((g or "", v, k), set()).add(p)
    sets: dict = {"a": [], "": []}
    for (g, _, _), pts in sorted(masks.items()):
        if len(pts) < 3:
            continue
        iou = [len(pts & set(s)) / len(pts | set(s)) for s in sets[g]]
        at = max(range(len(iou)), key=lambda i: (iou[i], -i), default=-1)
        if at < 0 or iou[at] < 0.2:
            sets[g].append({})
            at = len(sets[g]) - 1
        for p in pts:
            sets[g][at][p] = sets[g][at].get(p, 0) + 1
    want = sorted((g, i + 1, p, v) for g in sets for i, s in enumerate(sets[g]) for p, v in s.items())
    df = spark.createDataFrame(data, "scene string, view_idx int, mask_id int, point_id bigint")
    got = instances.fuse(df, "scene", 3, 0.2).select("scene", "instance", "point_id", "votes").collect()
    assert sorted((r[0] or "", *r[1:]) for r in got) == want


def test_scene_functions(spark):
    from cloudloom.operators import scene

    k = spark.createDataFrame([("PINHOLE", [1.0, 2.0, 3.0, 4.0]), ("SIMPLE_RADIAL", [1.0, 3.0, 4.0, 0.1]), ("ODD", [1.0]), ("PINHOLE", None)], "model string, params array<double>")
    assert [tuple(r) for r in k.select(*scene.intrinsics(F.col("model"), F.col("params"))).collect()] == [(1, 2, 3, 4), (1, 1, 3, 4), (None,) * 4, (None,) * 4]
    p = spark.createDataFrame([(0, 0, 3, 0.5), (0, 0, 2, 0.5), (0, 1, 9, 0.1)], "u int, v int, label int, score double")
    assert rows(scene.paint(p, ["u", "v"], "label", "score")) == [(0, 0, 2), (0, 1, 9)]
    r = spark.range(1).select(scene.learning_rate(F.lit(5), 1.0, 0.01, 10).alias("m"), scene.learning_rate(F.lit(99), 1.0, 0.01, 10).alias("e")).first()
    assert r.m == pytest.approx(0.1) and r.e == pytest.approx(0.01)


def test_text_images_and_transforms(spark, tmp_path):
    import json

    from cloudloom.sources.transforms import read_transforms

    (tmp_path / "images.txt").write_text("# c\n1 1 0 0 0 1 2 3 7 a b.jpg\n1.5 2.5 -1 3 4 9\n2 1 0 0 0 1 2 3 7 c.jpg\n\n3 1 0 0 0 1 2 3 7 d.jpg\n")
    got = {r.image_id: r for r in colmap.read_images_text(spark, str(tmp_path / "images.txt")).collect()}
    assert got[1].name == "a b.jpg" and [p.point3d_id for p in got[1].points2d] == [-1, 9] and got[2].points2d == [] and got[3].name == "d.jpg"
    c2w = [[0, -1, 0, 1], [1, 0, 0, 2], [0, 0, 1, 3], [0, 0, 0, 1]]
    (tmp_path / "t.json").write_text(json.dumps({"w": 100, "h": 50, "camera_angle_x": 1.0, "frames": [{"file_path": "a", "transform_matrix": c2w, "fl_x": 9}, {"file_path": "b", "transform_matrix": c2w}, {"file_path": "c"}]}))
    v = {r.name: r for r in read_transforms(spark, str(tmp_path / "t.json")).collect()}
    flip = np.array(c2w, float) @ np.diag([1, -1, -1, 1])
    assert np.allclose(np.array(v["a"].w2c).reshape(4, 4), np.linalg.inv(flip)) and set(v) == {"a", "b"}
    assert v["a"].fx == 9 and v["b"].fx == pytest.approx(50 / np.tan(0.5)) and v["b"].cx == 50


def test_training_transforms(spark, tmp_path):
    import json

    from cloudloom.sources.transforms import read_training_transforms

    c2w = [[0, -1, 0, 1], [1, 0, 0, 2], [0, 0, 2, 3], [0, 0, 0, 1]]
    k = [[30, 0, 11], [0, 30, 12], [0, 0, 1]]
    frames = [{"file_path": n, "transform_matrix": c2w} for n in ("d/a", "d/gone", "d/b", "c")]
    frames[2] |= {"K": k, "fl_x": 40}
    (tmp_path / "t.json").write_text(json.dumps({"fl_x": 20, "frames": frames}))
    sizes = spark.createDataFrame([("d/a.png", 100, 50), ("d/b.jpg", 60, 40), ("c.png", 10, 10)], "image string, width int, height int")
    got = {r.name: r for r in read_training_transforms(spark, str(tmp_path / "t.json"), sizes).collect()}
    assert {n: (r.view_idx, r.image, r.cx, r.cy) for n, r in got.items()} == {"a": (0, "d/a.png", 50, 25), "b": (2, "d/b.jpg", 11, 12), "c": (3, "c.png", 11, 12)}
    assert got["a"].fov_x == pytest.approx(2 * np.arctan(100 / 40)) and got["b"].fov_y == pytest.approx(2 * np.arctan(40 / 80))
    w2c = np.linalg.inv(np.array(c2w, float) @ np.diag([1, -1, -1, 1]))
    assert np.allclose(np.array(got["c"].R).reshape(3, 3), w2c[:3, :3].T) and np.allclose(got["c"].T, w2c[:3, 3])
    (tmp_path / "t.json").write_text(json.dumps({"camera_angle_x": 1.0, "w": 8, "h": 6, "frames": frames[:1]}))
    one = read_training_transforms(spark, str(tmp_path / "t.json"), sizes).first()
    assert (one.fov_y, one.cx, one.cy) == (1.0, 4, 3) and one.fov_x == pytest.approx(2 * np.arctan(50 * np.tan(0.5) / 100))


def test_eps_by_quantile(spark):
    far = [("s", i, float(i * i), 0.0, 0.0) for i in range(9)]
    df = spark.createDataFrame([*far, ("one", 100, 0.0, 0.0, 0.0), *[("same", 200 + i, 1.0, 1.0, 1.0) for i in range(3)]], "scene string, id bigint, x double, y double, z double")
    got = dict((r.scene, r.eps) for r in spatial.neighbour_eps(df, "id", ["scene"], 2, 0.3, 0.5).collect())
    x = [i * i for i in range(9)]
    want = np.quantile([sorted(abs(a - b) for b in x if a != b)[1] for a in x], 0.3)
    assert got == {"s": pytest.approx(want), "one": 1e-4, "same": 1e-4}
    assert spatial.neighbour_eps(df.limit(0), "id", ["scene"], 2, 0.3, 0.5).count() == 0
