"""Scenes in and out: views of sparse models, pose and shape files, label lists, scene kinds; folders per class, sparse models, reports, meshes.

Defined results: images of unknown cameras or camera models give no view; files that don't parse give no rows; entries without the
needed keys are passed over; writers replace nothing (they fail where the folder exists) and give what they wrote.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import rotation
from ..operators.scene import intrinsics
from .colmap import MODELS


def views_of(images: DataFrame, cameras: DataFrame) -> DataFrame:
    """Views of a sparse model's images: image_id, name, w2c (16), fx, fy, cx, cy, width, height. Of repeated rows the first loaded."""
    i = images.where(F.col("image_id").isNotNull() & F.col("tvec").isNotNull() & F.col("qvec").isNotNull())
    i = i.groupBy("image_id").agg(F.min(F.struct("loaded_at", "qvec", "tvec", "camera_id", "name")).alias("i")).select("image_id", "i.*")
    k = cameras.select("camera_id", "loaded_at", "width", "height", *[e.alias(n) for e, n in zip(intrinsics(F.col("model"), F.col("params")), ("fx", "fy", "cx", "cy"))])
    k = k.where("fx is not null").groupBy("camera_id").agg(F.min(F.struct("loaded_at", "width", "height", "fx", "fy", "cx", "cy")).alias("c")).select("camera_id", "c.width", "c.height", "c.fx", "c.fy", "c.cx", "c.cy")
    q, t = F.col("qvec"), F.col("tvec")
    r = rotation(q[0], q[1], q[2], q[3])
    w2c = F.array(*[c for row in range(3) for c in (*r[3 * row : 3 * row + 3], t[row])], *[F.lit(float(x)) for x in (0, 0, 0, 1)])
    return i.join(k, "camera_id").withColumn("w2c", w2c).where(F.col("w2c")[0].isNotNull()).select("image_id", "name", "w2c", "fx", "fy", "cx", "cy", F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"))


POSES = "poses array<struct<name:string, w2c:array<array<double>>, fx:double, fy:double, cx:double, cy:double, width:int, height:int, ortho:array<double>>>"


def read_poses(spark: SparkSession, path: str) -> DataFrame:
    """Views of pose files ({"poses": [{name, w2c, fx, .., ortho}]}): path, view_idx, name, w2c (16), intrinsics, projection_mode, bounds."""
    raw = spark.read.schema(POSES).option("multiLine", True).json(path).select(F.input_file_name().alias("path"), F.posexplode("poses").alias("view_idx", "p"))
    ok = raw.where((F.size("p.w2c") >= 3) & F.forall("p.w2c", lambda r: F.size(r) == 4))
    flat = F.concat(F.flatten(F.slice("p.w2c", 1, 3)), F.array(*[F.lit(float(x)) for x in (0, 0, 0, 1)]))
    bound = lambda k: F.get(F.col("p.ortho"), F.lit(k))
    return ok.select(
        "path", "view_idx", "p.name", flat.alias("w2c"), *[F.col(f"p.{c}") for c in ("fx", "fy", "cx", "cy", "width", "height")],
        F.when(F.size("p.ortho") == 4, "orthographic").otherwise("perspective").alias("projection_mode"),
        bound(0).alias("ortho_x_min"), bound(1).alias("ortho_x_max"), bound(2).alias("ortho_y_min"), bound(3).alias("ortho_y_max"),
    )


SHAPES = "imageHeight int, imageWidth int, shapes array<struct<label:string, shape_type:string, points:array<array<double>>>>"


def read_shapes(spark: SparkSession, path: str) -> DataFrame:
    """Shapes of annotation files: path, width, height, shape_no, label, kind, points; ready for ``rasters.draw_shapes``."""
    raw = spark.read.schema(SHAPES).option("multiLine", True).json(path).withColumn("path", F.input_file_name())
    return raw.select("path", F.col("imageWidth").alias("width"), F.col("imageHeight").alias("height"), F.posexplode("shapes").alias("shape_no", "s")).select("path", "width", "height", "shape_no", "s.label", F.col("s.shape_type").alias("kind"), "s.points")


def read_matrix_text(spark: SparkSession, path: str) -> DataFrame:
    """Matrices of whitespace-parted text files, one a file: path, m ARRAY<DOUBLE> in row order; files with a word that is no number drop."""
    raw = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    words = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    m = F.transform(words, lambda x: x.try_cast("double"))
    return raw.select("path", m.alias("m")).where(~F.exists("m", lambda x: x.isNull()))


def transforms_json(poses: DataFrame, by: list[str], width: int, height: int, fx: float, fy: float, cx: float, cy: float) -> DataFrame:
    """One transforms document per group of poses (by, name, m: camera-to-world, 16 numbers): by, json. The second and third axes are
    flipped; poses that aren't finite are left out."""
    m = F.col("m")
    row = lambda i: F.array(*[m[4 * i + j] * (-1.0 if j in (1, 2) else 1.0) for j in range(4)])
    ok = poses.where((F.size("m") == 16) & F.forall("m", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    frames = ok.select(*by, F.struct(F.col("name").alias("file_path"), F.array(*[row(i) for i in range(4)]).alias("transform_matrix")).alias("f")).groupBy(*by).agg(F.sort_array(F.collect_list("f")).alias("frames"))
    numbers = {"w": width, "h": height, "fl_x": fx, "fl_y": fy, "cx": cx, "cy": cy}
    return frames.select(*by, F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in numbers.items()], "frames")).alias("json"))


def class_folders(paths: DataFrame) -> DataFrame:
    """Classes of a listing (path) of files in folders named ``<id>`` or ``<id>_<label>``: semantic_id, label, path; of a folder's
    files the first by name."""
    folder = F.element_at(F.split("path", "/"), -2)
    found = paths.withColumn("_id", F.regexp_extract(folder, r"^(\d+)(?:_(.*))?$", 1)).withColumn("label", F.regexp_extract(folder, r"^(\d+)(?:_(.*))?$", 2)).where("_id <> ''")
    return found.groupBy(F.col("_id").cast("int").alias("semantic_id"), "label").agg(F.min("path").alias("path"))


def scene_kinds(paths: DataFrame) -> DataFrame:
    """Kind of each scene of a listing (scene, path): colmap if it has a ``sparse`` folder, else blender if it has transforms_train.json,
    else unknown."""
    kind = F.when(F.max(F.col("path").rlike(r"(^|/)sparse/")), "colmap").when(F.max(F.col("path").rlike(r"(^|/)transforms_train\.json$")), "blender").otherwise("unknown")
    return paths.groupBy("scene").agg(kind.alias("kind"))


def label_names(candidates: list[DataFrame], ids: DataFrame | None = None) -> DataFrame:
    """Class names (id, label) of the first candidate table that has rows; else of the ids that occur (id), named by their number."""
    for c in candidates:
        if not c.isEmpty():
            return c.select("id", "label").distinct()
    return ids.select("id", F.concat(F.lit("class_"), F.col("id").cast("string")).alias("label")).distinct()


def random_cloud(spark: SparkSession, n: int = 100_000, half: float = 1.3, seed: int = 42) -> DataFrame:
    """A cloud to start from: n points uniform in a cube, with random colours: point_id, x, y, z, red, green, blue."""
    at = lambda k: (F.rand(seed + k) * 2 - 1) * half
    return spark.range(n).select(F.col("id").alias("point_id"), *[at(k).alias(a) for k, a in enumerate("xyz")], *[F.floor(F.rand(seed + 3 + k) * 256).cast("smallint").alias(c) for k, c in enumerate(("red", "green", "blue"))])


def basic_cloud(df: DataFrame) -> DataFrame:
    """Points with colours and normals; missing colours are mid grey, missing normals zero."""
    has = lambda c: F.col(c) if c in df.columns else F.lit(None)
    colours = [F.coalesce(has(c).cast("double") / 255.0, F.lit(0.5)) for c in ("red", "green", "blue")]
    normals = [F.coalesce(has(c).cast("double"), F.lit(0.0)) for c in ("nx", "ny", "nz")]
    return df.select(F.array(*[F.col(a).cast("double") for a in "xyz"]).alias("points"), F.array(*colours).alias("colors"), F.array(*normals).alias("normals"))


def write_by(df: DataFrame, path: str, by: list[str]) -> None:
    """One folder per class or instance below ``path``."""
    df.write.partitionBy(*by).parquet(path)


def write_reports(df: DataFrame, path: str, key: str, json: str) -> None:
    """One folder per key below ``path`` with its JSON document as text lines."""
    df.select(key, F.col(json).alias("value")).write.partitionBy(key).text(path)


def camera_records(cameras: DataFrame) -> DataFrame:
    """Binary records of cameras in the sparse model's layout: id, record. Unknown models raise."""
    number = {name: (i, k) for i, (name, k) in MODELS.items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples():
                i, k = number[r.model]
                out.append(struct.pack(f"<iiQQ{k}d", r.camera_id, i, r.width, r.height, *list(r.params)[:k]))
            yield pd.DataFrame({"id": b["camera_id"].astype("int64"), "record": out})

    return cameras.where("params is not null").select("camera_id", "model", "width", "height", "params").mapInPandas(run, "id bigint, record binary")


def image_records(images: DataFrame) -> DataFrame:
    """Binary records of images: id, record. A missing name is empty, missing 2-D points are none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples():
                pts = [] if r.points2d is None else [(p["x"], p["y"], p["point3d_id"]) for p in r.points2d]
                out.append(struct.pack("<i7di", r.image_id, *r.qvec, *r.tvec, r.camera_id) + (r.name or "").encode("utf-8") + b"\0" + struct.pack("<Q", len(pts)) + b"".join(struct.pack("<ddq", *p) for p in pts))
            yield pd.DataFrame({"id": b["image_id"].astype("int64"), "record": out})

    ok = images.where("qvec is not null and tvec is not null and camera_id is not null").select("image_id", "qvec", "tvec", "camera_id", "name", "points2d")
    return ok.mapInPandas(run, "id bigint, record binary")


def point_records(points: DataFrame) -> DataFrame:
    """Binary records of sparse points: id, record. A missing error is -1, a missing track empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples():
                track = [] if r.track is None else [(o["image_id"], o["point2d_idx"]) for o in r.track]
                out.append(struct.pack("<QdddBBBd", r.point3d_id, r.x, r.y, r.z, r.r, r.g, r.b, r.error) + struct.pack("<Q", len(track)) + b"".join(struct.pack("<ii", *o) for o in track))
            yield pd.DataFrame({"id": b["point3d_id"], "record": out})

    ok = points.where("x is not null and y is not null and z is not null").select("point3d_id", "x", "y", "z", "r", "g", "b", F.coalesce("error", F.lit(-1.0)).alias("error"), "track")
    return ok.na.fill(0, ["r", "g", "b"]).mapInPandas(run, "id bigint, record binary")


def write_model(records: DataFrame, path: str) -> int:
    """One binary file of records in the order of their ids: the format is one file with its count in front, so the records, made in
    parallel, pass through the driver one partition at a time. Gives the number written. ``path`` is on the driver's file system."""
    n = records.count()
    with open(path, "wb") as f:
        f.write(struct.pack("<Q", n))
        for r in records.orderBy("id").toLocalIterator(prefetchPartitions=True):
            f.write(bytes(r["record"]))
    return n


def mesh_ply(vertices: DataFrame, triangles: DataFrame, path: str) -> None:
    """A mesh as an ASCII PLY of vertices (vertex, x, y, z) and triangles (face, half, a, b, c), written in order, partition by partition."""
    nv, nt = vertices.count(), triangles.count()
    with open(path, "w", encoding="ascii") as f:
        f.write(f"ply\nformat ascii 1.0\nelement vertex {nv}\nproperty float x\nproperty float y\nproperty float z\nelement face {nt}\nproperty list uchar int vertex_indices\nend_header\n")
        for r in vertices.orderBy("vertex").select("x", "y", "z").toLocalIterator(prefetchPartitions=True):
            f.write(f"{r.x} {r.y} {r.z}\n")
        for r in triangles.orderBy("face", "half").select("a", "b", "c").toLocalIterator(prefetchPartitions=True):
            f.write(f"3 {r.a} {r.b} {r.c}\n")
