"""Sparse models in COLMAP's binary and text layouts. Records have variable length, so a file is one split; many files read in parallel.

Binary files with an unknown camera model raise, as does a text camera that isn't PINHOLE where ``strict`` is set; blank and comment lines of text files are passed over, and short lines dropped.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Camera models by number, with their count of parameters.
MODELS = {
    0: ("SIMPLE_PINHOLE", 3), 1: ("PINHOLE", 4), 2: ("SIMPLE_RADIAL", 4), 3: ("RADIAL", 5), 4: ("OPENCV", 8), 5: ("OPENCV_FISHEYE", 8),
    6: ("FULL_OPENCV", 12), 7: ("FOV", 5), 8: ("SIMPLE_RADIAL_FISHEYE", 4), 9: ("RADIAL_FISHEYE", 5), 10: ("THIN_PRISM_FISHEYE", 12),
}


def _scan(spark: SparkSession, path: str, parse, schema: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"]):
                rows = list(parse(memoryview(content)))
                if rows:
                    frame = pd.DataFrame(rows)
                    frame.insert(0, "path", name)
                    yield frame

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, f"path string, {schema}")


def _cameras(m):
    (n,), at = struct.unpack_from("<Q", m), 8
    for _ in range(n):
        cid, model, w, h = struct.unpack_from("<iiQQ", m, at)
        if model not in MODELS:  # its number of parameters is unknown, so the records behind it can't be read
            raise ValueError(f"camera {cid}: unknown camera model {model}")
        name, k = MODELS[model]
        params = list(struct.unpack_from(f"<{k}d", m, at + 24))
        at += 24 + 8 * k
        yield {"camera_id": cid, "model": name, "width": w, "height": h, "params": params}


def read_cameras(spark: SparkSession, path: str) -> DataFrame:
    return _scan(spark, path, _cameras, "camera_id int, model string, width bigint, height bigint, params array<double>")


def _images(points: bool, keep: Callable[[int, str], bool] | None):
    def parse(m):
        (n,), at = struct.unpack_from("<Q", m), 8
        for _ in range(n):
            v = struct.unpack_from("<i7di", m, at)
            at += 64
            end = at
            while m[end] != 0:
                end += 1
            name = bytes(m[at:end]).decode("utf-8", "replace")
            (k,) = struct.unpack_from("<Q", m, end + 1)
            at = end + 9
            if keep is not None and not keep(v[0], name):
                at += 24 * k
                continue
            row = {"image_id": v[0], "qvec": list(v[1:5]), "tvec": list(v[5:8]), "camera_id": v[8], "name": name}
            if points:
                row["points2d"] = [dict(zip(("x", "y", "point3d_id"), p)) for p in struct.iter_unpack("<ddq", m[at : at + 24 * k])]
            at += 24 * k
            yield row

    return parse


def read_images(spark: SparkSession, path: str, points: bool = True, keep: Callable[[int, str], bool] | None = None) -> DataFrame:
    """``points=False`` steps over the 2-D points, which are most of the file; so does ``keep(image_id, name)`` for the records that it
    turns down, which are no rows."""
    more = ", points2d array<struct<x:double,y:double,point3d_id:bigint>>" if points else ""
    return _scan(spark, path, _images(points, keep), "image_id int, qvec array<double>, tvec array<double>, camera_id int, name string" + more)


def _points3d(keep: Callable[[float, float, float], bool] | None):
    def parse(m):
        (n,), at = struct.unpack_from("<Q", m), 8
        for _ in range(n):
            pid, x, y, z, r, g, b, error = struct.unpack_from("<QdddBBBd", m, at)
            (k,) = struct.unpack_from("<Q", m, at + 43)
            start, at = at + 51, at + 51 + 8 * k
            if keep is None or keep(x, y, z):
                track = [dict(zip(("image_id", "point2d_idx"), p)) for p in struct.iter_unpack("<ii", m[start:at])]
                yield {"point3d_id": pid, "x": x, "y": y, "z": z, "r": r, "g": g, "b": b, "error": error, "track": track}

    return parse


def read_points3d(spark: SparkSession, path: str, keep: Callable[[float, float, float], bool] | None = None) -> DataFrame:
    """``keep(x, y, z)``, such as a test of tiles, steps over the tracks of the points that it turns down, which are no rows."""
    schema = "point3d_id bigint, x double, y double, z double, r smallint, g smallint, b smallint, error double, track array<struct<image_id:int,point2d_idx:int>>"
    return _scan(spark, path, _points3d(keep), schema)


def read_cameras_text(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    w = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(~F.col("value").startswith("#")).select(w.alias("w")).where(F.size("w") >= 5)
    model = F.col("w")[1]
    if strict:
        model = F.when(model == "PINHOLE", model).otherwise(F.raise_error(F.concat(F.lit("camera model "), model)))
    return rows.select(
        F.col("w")[0].try_cast("int").alias("camera_id"), model.alias("model"), F.col("w")[2].try_cast("bigint").alias("width"),
        F.col("w")[3].try_cast("bigint").alias("height"), F.transform(F.slice("w", 5, 100), lambda x: x.try_cast("double")).alias("params"),
    )


def read_points3d_text(spark: SparkSession, path: str) -> DataFrame:
    w = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(~F.col("value").startswith("#")).select(w.alias("w")).where(F.size("w") >= 8)
    pair = lambda i: F.struct(F.element_at("w", 9 + 2 * i).try_cast("int").alias("image_id"), F.element_at("w", 10 + 2 * i).try_cast("int").alias("point2d_idx"))
    n = F.floor((F.size("w") - 8) / 2).cast("int")
    track = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), pair)).otherwise(F.array().cast("array<struct<image_id:int,point2d_idx:int>>"))
    return rows.select(F.col("w")[0].try_cast("bigint").alias("point3d_id"), *[F.col("w")[i + 1].try_cast("double").alias(a) for i, a in enumerate("xyz")], *[F.col("w")[i + 4].try_cast("smallint").alias(c) for i, c in enumerate("rgb")], F.col("w")[7].try_cast("double").alias("error"), track.alias("track"))


def keep_list(spark: SparkSession, path: str) -> DataFrame:
    """Names of a keep-list; comments and blank lines are passed over."""
    line = F.trim(F.regexp_replace("value", r"#.*$", ""))
    return spark.read.text(path).select(line.alias("name")).where(F.length("name") > 0).distinct()


def read_images_text(spark: SparkSession, path: str) -> DataFrame:
    """Two lines a record: pose and name, then 2-D points; the second may be blank. A record that doesn't parse is passed over."""

    def parse(m):
        lines = [x for x in bytes(m).decode("utf-8", "replace").split("\n") if not x.startswith("#")]
        at = 0
        while at < len(lines):
            w = lines[at].split()
            if len(w) < 10:
                at += 1
                continue
            p = lines[at + 1].split() if at + 1 < len(lines) else []
            points = [{"x": float(a), "y": float(b), "point3d_id": int(c)} for a, b, c in zip(p[::3], p[1::3], p[2::3])]
            yield {"image_id": int(w[0]), "qvec": [float(x) for x in w[1:5]], "tvec": [float(x) for x in w[5:8]], "camera_id": int(w[8]), "name": " ".join(w[9:]), "points2d": points}
            at += 2

    return _scan(spark, path, parse, "image_id int, qvec array<double>, tvec array<double>, camera_id int, name string, points2d array<struct<x:double,y:double,point3d_id:bigint>>")
