"""Camera poses from transforms JSON: global intrinsics, overridden by a frame's own; world-to-view matrices in row order.

Defined results: without focal length and opening angle fx and fy are null; fy defaults to fx; the centre defaults to the middle of the
image; frames without a 4 x 4 matrix are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NUMBERS = "w double, h double, fl_x double, fl_y double, cx double, cy double"
SCHEMA = f"{NUMBERS}, camera_angle_x double, frames array<struct<file_path:string, transform_matrix:array<array<double>>, K:array<array<double>>, {NUMBERS.replace(' double', ':double')}>>"

SQUARE = "size(f.transform_matrix) = 4 and forall(f.transform_matrix, r -> size(r) = 4)"


def read_transforms(spark: SparkSession, path: str) -> DataFrame:
    """path, view_idx (place in the file), name, w2c (16), fx, fy, cx, cy, width, height."""
    raw = spark.read.schema(SCHEMA).option("multiLine", True).json(path).withColumn("path", F.input_file_name())
    f = raw.select("*", F.posexplode("frames").alias("view_idx", "f"))
    both = lambda n: F.coalesce(F.col(f"f.{n}"), F.col(n))
    m = lambda i, j: F.get(F.get(F.col("f.transform_matrix"), F.lit(i)), F.lit(j))
    # the pose's second and third axes are flipped; a rigid pose is inverted by its transpose
    sign = (1.0, -1.0, -1.0)
    rows = []
    for j in range(3):
        rows += [sign[j] * m(i, j) for i in range(3)]
        rows.append(-(sum(sign[j] * m(i, j) * m(i, 3) for i in range(3))))
    w2c = F.array(*rows, F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))
    w, h = both("w"), both("h")
    fx = F.coalesce(both("fl_x"), w / (2.0 * F.tan(F.col("camera_angle_x") / 2.0)))
    return f.where(SQUARE).select(
        "path", "view_idx", F.col("f.file_path").alias("name"), w2c.alias("w2c"), fx.alias("fx"), F.coalesce(both("fl_y"), fx).alias("fy"),
        F.coalesce(both("cx"), w / 2).alias("cx"), F.coalesce(both("cy"), h / 2).alias("cy"), w.cast("int").alias("width"), h.cast("int").alias("height"),
    )


def read_training_transforms(spark: SparkSession, path: str, sizes: DataFrame, extension: str = ".png") -> DataFrame:
    """Cameras as a trainer takes them from transforms JSON: path, view_idx, name (stem), image, R (9, the transpose of the view's
    rotation), T (3), fov_x, fov_y, cx, cy, width, height. ``sizes`` (image, width, height) lists the images that there are.

    A frame's image is its path with the extension, else the same with .png for .jpg or the other way round; frames without either are
    left out. A frame's own K sets the centre for itself and the frames behind it, before the file's centre, the half of the file's
    size and the half of the first image's. Focal lengths: the frame's fl_x, the file's, the frame's K, the last frame's. With an
    opening angle given, it is fov_y, and fov_x is the angle over the height for the same focal length: the two are exchanged.
    """
    raw = spark.read.schema(SCHEMA).option("multiLine", True).json(path).withColumn("path", F.input_file_name())
    f = raw.select("*", F.posexplode("frames").alias("view_idx", "f")).where(SQUARE).withColumn("first_name", F.concat("f.file_path", F.lit(extension)))
    kind, stem = F.lower(F.regexp_extract("first_name", r"(\.[^./]*)$", 1)), F.regexp_replace("first_name", r"\.[^./]*$", "")
    f = f.withColumn("second_name", F.when(kind == ".jpg", F.concat(stem, F.lit(".png"))).when(kind == ".png", F.concat(stem, F.lit(".jpg"))))
    one = sizes.groupBy("image").agg(F.max(F.struct("width", "height")).alias("size"))
    for n in ("first", "second"):
        f = f.join(one.select(F.col("image").alias(f"{n}_name"), F.col("size").alias(f"{n}_size")), f"{n}_name", "left")
    f = f.withColumn("size", F.coalesce("first_size", "second_size")).where("size is not null")
    f = f.withColumn("image", F.when(F.col("first_size").isNotNull(), F.col("first_name")).otherwise(F.col("second_name")))
    # the frames of one file, which was one record before
    so_far = Window.partitionBy("path").orderBy("view_idx").rowsBetween(Window.unboundedPreceding, 0)
    cell = lambda c, i, j: F.get(F.get(F.col(c), F.lit(i)), F.lit(j))
    width, height = F.col("size.width"), F.col("size.height")

    def centre(name: str, row: int, whole: str, side: Column) -> Column:
        given = F.when(F.col("cx").isNotNull(), F.col(name)).otherwise(F.col(whole) / 2)
        return F.coalesce(F.last(cell("f.K", row, 2), ignorenulls=True).over(so_far), given, F.first(side / 2).over(so_far))

    focal = F.last(F.coalesce("f.fl_x", "fl_x", cell("f.K", 0, 0)), ignorenulls=True).over(so_far)
    angle = lambda length, side: 2 * F.atan(side / (2 * length))
    given = F.col("camera_angle_x")
    a = lambda i, j: cell("f.transform_matrix", i, j) * (1.0 if j in (0, 3) else -1.0)
    cofactor = lambda i, j: a((i + 1) % 3, (j + 1) % 3) * a((i + 2) % 3, (j + 2) % 3) - a((i + 1) % 3, (j + 2) % 3) * a((i + 2) % 3, (j + 1) % 3)
    det = sum(a(0, j) * cofactor(0, j) for j in range(3))
    # the transpose of the inverse is the matrix of cofactors over the determinant
    turned = [F.try_divide(cofactor(i, j), det) for i in range(3) for j in range(3)]
    moved = [-sum(turned[3 * i + j] * a(i, 3) for i in range(3)) for j in range(3)]
    return f.select(
        "path", "view_idx", F.regexp_replace(F.regexp_extract("first_name", r"([^/]*)$", 1), r"\.[^.]*$", "").alias("name"), "image",
        F.array(*turned).alias("R"), F.array(*moved).alias("T"),
        F.when(given.isNull(), angle(focal, width)).otherwise(angle(width / (2 * F.tan(given / 2)), height)).alias("fov_x"),
        F.when(given.isNull(), angle(focal, height)).otherwise(given).alias("fov_y"),
        centre("cx", 0, "w", width).alias("cx"), centre("cy", 1, "h", height).alias("cy"), width.alias("width"), height.alias("height"),
    )
