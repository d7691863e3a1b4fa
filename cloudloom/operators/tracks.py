"""Sparse models: images, cameras, tracks; tiles; label and mask statistics; evaluation.

Defined results: null references and -1 name nothing; an image twice in a track counts twice; unions of nothing have IoU 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def edges(sparse_points: DataFrame) -> DataFrame:
    """point3d_id, image_id of every observation; a point's repeated rows count once."""
    one = sparse_points.where(F.col("point3d_id").isNotNull()).groupBy("point3d_id").agg(F.max("track").alias("track"))
    return one.select("point3d_id", F.explode("track.image_id").alias("image_id"))


def tile_support(points: DataFrame, observations: DataFrame, tile: list[Column], top_k: int, min_obs: int = 1) -> DataFrame:
    """Images of each tile by matched observations: tile columns, image_id, n, rank; most first, then the lower image."""
    tiles = points.select("point3d_id", *tile)
    names = [c for c in tiles.columns if c != "point3d_id"]
    n = observations.join(tiles, "point3d_id").groupBy(*names, "image_id").agg(F.count("*").alias("n")).where(F.col("n") >= min_obs)
    rank = F.row_number().over(Window.partitionBy(*names).orderBy(F.desc("n"), "image_id"))
    return n.withColumn("rank", rank).where(F.col("rank") <= top_k)


def drop_unseen(images: DataFrame, kept: DataFrame, key: str = "point3d_id") -> DataFrame:
    """Observations with the id replaced by -1 where the point isn't kept: a left join on distinct ids."""
    k = kept.select(F.col(key)).where(F.col(key).isNotNull()).distinct().withColumn("_kept", F.lit(True))
    long = images.select("image_id", F.explode("points2d.point3d_id").alias(key))
    return long.join(k, key, "left").withColumn(key, F.when(F.col("_kept"), F.col(key)).otherwise(F.lit(-1))).drop("_kept")


def camera_centre(q: Column, t: Column) -> list[Column]:
    """-R't of a pose (qvec wxyz, tvec)."""
    from ..functions.exprs import rotation

    r = rotation(q[0], q[1], q[2], q[3])
    return [-(r[i] * t[0] + r[3 + i] * t[1] + r[6 + i] * t[2]) for i in range(3)]


def confusion(pairs: DataFrame, truth: str, guess: str, by: list[str] | None = None) -> DataFrame:
    """Per class of the truth: intersection, union, iou, acc. Guesses on unlabelled rows (truth 0 or null) don't count."""
    by = by or []
    cm = pairs.where(F.col(truth).isNotNull() & (F.col(truth) != 0)).groupBy(*by, truth, guess).agg(F.count("*").alias("n"))
    t = cm.groupBy(*by, F.col(truth).alias("cls")).agg(F.sum("n").alias("n_truth"), F.sum(F.when(F.col(truth) == F.col(guess), F.col("n")).otherwise(0)).alias("hit"))
    g = cm.where(F.col(guess).isNotNull()).groupBy(*by, F.col(guess).alias("cls")).agg(F.sum("n").alias("n_guess"))
    j = t.join(g, [*by, "cls"], "left").withColumn("n_guess", F.coalesce("n_guess", F.lit(0)))
    union = F.col("n_truth") + F.col("n_guess") - F.col("hit")
    return j.select(*by, "cls", "hit", union.alias("union_n"), F.when(union > 0, F.col("hit") / union).otherwise(0.0).alias("iou"), (F.col("hit") / F.col("n_truth")).alias("acc"))


def set_overlap(rows: DataFrame, a: str, b: str, item: str, base: str = "union", extra: float = 0.0) -> DataFrame:
    """IoU of the sets named by ``a`` and ``b`` over distinct items that hold both labels. ``base`` former or later divides by the size of
    a's or b's set instead of the union; ``extra`` is added to the divisor."""
    d = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(item, a, b).distinct()
    inter = d.groupBy(a, b).agg(F.count("*").alias("inter"))
    na = d.groupBy(a).agg(F.count("*").alias("na"))
    nb = d.groupBy(b).agg(F.count("*").alias("nb"))
    j = inter.join(na, a).join(nb, b)
    size = {"union": F.col("na") + F.col("nb") - F.col("inter"), "former": F.col("na"), "later": F.col("nb")}[base]
    return j.select(a, b, "inter", (F.col("inter") / (size + extra)).alias("iou"))
