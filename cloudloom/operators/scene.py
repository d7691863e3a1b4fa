"""Scenes: camera normalisation, padded boxes, intrinsics of camera models, harmonics, image quality, painting order.

Defined results: groups without usable rows are absent; equal images have PSNR 100; ties of painting go to the lower label.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import SH0, harmonic_basis


def normalisation(centres: DataFrame, by: list[str], axes: tuple[str, ...] = ("cx", "cy", "cz"), margin: float = 1.1) -> DataFrame:
    """Mean camera centre of each group and the largest distance to it, widened by a margin: two partial aggregates."""
    mean = centres.groupBy(*by).agg(*[F.avg(a).alias(f"m_{a}") for a in axes])
    d = F.sqrt(sum((F.col(a) - F.col(f"m_{a}")) ** 2 for a in axes))
    return centres.join(mean, by).groupBy(*by).agg(*[F.first(f"m_{a}").alias(f"m_{a}") for a in axes], (F.max(d) * margin).alias("radius"))


def pad(boxes: DataFrame, ratio: float, absolute: float, axes: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """Boxes widened on both sides by a share of their extent and a fixed length."""
    for a in axes:
        by = (F.col(f"{a}_max") - F.col(f"{a}_min")) * ratio + absolute
        low, high = F.col(f"{a}_min") - by, F.col(f"{a}_max") + by
        boxes = boxes.withColumns({f"{a}_min": low, f"{a}_max": high})
    return boxes


def intrinsics(model: Column, params: Column) -> list[Column]:
    """fx, fy, cx, cy of the pinhole and radial models in their own order of parameters; null for other models or short lists."""
    at = lambda i: F.get(params, F.lit(i))
    one = model.isin("SIMPLE_PINHOLE", "SIMPLE_RADIAL", "RADIAL")
    two = model.isin("PINHOLE", "OPENCV")
    return [F.when(one, at(a)).when(two, at(b)) for a, b in ((0, 0), (0, 1), (1, 2), (2, 3))]


def harmonics(dc: Column, rest: Column, x: Column, y: Column, z: Column, degree: int = 1) -> Column:
    """Colour of degree 0 to ``degree`` (at most 4) in the unit direction x, y, z, shifted and clamped at zero; missing coefficients count as 0."""
    c = lambda i: F.coalesce(F.get(rest, F.lit(i)).cast("double"), F.lit(0.0))
    basis = harmonic_basis(degree, x, y, z) if degree else []
    return F.greatest(sum((b * c(i) for i, b in enumerate(basis)), SH0 * dc) + 0.5, F.lit(0.0))


def psnr(a: Column, b: Column) -> Column:
    """Aggregate: 10 log10(1 / mean squared error) of values in [0, 1]."""
    mse = F.avg((a - b) * (a - b))
    return F.when(mse > 0, -10.0 * F.log10(mse)).when(mse == 0, 100.0)


def paint(rows: DataFrame, pixel: list[str], label: str, score: str) -> DataFrame:
    """The label that is painted last when masks are laid down by rising score."""
    # one number a label first: a hash aggregate, so few rows are left to be sorted
    rows = rows.groupBy(*pixel, label).agg(F.max(score).alias(score))
    top = rows.groupBy(*pixel).agg(F.max(F.struct(score, (-F.col(label)).alias("l"))).alias("m"))
    return top.select(*pixel, (-F.col("m.l")).alias(label))


def steady_masks(stats: DataFrame, by: list[str], limit: float = 0.006, large: float = 0.8) -> DataFrame:
    """Masks (n, var) of low variance, and those whose area is above a share of the largest of their view."""
    w = Window.partitionBy(*by)
    return stats.withColumn("_most", F.max("n").over(w)).where((F.col("var") <= limit) | (F.col("n") > large * F.col("_most"))).drop("_most")


def learning_rate(step: Column, first: float, last: float, steps: int) -> Column:
    """Log-linear schedule from ``first`` to ``last`` over ``steps``; held beyond."""
    t = F.least(F.greatest(step / float(steps), F.lit(0.0)), F.lit(1.0))
    return F.exp(math.log(first) * (1 - t) + math.log(last) * t)


def leaf_scores(rows: DataFrame, leaf: str, score: str, matched: str) -> DataFrame:
    """Mean score of the matched rows of each leaf (the count is raised by 1e-6, so a leaf without a match scores 0), and their number."""
    n = F.count_if(F.col(matched))
    return rows.groupBy(leaf).agg(F.round(F.sum(F.when(F.col(matched), F.col(score)).otherwise(0.0)) / (n + 1e-6), 5).alias("score"), n.alias("n"))
