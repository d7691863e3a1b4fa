"""Filters, scaling, sampling and subsets of point tables.

Defined results: a null in a compared column drops the row from a filter; scaling by a zero range gives 0; ties of top lists go to
the lower key; empty inputs give empty outputs (one-row statistics then hold nulls).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..util import cut


def latest(df: DataFrame, key: str, order: str = "loaded_at") -> DataFrame:
    """One row per key: the one loaded last; of equal ones any, as they repeat."""
    rest = [c for c in df.columns if c != key]
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), F.coalesce(order, F.lit("1970-01-01").cast("timestamp"))).alias("r")).select(key, "r.*")


def opaque(points: DataFrame, min_opacity: float = 0.05, max_log_scale: float = 2.0, min_norm: float | None = None, vector: str = "ins_feat") -> DataFrame:
    """Points with sigmoid(opacity) above and largest log scale below a limit, and with ``min_norm`` a vector of at least this length;
    null opacity counts as opaque (1)."""
    ok = (F.coalesce(X.sigmoid(F.col("opacity").cast("double")), F.lit(1.0)) > min_opacity) & (F.greatest("scale_0", "scale_1", "scale_2") < max_log_scale)
    return points.where(ok if min_norm is None else ok & (X.norm(F.col(vector)) >= min_norm))


def above_logit(points: DataFrame, least: float) -> DataFrame:
    """Points whose raw opacity is at least ``least``; null opacity drops."""
    return points.where(F.col("opacity") >= least)


def centrality(df: DataFrame, by: list[str], quality: Column | None = None) -> DataFrame:
    """Adds ``_s`` for ``core_points``: minus the distance to the group's mean position; with ``quality`` the mean of both, each scaled
    to [0, 1] within its group."""
    mean = df.groupBy(*by).agg(*[F.avg(a).alias(f"_m{a}") for a in "xyz"])
    near = df.join(mean, by).withColumn("_s", -F.sqrt(sum((F.col(a) - F.col(f"_m{a}")) ** 2 for a in "xyz"))).drop("_mx", "_my", "_mz")
    if quality is None:
        return near
    both = min_max(near.withColumn("_q", quality), ["_s", "_q"], by)
    return both.withColumn("_s", (F.col("_s") + F.col("_q")) / 2).drop("_q")


def feature_space(df: DataFrame, by: list[str], vector: str, dims: int, feature_weight: float = 1.0, position_weight: float = 1.0, z_scale: float = 1.0) -> DataFrame:
    """Adds ``space``: the vector and x, y, z, each scaled to [0, 1] within its group and weighted; z is scaled by ``z_scale`` before.
    Scaling z alone changes nothing but rounding, as each axis has its own range, unless the range is zero."""
    cols = [f"_v{j}" for j in range(dims)]
    wide = df.withColumns({**{c: F.col(vector)[j].cast("double") for j, c in enumerate(cols)}, "_x": F.col("x"), "_y": F.col("y"), "_z": F.col("z") * z_scale})
    scaled = min_max(wide, [*cols, "_x", "_y", "_z"], by)
    return scaled.withColumn("space", F.array(*[F.col(c) * feature_weight for c in cols], *[F.col(f"_{a}") * position_weight for a in "xyz"])).drop(*cols, "_x", "_y", "_z")


def min_max(df: DataFrame, cols: list[str], by: list[str]) -> DataFrame:
    """``cols`` scaled to [0, 1] within each group of ``by``: two passes, the first a partial aggregate of one row per group."""
    lim = df.groupBy(*by).agg(*[F.min(c).alias(f"_lo_{c}") for c in cols], *[F.max(c).alias(f"_hi_{c}") for c in cols])
    out = df.join(lim, by)
    for c in cols:
        span = F.col(f"_hi_{c}") - F.col(f"_lo_{c}")
        out = out.withColumn(c, (F.col(c) - F.col(f"_lo_{c}")) / F.when(span < 1e-8, 1.0).otherwise(span))
    return out.drop(*[f"_lo_{c}" for c in cols], *[f"_hi_{c}" for c in cols])


def bounds(df: DataFrame, by: list[str], axes: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """Box of each group: count, least, greatest, centre of each axis."""
    agg = [F.count("*").alias("n")]
    for a in axes:
        agg += [F.min(a).alias(f"{a}_min"), F.max(a).alias(f"{a}_max")]
    return df.groupBy(*by).agg(*agg).select("*", *[((F.col(f"{a}_min") + F.col(f"{a}_max")) / 2).alias(f"{a}_mid") for a in axes])


def centre_crop(df: DataFrame, by: list[str], ratio_xy: float = 0.5, ratio_z: float = 1.0) -> DataFrame:
    """Points within the middle share of their group's box, borders included."""
    b = bounds(df, by)
    out = df.join(b, by)
    inside = F.lit(True)
    for a, r in (("x", ratio_xy), ("y", ratio_xy), ("z", ratio_z)):
        half = (F.col(f"{a}_max") - F.col(f"{a}_min")) / 2 * r
        inside = inside & (F.abs(F.col(a) - F.col(f"{a}_mid")) <= half)
    return out.where(inside).select(*df.columns)


def quarters(df: DataFrame, by: list[str]) -> DataFrame:
    """Adds quarter 0..3 by the box centre; the lower side holds its border, so quarters are disjoint and complete."""
    b = bounds(df, by).select(*by, "x_mid", "y_mid")
    q = (F.col("x") > F.col("x_mid")).cast("int") + 2 * (F.col("y") > F.col("y_mid")).cast("int")
    return df.join(b, by).withColumn("quarter", q).drop("x_mid", "y_mid")


def first_in_cell(df: DataFrame, key: str, by: list[str], side: float) -> DataFrame:
    """The lowest key of every cube of a grid: one partial aggregate, no sort."""
    cells = [F.floor(F.col(a) / side).alias(f"c{a}") for a in "xyz"]
    return df.groupBy(*by, *cells).agg(F.min(key).alias(key), F.count("*").alias("n"))


def ranks(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """Adds ``_rn``, the row's number within its group (from 1), without a group ever standing in one task: rows are range-partitioned
    by group and order, numbered within their range, and each range starts where the ranges before it end. The order must be total."""
    placed = cut(df.repartitionByRange(*[F.col(b) for b in by], *order).withColumn("_range", F.spark_partition_id()))
    size = placed.groupBy(*by, "_range").agg(F.count("*").alias("_size"))
    # one row per group and range
    before = size.withColumn("_before", F.coalesce(F.sum("_size").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inner = placed.withColumn("_rn", F.row_number().over(Window.partitionBy(*by, "_range").orderBy(*order)))
    on = F.lit(True)
    for c in [*by, "_range"]:
        on = on & F.col(f"r.{c}").eqNullSafe(F.col(f"b.{c}"))
    out = inner.alias("r").join(before.alias("b"), on)
    return out.select(*[F.col(f"r.{c}") for c in df.columns], (F.col("r._rn") + F.col("b._before")).alias("_rn"))


def every_nth(df: DataFrame, key: str, by: list[str], n: int) -> DataFrame:
    """Every nth row of each group in the order of its key."""
    return ranks(df, by, [F.col(key).asc()]).where((F.col("_rn") - 1) % n == 0).drop("_rn")


def sample_n(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement by the hash of key and seed: the same rows at every partitioning (a sampling operator)."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def core_points(df: DataFrame, key: str, by: list[str], score: Column, ratio: float = 0.3, least: int = 500, most: int = 20000) -> DataFrame:
    """The best of each group: round(n * ratio), at least ``least`` and at most ``most``. Scores tie to the lower key."""
    size = df.groupBy(*by).agg(F.count("*").alias("_n"))
    target = F.least(F.greatest(F.rint(F.col("_n") * ratio), F.lit(float(least))), F.least(F.col("_n"), F.lit(most)))
    ranked = ranks(df.withColumn("_s", score), by, [F.col("_s").desc(), F.col(key).asc()])
    return ranked.join(size, by).where(F.col("_rn") <= target).drop("_s", "_rn", "_n")
