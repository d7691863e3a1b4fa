"""Occupied voxels as rows: weights, thresholds, closing, exposed faces."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The six face directions.
FACES = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]


def occupancy(points: DataFrame, by: list[str], side: float, weight: Column) -> DataFrame:
    """Weight and count per voxel (i, j, k): a partial aggregate before the shuffle."""
    v = [F.floor(F.col(a) / side).cast("int").alias(n) for a, n in zip("xyz", "ijk")]
    return points.groupBy(*by, *v).agg(F.sum(weight).alias("w"), F.count("*").alias("n"))


def dense(voxels: DataFrame, by: list[str], quantile: float) -> DataFrame:
    """Voxels at or above the exact quantile of their group's weights."""
    t = voxels.groupBy(*by).agg(F.percentile("w", F.lit(quantile)).alias("t"))
    return voxels.join(t, by).where(F.col("w") >= F.col("t")).drop("t")


def exposed_faces(voxels: DataFrame, by: list[str]) -> DataFrame:
    """Faces without a neighbour: one anti join over the exploded directions."""
    d = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(z).alias("z")) for x, y, z in FACES])).alias("d")
    f = voxels.select(*by, "i", "j", "k", d).select(*by, "i", "j", "k", F.col("d.x").alias("dx"), F.col("d.y").alias("dy"), F.col("d.z").alias("dz"))
    full = voxels.select(*by, F.col("i").alias("ni"), F.col("j").alias("nj"), F.col("k").alias("nk"))
    f = f.withColumn("ni", F.col("i") + F.col("dx")).withColumn("nj", F.col("j") + F.col("dy")).withColumn("nk", F.col("k") + F.col("dz"))
    return f.join(full, [*by, "ni", "nj", "nk"], "left_anti").select(*by, "i", "j", "k", "dx", "dy", "dz")


def erode(voxels: DataFrame, by: list[str]) -> DataFrame:
    """Voxels all of whose six neighbours are full: one grouped count."""
    shift = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(f, "xyz")]) for f in FACES]))
    near = voxels.select(*by, "i", "j", "k", shift.alias("d")).select(*by, *[(F.col(c) + F.col(f"d.{n}")).alias(c) for c, n in zip("ijk", "xyz")])
    inner = near.groupBy(*by, "i", "j", "k").agg(F.count("*").alias("c")).where("c = 6").drop("c")
    return voxels.select(*by, "i", "j", "k").distinct().join(inner, [*by, "i", "j", "k"], "left_semi")


def composite(alpha: Column, colour: Column, order: Column) -> Column:
    """Front-to-back blend of a group's splats as one ordered fold: alpha capped at 0.99, below 1/255 skipped, stop before the
    light left falls under 1e-4. Gives a struct of colour and the light left."""
    rows = F.sort_array(F.collect_list(F.struct(order.alias("o"), F.least(alpha, F.lit(0.99)).alias("a"), colour.alias("c"))))
    start = F.struct(F.lit(0.0).alias("colour"), F.lit(1.0).alias("left"), F.lit(False).alias("done"))

    def step(s, r):
        rest = s["left"] * (1 - r["a"])
        skip = s["done"] | (r["a"] < 1 / 255)
        stop = ~skip & (rest < 1e-4)
        keep = skip | stop
        return F.struct(
            F.when(keep, s["colour"]).otherwise(s["colour"] + s["left"] * r["a"] * r["c"]).alias("colour"),
            F.when(keep, s["left"]).otherwise(rest).alias("left"),
            (s["done"] | stop).alias("done"),
        )

    return F.aggregate(rows, start, step)


def blender(side: int, key: str, alpha: str, colour: str) -> tuple[Callable[[pd.DataFrame], pd.DataFrame], Callable[[pd.DataFrame], np.ndarray]]:
    """``composite`` of the rows of one view (view_idx, u, v, depth, key, alpha, colour) on pixel blocks of ``side``: a function to view_idx,
    bu, bv, red, light, and one to the places of the rows that count, whatever else stands between them: a block's light is not less
    without other rows, so what is behind its stop there is behind it here. All blocks of a view go on together, splat by splat."""

    def fold(rows: pd.DataFrame):
        u, v = rows["u"].to_numpy(np.int64) // side, rows["v"].to_numpy(np.int64) // side
        a = np.fmin(rows[alpha].to_numpy(float), 0.99)
        block = v * (int(u.max()) + 1) + u
        order = np.lexsort((rows[key].to_numpy(), rows["depth"].to_numpy(), block))
        block = block[order]
        first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        lead = order[first]
        # what is too faint is skipped, and a block of nothing else keeps its light
        which = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(order)]))
        seen = a[order] >= 1 / 255
        order, which = order[seen], which[seen]
        a, c = a[order], rows[colour].to_numpy(float)[order]
        at = np.searchsorted(which, np.arange(len(first)))
        n = np.searchsorted(which, np.arange(len(first)), side="right") - at
        left, total, used = np.ones(len(first)), np.zeros(len(first)), np.zeros(len(first), dtype=np.int64)
        go, r = np.flatnonzero(n > 0), 0
        while len(go):
            i = at[go] + r
            used[go] = r + 1
            rest = left[go] * (1 - a[i])
            ok = ~(rest < 1e-4)
            go, i = go[ok], i[ok]
            total[go] += left[go] * a[i] * c[i]
            left[go] = rest[ok]
            r += 1
            go = go[n[go] > r]
        return u[lead], v[lead], lead, total, left, order, np.arange(len(order)) - at[which] < used[which]

    def blend(rows: pd.DataFrame) -> pd.DataFrame:
        bu, bv, _, total, left, _, _ = fold(rows)
        return pd.DataFrame({"view_idx": rows["view_idx"].to_numpy()[: len(bu)], "bu": bu, "bv": bv, "red": total, "light": left})

    def pick(rows: pd.DataFrame) -> np.ndarray:
        _, _, lead, _, _, order, count = fold(rows)
        return np.union1d(lead, order[count])

    return blend, pick


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
