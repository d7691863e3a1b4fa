"""Label rasters as rows (view_idx, v, u, mask_id): lookups, levels, components, splats, painting, shapes, similarity of images.

Defined results: pixels without a row are unlabelled (0 unless said otherwise); null labels are dropped; ties go to the lower label or id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..util import cut
from .spatial import components


def look_up(pixels: DataFrame, raster: DataFrame, missing: int | None = None) -> DataFrame:
    """``pixels`` with the raster's mask_id at their place: an equi-join on view, row and column. Without ``missing`` unlabelled pixels drop."""
    on = ["view_idx", "v", "u"]
    out = pixels.join(raster.select(*on, "mask_id"), on, "inner" if missing is None else "left")
    return out if missing is None else out.withColumn("mask_id", F.coalesce("mask_id", F.lit(missing)))


def level_offset(raster: DataFrame, level: int) -> DataFrame:
    """One level of a raster (view_idx, level, v, u, mask_id) whose ids run on over the levels, renumbered from 1; 0 is invalid.

    The greatest id of the level before, plus one, comes off; ids below -1 become -1, and one is added.
    """
    before = raster.where(F.col("level") == level - 1).groupBy("view_idx").agg(F.max("mask_id").alias("_top"))
    here = raster.where(F.col("level") == level).join(before, "view_idx", "left")
    off = F.when(F.col("mask_id") < 0, F.lit(-1)).otherwise(F.greatest(F.col("mask_id") - F.coalesce(F.col("_top") + 1, F.lit(0)), F.lit(-1)))
    return here.withColumn("mask_id", off + 1).drop("_top", "level")


def binarise(mask_id: Column) -> Column:
    return (mask_id > 0).cast("int")


def without(raster: DataFrame, ignore: list[int]) -> DataFrame:
    """Pixels whose mask is none of ``ignore``."""
    return raster.where(~F.col("mask_id").isin(ignore))


def mask_components(raster: DataFrame, min_area: int = 1, eight: bool = False) -> DataFrame:
    """Connected components of each class (view_idx, v, u, mask_id > 0), by 4 or 8 neighbours: view_idx, v, u, mask_id, instance.

    Pixels are nodes and equal neighbours are links, so a class that fills many images is no single task. Instances of at least
    ``min_area`` pixels are numbered from 1 within their view, by class and first pixel.
    """
    px = raster.where("mask_id > 0").select("view_idx", F.col("v").cast("bigint").alias("v"), F.col("u").cast("bigint").alias("u"), "mask_id").distinct()
    px = px.withColumn("node", F.shiftleft(F.col("view_idx").cast("bigint"), 40) + F.shiftleft("v", 20) + F.col("u"))
    px = cut(px)  # read four times
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if eight else [])
    ask = px.select("view_idx", "mask_id", F.col("node").alias("a"), "v", "u", F.explode(F.array(*[F.struct(F.lit(y).alias("y"), F.lit(x).alias("x")) for y, x in steps])).alias("d"))
    ask = ask.select("view_idx", "mask_id", "a", (F.col("v") + F.col("d.y")).alias("v"), (F.col("u") + F.col("d.x")).alias("u"))
    edges = ask.join(px.select("view_idx", "mask_id", "v", "u", F.col("node").alias("b")), ["view_idx", "mask_id", "v", "u"]).select("a", "b")
    comp = px.join(components(px.select("node"), edges), "node")
    size = comp.groupBy("view_idx", "mask_id", "component").agg(F.count("*").alias("area")).where(F.col("area") >= min_area)
    number = size.withColumn("instance", F.row_number().over(Window.partitionBy("view_idx").orderBy("mask_id", "component"))).select("component", "instance", "area")
    return comp.join(number, "component").select("view_idx", "v", "u", "mask_id", "instance", "area")


def splats(pixels: DataFrame, sizes: DataFrame, radius: int) -> DataFrame:
    """Painter's test of square splats: each point covers (2 radius + 1)^2 pixels of its view (view_idx, point_id, u, v, depth);
    sizes (view_idx, width, height). A pixel shows the nearest point; equal depths go to the earlier offset (row by row), then the lower id."""
    offsets = [(y, x) for y in range(-radius, radius + 1) for x in range(-radius, radius + 1)]
    d = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(y).alias("y"), F.lit(x).alias("x")) for k, (y, x) in enumerate(offsets)])).alias("d")
    wide = pixels.select("view_idx", "point_id", "u", "v", "depth", d).select("view_idx", (F.col("v") + F.col("d.y")).alias("v"), (F.col("u") + F.col("d.x")).alias("u"), F.struct("depth", F.col("d.k").alias("k"), "point_id").alias("s"))
    inside = wide.join(sizes, "view_idx").where((F.col("u") >= 0) & (F.col("v") >= 0) & (F.col("u") < F.col("width")) & (F.col("v") < F.col("height")))
    return inside.groupBy("view_idx", "v", "u").agg(F.min("s").alias("s")).select("view_idx", "v", "u", F.col("s.point_id").alias("point_id"), F.col("s.depth").alias("depth"))


def paint_free(masks: DataFrame, min_area: int = 1) -> DataFrame:
    """Masks (view_idx, mask_id, score, v, u) painted by falling score (ties: lower mask) on pixels that are still free; a mask with
    fewer than ``min_area`` free pixels is passed over whole. Each choice depends on those before it, so a view, which is one image, is
    one group. Gives view_idx, v, u, mask_id."""

    paint = painter(min_area)
    kinds = dict(masks.dtypes)
    ok = masks.where(F.col("mask_id").isNotNull() & F.col("score").isNotNull()).select("view_idx", "mask_id", "score", "v", "u")
    return ok.groupBy("view_idx").applyInPandas(paint, f"view_idx {kinds['view_idx']}, v {kinds['v']}, u {kinds['u']}, mask_id {kinds['mask_id']}")


def painter(min_area: int = 1) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """``paint_free`` of one view's rows."""

    def paint(pdf: pd.DataFrame) -> pd.DataFrame:
        # a mask's greatest score, whichever of its repeated pixels stays
        order = pdf.groupby("mask_id")["score"].max().reset_index().sort_values(["score", "mask_id"], ascending=[False, True])["mask_id"]
        pdf = pdf.drop_duplicates(["mask_id", "v", "u"])
        place = pdf["v"].to_numpy(dtype=np.int64) * (1 << 32) + pdf["u"].to_numpy(dtype=np.int64)
        _, pixel = np.unique(place, return_inverse=True)
        taken = np.zeros(len(place), dtype=bool)
        keep = np.zeros(len(pdf), dtype=bool)
        where = pdf.groupby("mask_id").indices
        for m in order:
            rows = where[m]
            free = rows[~taken[pixel[rows]]]
            if len(free) >= min_area:
                keep[free] = True
                taken[pixel[free]] = True
        return pdf.loc[keep, ["view_idx", "v", "u", "mask_id"]]

    return paint


def suppress(boxes: DataFrame, by: list[str], max_iou: float = 0.5, min_area: float = 0.0, max_boxes: int | None = None) -> DataFrame:
    """Box suppression: within each group (an image and class) a box (box_id, x0, y0, x1, y1, score) drops if a box that is kept, has a
    higher score (ties: lower id) and overlaps it by more than ``max_iou``. Boxes under ``min_area`` drop first; ``max_boxes`` limits
    the report per group. The choice is sequential, so a group, the boxes of one class in one image, is one task's array."""

    def kept(b: np.ndarray) -> list[int]:
        area = (b[:, 2] - b[:, 0]).clip(0) * (b[:, 3] - b[:, 1]).clip(0)
        alive, keep = area >= min_area, []
        for i in range(len(b)):
            if not alive[i] or (max_boxes is not None and len(keep) >= max_boxes):
                continue
            keep.append(i)
            w = (np.minimum(b[i, 2], b[:, 2]) - np.maximum(b[i, 0], b[:, 0])).clip(0)
            h = (np.minimum(b[i, 3], b[:, 3]) - np.maximum(b[i, 1], b[:, 1])).clip(0)
            union = area[i] + area - w * h
            alive &= ~(np.divide(w * h, union, out=np.zeros(len(b)), where=union > 0) > max_iou)
        return keep

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "box_id"], ascending=[False, True], ignore_index=True)
        b = pdf[["x0", "y0", "x1", "y1"]].to_numpy(dtype=float)
        rows = [place[kept(b[place])] for place in pdf.groupby(by, dropna=False, sort=False).indices.values()]
        return pdf.iloc[np.concatenate(rows)][cols]

    cols = [*by, "box_id", "x0", "y0", "x1", "y1", "score"]
    kinds = dict(boxes.dtypes)
    ok = boxes.where(F.col("score").isNotNull()).select(*cols).distinct()
    # many small groups to a call; a group is whole in one
    some = ok.withColumn("_some", F.pmod(F.xxhash64(*by), F.lit(4096)))
    return some.groupBy("_some").applyInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in cols))


def cohesion(pixels: DataFrame, by: list[str], mask: str, feature: list[str]) -> DataFrame:
    """Mean over a group's masks of the mean distance of their pixels to the mask's mean feature."""
    mean = pixels.groupBy(*by, mask).agg(*[F.avg(c).alias(f"m_{c}") for c in feature])
    d = F.sqrt(sum((F.col(c) - F.col(f"m_{c}")) ** 2 for c in feature))
    inner = pixels.join(mean, [*by, mask]).groupBy(*by, mask).agg(F.avg(d).alias("d"))
    return inner.groupBy(*by).agg(F.avg("d").alias("cohesion"), F.count("*").alias("n_masks"))


def separation(pixels: DataFrame, by: list[str], mask: str, feature: list[str], cut_below: float | None = None) -> DataFrame:
    """Mean over ordered pairs of a group's masks of w / (distance^2 + 1) of their mean features. w is the pair's rank by distance in
    the row of the first mask, scaled from 1 (the nearest) down to 0.1; with ``cut_below`` weights under it become 0.1."""
    mean = pixels.groupBy(*by, mask).agg(*[F.avg(c).alias(c) for c in feature])
    other = mean.select(*by, F.col(mask).alias("_other"), *[F.col(c).alias(f"o_{c}") for c in feature])
    d2 = sum((F.col(c) - F.col(f"o_{c}")) ** 2 for c in feature)
    pairs = mean.join(other, by).where(F.col(mask) != F.col("_other")).withColumn("d2", d2)
    w = Window.partitionBy(*by, mask)
    ranked = pairs.withColumn("rank", F.row_number().over(w.orderBy("d2", "_other"))).withColumn("n", F.count("*").over(w))
    weight = F.when(F.col("n") > 1, 1.0 - 0.9 * (F.col("rank") - 1) / (F.col("n") - 1)).otherwise(1.0)
    if cut_below is not None:
        weight = F.when(weight < cut_below, 0.1).otherwise(weight)
    return ranked.groupBy(*by).agg(F.avg(weight / (F.col("d2") + 1)).alias("separation"), F.countDistinct(mask).alias("n_masks"))


def ssim(images: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Mean structural similarity of two rasters of values in [0, 1] per group, 11 x 11 Gaussian windows of deviation 1.5, zeros beyond
    the border. A group is one image, which one task holds as two arrays; missing pixels count as 0."""
    # The stabilising constants and the window.
    c1, c2, size, sigma = 0.01**2, 0.03**2, 11, 1.5
    kinds = dict(images.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v, u = pdf["v"].to_numpy() - pdf["v"].min(), pdf["u"].to_numpy() - pdf["u"].min()
        x, y = np.zeros((v.max() + 1, u.max() + 1)), np.zeros((v.max() + 1, u.max() + 1))
        x[v, u], y[v, u] = pdf[a], pdf[b]
        g = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma**2))
        g /= g.sum()

        def blur(z: np.ndarray) -> np.ndarray:
            p = np.pad(z, size // 2)
            rows = sum(g[k] * p[k : k + z.shape[0]] for k in range(size))
            return sum(g[k] * rows[:, k : k + z.shape[1]] for k in range(size))

        mx, my = blur(x), blur(y)
        vx, vy, cov = blur(x * x) - mx * mx, blur(y * y) - my * my, blur(x * y) - mx * my
        s = ((2 * mx * my + c1) * (2 * cov + c2)) / ((mx * mx + my * my + c1) * (vx + vy + c2))
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in by}, "ssim": [float(s.mean())]})

    ok = images.select(*by, F.col("v").cast("int").alias("v"), F.col("u").cast("int").alias("u"), F.coalesce(F.col(a).cast("double"), F.lit(0.0)).alias(a), F.coalesce(F.col(b).cast("double"), F.lit(0.0)).alias(b))
    return ok.groupBy(*by).applyInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in by) + ", ssim double")


def draw_shapes(shapes: DataFrame) -> DataFrame:
    """Rasters of shapes (view_idx, shape_no, kind, points ARRAY<ARRAY<DOUBLE>> of x and y, width, height, mask_id): view_idx, v, u, mask_id.

    Kinds are polygon, rectangle, circle (centre and a point on it), line and point. Each shape is drawn where it stands; a later shape
    overwrites an earlier one, which is a maximum per pixel. Shapes with too few points give no pixels.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                pts = np.array([list(p) for p in r.points], dtype=float).reshape(-1, 2) if r.points is not None else np.zeros((0, 2))
                inside = _inside(r.kind, pts, int(r.width), int(r.height))
                if inside is not None and inside.any():
                    v, u = np.nonzero(inside)
                    yield pd.DataFrame({"view_idx": r.view_idx, "shape_no": r.shape_no, "v": v, "u": u, "mask_id": r.mask_id})

    kinds = dict(shapes.dtypes)
    rows = shapes.where("width > 0 and height > 0 and mask_id is not null").mapInPandas(run, f"view_idx {kinds['view_idx']}, shape_no {kinds['shape_no']}, v int, u int, mask_id {kinds['mask_id']}")
    return rows.groupBy("view_idx", "v", "u").agg(F.max(F.struct("shape_no", "mask_id"))["mask_id"].alias("mask_id"))


def _inside(kind: str, pts: np.ndarray, width: int, height: int) -> np.ndarray | None:
    v, u = np.mgrid[0:height, 0:width]
    if kind == "point" and len(pts) >= 1:
        return (u == round(pts[0, 0])) & (v == round(pts[0, 1]))
    if len(pts) < 2:
        return None
    if kind == "rectangle":
        (x0, y0), (x1, y1) = pts[:2].min(0), pts[:2].max(0)
        return (u >= np.rint(x0)) & (u <= np.rint(x1)) & (v >= np.rint(y0)) & (v <= np.rint(y1))
    if kind == "circle":
        return (u - pts[0, 0]) ** 2 + (v - pts[0, 1]) ** 2 <= ((pts[1] - pts[0]) ** 2).sum()
    if kind == "line":
        out = np.zeros((height, width), dtype=bool)
        for p, q in zip(pts[:-1], pts[1:]):
            n = int(np.abs(q - p).max()) * 2 + 1
            xy = np.rint(p + np.linspace(0, 1, n)[:, None] * (q - p)).astype(int)
            ok = (xy[:, 0] >= 0) & (xy[:, 0] < width) & (xy[:, 1] >= 0) & (xy[:, 1] < height)
            out[xy[ok, 1], xy[ok, 0]] = True
        return out
    if kind == "polygon" and len(pts) >= 3:
        # even-odd rule: edges crossed by a ray to the right of each pixel
        odd = np.zeros((height, width), dtype=bool)
        for (x0, y0), (x1, y1) in zip(pts, np.roll(pts, -1, axis=0)):
            if y0 != y1:
                crossed = (np.minimum(y0, y1) <= v) & (v < np.maximum(y0, y1))
                odd ^= crossed & (u < x0 + (v - y0) * (x1 - x0) / (y1 - y0))
        return odd
    return None
