"""Projection into views, nearest point per pixel, label votes and their acceptance.

Defined results: a view without focal length takes its width as focal length and its middle as centre; unknown modes are read as
perspective; points at or behind 1e-6 are left out; of equal depths the lower point_id is in front; orthographic views keep all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..util import cut

#: Points of a scene that a task holds at a time, and pairs of point and view from which a scene's views are spread over more tasks.
BLOCK, PAIRS = 1 << 20, 1 << 25


def project(points: DataFrame, views: DataFrame, side: float = 4.0) -> DataFrame:
    """Pixels (view_idx, point_id, u, v, depth) of the points of a view's own scene.

    Points meet views through cubes of ``side`` units: only cubes whose bounding sphere reaches into a view's frustum are joined to it,
    so the join is on scene and cube, a large scene is spread over its cubes, and most points out of frame are never projected.
    """
    v = _parameters(views)
    x, y, z = (F.col(a).cast("double") for a in ("x", "y", "z"))
    points = _placed(points).withColumn("cube", F.struct(*[F.floor(a / side).alias(n) for a, n in ((x, "i"), (y, "j"), (z, "k"))]))
    v = _cubes_in_frame(points, v)
    axis = lambda r: F.col(f"m{4 * r}") * x + F.col(f"m{4 * r + 1}") * y + F.col(f"m{4 * r + 2}") * z + F.col(f"m{4 * r + 3}")
    cam = points.join(v, ["scene", "cube"]).select("*", axis(0).alias("px"), axis(1).alias("py"), axis(2).alias("depth")).where("depth > 1e-6")
    wide, high = F.col("ortho_x_max") - F.col("ortho_x_min"), F.col("ortho_y_max") - F.col("ortho_y_min")
    ou = F.rint((F.col("px") - F.col("ortho_x_min")) / F.when(wide > 0, wide) * (F.col("width") - 1))
    ov = F.rint(F.when(F.col("up"), F.col("py") - F.col("ortho_y_min")).otherwise(F.col("ortho_y_max") - F.col("py")) / F.when(high > 0, high) * (F.col("height") - 1))
    # the planner may test a pixel's place before its depth
    depth = F.when(F.col("depth") > 1e-6, F.col("depth"))
    u = F.when(F.coalesce("ortho", F.lit(False)), ou).otherwise(F.rint(F.col("fx") * F.col("px") / depth + F.col("cx")))
    w = F.when(F.coalesce("ortho", F.lit(False)), ov).otherwise(F.rint(F.col("fy") * F.col("py") / depth + F.col("cy")))
    seen = cam.withColumn("u", u).withColumn("v", w).where((F.col("u") >= 0) & (F.col("u") < F.col("width")) & (F.col("v") >= 0) & (F.col("v") < F.col("height")))
    return seen.select("view_idx", "point_id", F.col("u").cast("int").alias("u"), F.col("v").cast("int").alias("v"), "depth", F.coalesce("ortho", F.lit(False)).alias("ortho"))


def _parameters(views: DataFrame) -> DataFrame:
    """scene, view_idx and the parameters of each view, with its defaults."""
    m = [F.col("w2c")[i].cast("double") for i in range(12)]
    return views.select(
        "scene", "view_idx", *[m[i].alias(f"m{i}") for i in range(12)],
        F.coalesce("fx", F.col("width").cast("double")).alias("fx"), F.coalesce("fy", F.col("width").cast("double")).alias("fy"),
        F.coalesce("cx", F.col("width") / 2).alias("cx"), F.coalesce("cy", F.col("height") / 2).alias("cy"), "width", "height",
        (F.lower("projection_mode") == "orthographic").alias("ortho"), "ortho_x_min", "ortho_x_max", "ortho_y_min", "ortho_y_max",
        F.when(F.lower("ortho_v_mode") == "auto", m[5] < 0).otherwise(F.lower("ortho_v_mode").isin("y_minus_y_min", "ymin_to_ymax", "direct")).alias("up"),
    )


def _placed(points: DataFrame) -> DataFrame:
    """Points with finite coordinates."""
    for a in ("x", "y", "z"):
        c = F.col(a).cast("double")
        points = points.where(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return points


#: Parameters of a view in the order in which ``visible`` passes them.
_P = [*[f"m{i}" for i in range(12)], "fx", "fy", "cx", "cy", "width", "height", "ortho", "ortho_x_min", "ortho_x_max", "ortho_y_min", "ortho_y_max", "up"]


def visible(points: DataFrame, views: DataFrame, keep: tuple[str, ...] = (), block: int = BLOCK, pairs: int = PAIRS, each: tuple[Callable[[pd.DataFrame], pd.DataFrame], str] | None = None, pick: Callable[[pd.DataFrame], np.ndarray] | None = None) -> DataFrame:
    """view_idx, point_id, u, v, depth and the columns ``keep`` of the points that are nearest in their pixel: the rows of
    ``nearest_per_pixel(project(points, views))``, for views with one row per view_idx.

    A scene's points go to the tasks of its views once a task, and each view is projected and thinned out to its nearest points there,
    one after the other, so no pixel is shuffled. Scenes of more than ``block`` points come in several blocks of cubes; only then are
    the nearest of each block compared in an aggregate.

    With ``each``, a function of one view's rows and the DDL of what it gives, its results come out instead. With ``pick`` hidden points
    count too: ``each`` then gets all points in the frame, or, of scenes of several blocks, those of each block that ``pick`` names.
    """
    spark = points.sparkSession
    p = _placed(points).where(F.col("scene").isNotNull()).select("scene", "point_id", *[F.col(a).cast("double").alias(a) for a in "xyz"], *keep)
    v = _parameters(views.where(F.col("scene").isNotNull() & F.col("view_idx").isNotNull()))
    known = F.lit(True)
    for i in range(12):
        known = known & F.col(f"m{i}").isNotNull()
    v = v.where(known).select("scene", "view_idx", F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0 if c in ("ortho", "up") else float("nan"))) for c in _P]).alias("_p"))
    # one row per scene
    n = p.groupBy("scene").agg(F.count("*").alias("_n")).join(v.groupBy("scene").agg(F.count("*").alias("_m")), "scene")
    work = F.least(F.col("_n"), F.lit(block)) * F.col("_m").cast("double")
    chunks = F.least(F.greatest(F.least(F.ceil(work / pairs), F.lit(48)), F.ceil(work / (16 * pairs))), F.col("_m"))
    n = cut(n.select("scene", F.ceil(F.col("_n") / block).alias("_blocks"), chunks.alias("_chunks")))
    most, groups = n.agg(F.max("_blocks"), F.sum(F.col("_blocks") * F.col("_chunks"))).first()
    kinds = dict(points.dtypes)
    cube = F.xxhash64(*[F.floor(F.col(a) / CUBE) for a in "xyz"])
    spread = lambda c: F.explode(F.sequence(F.lit(0), (F.col(c) - 1).cast("int")))
    ps = p.join(n, "scene").withColumn("_b", F.pmod(cube, F.col("_blocks")).cast("int")).withColumn("_c", spread("_chunks"))
    vs = v.join(n, "scene").withColumn("_c", F.pmod(F.xxhash64("view_idx"), F.col("_chunks")).cast("int")).withColumn("_b", spread("_blocks"))
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    ps = ps.select("scene", "_b", "_c", none("_p", "array<double>"), none("view_idx", dict(v.dtypes)["view_idx"]), "point_id", "x", "y", "z", *keep)
    vs = vs.select("scene", "_b", "_c", "_p", "view_idx", none("point_id", kinds["point_id"]), *[none(a, "double") for a in "xyz"], *[none(c, kinds[c]) for c in keep])
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(int(groups or 1), 64, 8 * spark.sparkContext.defaultParallelism), int((groups or 1) // 16))
    key = ["scene", "_b", "_c"]
    # points stand before the views, which have parameters
    rows = ps.unionByName(vs).repartition(tasks, *key).sortWithinPartitions(*key, F.col("_p").isNotNull())
    schema = StructType([v.schema["view_idx"], points.schema["point_id"], *StructType.fromDDL("u int, v int, depth double, ortho boolean").fields, *[points.schema[c] for c in keep]])
    arrow = to_arrow_schema(schema)
    if each and (most or 0) <= 1:
        result = to_arrow_schema(StructType.fromDDL(each[1]))
        return rows.mapInArrow(lambda batches: _apply(_look(batches, list(keep), arrow, whole=True, hidden=pick is not None), each[0], result), each[1])
    out = rows.mapInArrow(lambda batches: _look(batches, list(keep), arrow, hidden=pick is not None, pick=pick), schema)
    if pick:
        return out.drop("ortho").groupBy("view_idx").applyInPandas(each[0], each[1])
    if (most or 0) <= 1:
        return out.drop("ortho")
    front = out.where(~F.col("ortho")).groupBy("view_idx", "u", "v").agg(F.min(F.struct("depth", "point_id", *keep)).alias("f"))
    cols = ["view_idx", "point_id", "u", "v", "depth", *keep]
    front = front.select("view_idx", "u", "v", "f.*").select(*cols)
    front = front.unionByName(out.where("ortho").select(*cols))
    return front.groupBy("view_idx").applyInPandas(each[0], each[1]) if each else front


#: Side of the cubes that are tested against a view, and the least number of points for which that pays.
CUBE, FEW = 4.0, 4096


class _Scene:
    """Points of one block of a scene, in the order of their cubes."""

    def __init__(self, parts: list[pa.RecordBatch]):
        t = pa.Table.from_batches(parts)
        x = np.stack([t.column(a).to_numpy() for a in "xyz"])
        self.starts = None
        if x.shape[1] >= FEW:
            cube = np.floor(x / CUBE)
            order = np.lexsort(cube)
            cube, x, t = cube[:, order], x[:, order], t.take(pa.array(order))
            self.starts = np.flatnonzero(np.r_[True, (cube[:, 1:] != cube[:, :-1]).any(axis=0)])
            low, high = np.minimum.reduceat(x, self.starts, axis=1), np.maximum.reduceat(x, self.starts, axis=1)
            self.counts = np.diff(np.r_[self.starts, x.shape[1]])
            self.ball, self.reach = (low + high) / 2, np.sqrt(((high - low) ** 2).sum(axis=0)) / 2 + 1e-3
        self.x, self.table, self.ids = x, t, t.column("point_id").to_numpy()

    def near(self, p: np.ndarray) -> np.ndarray | slice:
        """Places of the points whose cubes reach into a view's frame, as in ``_cubes_in_frame``."""
        if self.starts is None:
            return slice(None)
        row = p[:12].reshape(3, 4)
        fx, fy, cx, cy, width, height, ortho, x0, x1, y0, y1 = p[12:23]
        planes = [(row[2], 0.0)]
        if ortho:
            for r, lo, hi, n in ((0, x0, x1, width), (1, y0, y1, height)):
                margin = (hi - lo) / max(n - 1, 1)
                planes += [(row[r], margin - lo), (-row[r], hi + margin)]
        else:
            for r, f, c, n in ((0, fx, cx, width), (1, fy, cy, height)):
                planes += [(f * row[r] + (c + 1) * row[2], 0.0), (-f * row[r] + (n - c) * row[2], 0.0)]
        out = np.zeros(len(self.starts), dtype=bool)
        for w, offset in planes:
            # a number that is missing decides nothing
            out |= w[:3] @ self.ball + (w[3] + offset) + self.reach * np.sqrt((w[:3] ** 2).sum()) < -1e-6
        return np.flatnonzero(np.repeat(~out, self.counts))

    def seen(self, p: np.ndarray, hidden: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places, u, v and depth of the points that a view shows, or with ``hidden`` of all in its frame."""
        at = self.near(p)
        x, y, z = self.x[:, at]
        fx, fy, cx, cy, width, height, ortho, x0, x1, y0, y1, up = p[12:]
        px, py, depth = (p[4 * r] * x + p[4 * r + 1] * y + p[4 * r + 2] * z + p[4 * r + 3] for r in range(3))
        if ortho:
            wide, high = (d if d > 0 else np.nan for d in (x1 - x0, y1 - y0))
            u = np.rint((px - x0) / wide * (width - 1))
            v = np.rint((py - y0 if up else y1 - py) / high * (height - 1))
        else:
            u, v = np.rint(fx * px / depth + cx), np.rint(fy * py / depth + cy)
        ok = np.flatnonzero(~(depth <= 1e-6) & (u >= 0) & (u < width) & (v >= 0) & (v < height))
        u, v, depth = u[ok].astype(np.int64), v[ok].astype(np.int64), depth[ok]
        at = ok if isinstance(at, slice) else at[ok]
        if not ortho and not hidden and len(at):
            pixel = v * int(width) + u
            if width * height <= 1 << 24:
                shared = np.bincount(pixel, minlength=1)[pixel] > 1
            else:
                _, back, n = np.unique(pixel, return_inverse=True, return_counts=True)
                shared = n[back] > 1
            if shared.any():
                rest = np.flatnonzero(shared)
                rest = rest[np.lexsort((self.ids[at[rest]], depth[rest], pixel[rest]))]
                first = np.r_[True, pixel[rest][1:] != pixel[rest][:-1]]
                pick = np.concatenate([np.flatnonzero(~shared), rest[first]])
                at, u, v, depth = at[pick], u[pick], v[pick], depth[pick]
        return at, u, v, depth


def _apply(batches: Iterator[pa.RecordBatch], f: Callable[[pd.DataFrame], pd.DataFrame], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """``f`` on each view, a batch each."""
    held, n = [], 0
    for batch in batches:
        held.append(f(batch.to_pandas().drop(columns="ortho")))
        n += len(held[-1])
        if n >= 1 << 16:
            yield pa.RecordBatch.from_pandas(pd.concat(held), schema=schema, preserve_index=False)
            held, n = [], 0
    if n:
        yield pa.RecordBatch.from_pandas(pd.concat(held), schema=schema, preserve_index=False)


def _look(batches: Iterator[pa.RecordBatch], keep: list[str], schema: pa.Schema, whole: bool = False, hidden: bool = False, pick: Callable[[pd.DataFrame], np.ndarray] | None = None) -> Iterator[pa.RecordBatch]:
    """Nearest points of each view of a task's rows, in which the points of a block of a scene stand before its views; several views a
    batch, or with ``whole`` one."""
    key, parts, scene = None, [], None
    held, n = [], 0

    def flush():
        columns = [np.concatenate(c) for c in zip(*[h[:5] for h in held])]
        fixed = [pa.array(c).cast(f.type) for c, f in zip(columns, [schema.field(k) for k in ("view_idx", "u", "v", "depth", "ortho")])]
        by = dict(zip(("view_idx", "u", "v", "depth", "ortho"), fixed))
        rest = pa.concat_tables([h[5] for h in held]).combine_chunks()
        for c in ("point_id", *keep):
            a = rest.column(c)
            by[c] = (pa.concat_arrays(a.chunks) if a.num_chunks != 1 else a.chunk(0)).cast(schema.field(c).type)
        return pa.RecordBatch.from_arrays([by[f.name] for f in schema], schema=schema)

    with np.errstate(all="ignore"):
        for batch in batches:
            is_view = batch.column("_p").is_valid().to_numpy(zero_copy_only=False)
            # stretches of equal key and kind
            code = np.stack([batch.column("scene").dictionary_encode().indices.to_numpy(), batch.column("_b").to_numpy(), batch.column("_c").to_numpy(), is_view])
            starts = np.flatnonzero(np.r_[True, (code[:, 1:] != code[:, :-1]).any(axis=0)]) if batch.num_rows else []
            for start, size in zip(starts, np.diff(np.r_[starts, batch.num_rows])):
                piece = batch.slice(int(start), int(size))
                name = tuple(piece.column(k)[0].as_py() for k in ("scene", "_b", "_c"))
                if name != key:
                    key, parts, scene = name, [], None
                if not is_view[start]:
                    parts.append(piece.select(["point_id", "x", "y", "z", *keep]))
                elif parts:
                    scene = scene or _Scene(parts)
                    for view, p in zip(piece.column("view_idx").to_pylist(), piece.column("_p").to_pylist()):
                        p = np.array(p, dtype=float)
                        got, u, v, depth = scene.seen(p, hidden)
                        if pick and len(got):
                            rows = scene.table.select(["point_id", *keep]).take(pa.array(got)).to_pandas().assign(u=u, v=v, depth=depth)
                            at = pick(rows)
                            got, u, v, depth = got[at], u[at], v[at], depth[at]
                        if len(got):
                            held.append((np.full(len(got), view), u, v, depth, np.full(len(got), bool(p[18])), scene.table.select(["point_id", *keep]).take(pa.array(got))))
                            n += len(got)
                        if n >= (1 if whole else 1 << 16):
                            yield flush()
                            held.clear()
                            n = 0
        if held:
            yield flush()


def _cubes_in_frame(points: DataFrame, v: DataFrame) -> DataFrame:
    """``v`` with the cubes of its scene that reach into its frustum. Each side of the frame is a half-space, and a cube is out if its
    bounding sphere lies beyond one."""
    box = points.groupBy("scene", "cube").agg(*[F.min(F.col(a).cast("double")).alias(f"{a}0") for a in "xyz"], *[F.max(F.col(a).cast("double")).alias(f"{a}1") for a in "xyz"])
    ball = box.select("scene", "cube", *[((F.col(f"{a}0") + F.col(f"{a}1")) / 2).alias(f"b{a}") for a in "xyz"], (F.sqrt(sum((F.col(f"{a}1") - F.col(f"{a}0")) ** 2 for a in "xyz")) / 2 + 1e-3).alias("reach"))
    row = lambda r: [F.col(f"m{4 * r + i}") for i in range(4)]

    def inside(weights, offset):
        """Whether the sphere reaches the half-space sum(weight * camera axis) + offset >= 0."""
        plane = [sum(w * row(r)[i] for r, w in weights) for i in range(4)]
        value = sum(p * F.col(f"b{a}") for p, a in zip(plane, "xyz")) + plane[3] + offset
        return value + F.col("reach") * F.sqrt(sum(p * p for p in plane[:3])) >= -1e-6

    one = F.lit(1.0)
    front = inside([(2, one)], F.lit(0.0))
    perspective = F.lit(True)
    for r, f, c, n in ((0, "fx", "cx", "width"), (1, "fy", "cy", "height")):
        perspective = perspective & inside([(r, F.col(f)), (2, F.col(c) + 1)], F.lit(0.0)) & inside([(r, -F.col(f)), (2, F.col(n) - F.col(c))], F.lit(0.0))
    flat = F.lit(True)
    for r, n in ((0, "x"), (1, "y")):
        margin = (F.col(f"ortho_{n}_max") - F.col(f"ortho_{n}_min")) / F.greatest(F.col("width" if n == "x" else "height") - 1, F.lit(1))
        flat = flat & inside([(r, one)], margin - F.col(f"ortho_{n}_min")) & inside([(r, -one)], F.col(f"ortho_{n}_max") + margin)
    # a null (such as an unknown focal length) decides nothing
    return ball.join(v, "scene").where(front & F.coalesce(F.when(F.coalesce("ortho", F.lit(False)), flat).otherwise(perspective), F.lit(True))).drop("bx", "by", "bz", "reach")


def nearest_per_pixel(pixels: DataFrame) -> DataFrame:
    """The visible point of each pixel."""
    front = pixels.where(~F.col("ortho")).groupBy("view_idx", "u", "v").agg(F.min(F.struct("depth", "point_id")).alias("f"))
    return front.select("view_idx", F.col("f.point_id").alias("point_id"), "u", "v", F.col("f.depth").alias("depth")).unionByName(pixels.where("ortho").drop("ortho"))


def votes(seen: DataFrame, clusters: DataFrame, mask_id: Column, ignore: list[int] | None = None) -> DataFrame:
    """cluster, mask_id, n, first_view of the labels that the visible points of each cluster fall on."""
    rows = seen.withColumn("mask_id", mask_id).join(clusters, "point_id")
    if ignore:
        rows = rows.where(~F.col("mask_id").isin(ignore))
    return rows.groupBy("cluster", "mask_id").agg(F.count("*").alias("n"), F.min("view_idx").alias("first_view"))


def vote_stats(v: DataFrame, min_votes: int = 2000, min_ratio: float = 0.55, unknown: int = 255) -> DataFrame:
    """Per cluster: votes, first and second label with shares, entropy, and the accepted label.

    Equal counts go to the label that was seen in the earlier view, then to the lower label.
    """
    w = Window.partitionBy("cluster")
    order = w.orderBy(F.desc("n"), "first_view", "mask_id")
    r = v.withColumn("total", F.sum("n").over(w)).withColumn("rank", F.row_number().over(order)).withColumn("p", F.col("n") / F.col("total"))
    at = lambda k, c, d: F.coalesce(F.max(F.when(F.col("rank") == k, F.col(c))), F.lit(d))
    s = r.groupBy("cluster").agg(
        F.max("total").alias("total"), at(1, "mask_id", -1).alias("top1"), at(1, "p", 0.0).alias("top1_ratio"),
        at(2, "mask_id", -1).alias("top2"), at(2, "p", 0.0).alias("top2_ratio"), F.sum(-F.col("p") * F.ln("p")).alias("entropy"),
    )
    return s.withColumn("label", F.when((F.col("total") >= min_votes) & (F.col("top1_ratio") >= min_ratio), F.col("top1")).otherwise(unknown))
