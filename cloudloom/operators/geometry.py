"""Placement and fitting: camera rigs, orthographic bounds, voxel sizes, closing and filling of solids, meshes, similarity fits.

Defined results: groups without usable rows are absent; an empty set of voxels has no faces; a fit of fewer than three pairs raises.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..util import cut, drop
from .points import ranks
from .spatial import nearest_k
from .voxels import FACES, exposed_faces


def look_at(eye: list[Column], target: list[Column], up: tuple[float, float, float] = (0.0, 0.0, 1.0)) -> list[Column]:
    """World-to-view rows (12 numbers) of a camera at ``eye`` that looks at ``target``: x to the right, y down, z ahead. A camera that
    looks along ``up`` takes the first axis as its right."""
    d = [t - e for t, e in zip(target, eye)]
    n = F.sqrt(sum(x * x for x in d))
    z = [x / F.when(n > 0, n) for x in d]
    x = [z[1] * up[2] - z[2] * up[1], z[2] * up[0] - z[0] * up[2], z[0] * up[1] - z[1] * up[0]]
    m = F.sqrt(sum(c * c for c in x))
    x = [F.when(m > 1e-9, c / m).otherwise(F.lit(float(k == 0))) for k, c in enumerate(x)]
    y = [z[1] * x[2] - z[2] * x[1], z[2] * x[0] - z[0] * x[2], z[0] * x[1] - z[1] * x[0]]
    rows = []
    for axis in (x, y, z):
        rows += [*axis, -sum(a * e for a, e in zip(axis, eye))]
    return rows


def ring(boxes: DataFrame, n: int, levels: int, distance: float) -> DataFrame:
    """Cameras on rings around each box (x_min .. z_max): n per level, at ``distance`` half diagonals from its centre, all looking at it.
    Adds cam, level, ex, ey, ez and w2c."""
    mid = {a: (F.col(f"{a}_min") + F.col(f"{a}_max")) / 2 for a in "xyz"}
    half = F.sqrt(sum((F.col(f"{a}_max") - F.col(f"{a}_min")) ** 2 for a in "xyz")) / 2
    cams = boxes.select("*", F.explode(F.sequence(F.lit(0), F.lit(n * levels - 1))).alias("cam")).withColumn("level", F.floor(F.col("cam") / n).cast("int"))
    turn = 2 * np.pi * (F.col("cam") % n) / n
    height = F.col("z_min") + (F.col("z_max") - F.col("z_min")) * (F.col("level") + 1) / levels
    cams = cams.withColumns({"ex": mid["x"] + half * distance * F.cos(turn), "ey": mid["y"] + half * distance * F.sin(turn), "ez": height})
    return cams.withColumn("w2c", F.array(*look_at([F.col("ex"), F.col("ey"), F.col("ez")], [mid["x"], mid["y"], mid["z"]])))


def grid(boxes: DataFrame, step: float, above: float) -> DataFrame:
    """Cameras that look straight down from ``above`` over each box, ``step`` apart, row by row from the box's lower corner: adds cam, ex, ey, ez."""
    n = {a: F.greatest(F.ceil((F.col(f"{a}_max") - F.col(f"{a}_min")) / step), F.lit(1)).cast("int") for a in "xy"}
    cells = boxes.withColumn("_nx", n["x"]).withColumn("_ny", n["y"]).withColumn("cam", F.explode(F.expr("sequence(0, _nx * _ny - 1)")))
    ex, ey = F.col("x_min") + (F.col("cam") % F.col("_nx") + 0.5) * step, F.col("y_min") + (F.floor(F.col("cam") / F.col("_nx")) + 0.5) * step
    return cells.withColumns({"ex": ex, "ey": ey, "ez": F.col("z_max") + above}).drop("_nx", "_ny")


def ortho_bounds(boxes: DataFrame, pad: float = 0.05, aspect: float | None = None) -> DataFrame:
    """Orthographic window of each box, padded by a share of its extent; with ``aspect`` (width over height) the shorter side is widened
    about its centre. Adds ortho_x_min, ortho_x_max, ortho_y_min, ortho_y_max."""
    span = {a: (F.col(f"{a}_max") - F.col(f"{a}_min")) * (1 + 2 * pad) for a in "xy"}
    mid = {a: (F.col(f"{a}_min") + F.col(f"{a}_max")) / 2 for a in "xy"}
    if aspect is not None:
        span = {"x": F.greatest(span["x"], span["y"] * aspect), "y": F.greatest(span["y"], span["x"] / aspect)}
    return boxes.withColumns({f"ortho_{a}_{n}": mid[a] + s * span[a] / 2 for a in "xy" for n, s in (("min", -1), ("max", 1))})


def voxel_size(boxes: DataFrame, side: float, most: int, factor: float = 1.2) -> DataFrame:
    """Side of each box's grid: ``side`` times the least power of ``factor`` at which the grid has at most ``most`` cells. Adds side, cells."""
    cells = lambda s: F.aggregate(F.array(*[F.ceil((F.col(f"{a}_max") - F.col(f"{a}_min")) / s).cast("double") + 1 for a in "xyz"]), F.lit(1.0), lambda p, x: p * x)
    sides = F.transform(F.sequence(F.lit(0), F.lit(200)), lambda k: side * F.pow(F.lit(factor), k.cast("double")))
    return boxes.withColumn("side", F.get(F.filter(sides, lambda s: cells(s) <= most), F.lit(0))).withColumn("cells", cells(F.col("side")))


def _grown(voxels: DataFrame, by: list[str]) -> DataFrame:
    d = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(f, "xyz")]) for f in [(0, 0, 0), *FACES]])).alias("d")
    return voxels.select(*by, "i", "j", "k", d).select(*by, *[(F.col(c) + F.col(f"d.{n}")).alias(c) for c, n in zip("ijk", "xyz")]).distinct()


def close(voxels: DataFrame, by: list[str]) -> DataFrame:
    """Binary closing by the six neighbours: grown by one, then shrunk by one, which fills gaps of one voxel."""
    grown = _grown(voxels.select(*by, "i", "j", "k").distinct(), by)
    shift = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(f, "xyz")]) for f in [(0, 0, 0), *FACES]])).alias("d")
    near = grown.select(*by, "i", "j", "k", shift).select(*by, *[(F.col(c) + F.col(f"d.{n}")).alias(c) for c, n in zip("ijk", "xyz")])
    return near.groupBy(*by, "i", "j", "k").agg(F.count("*").alias("c")).where("c = 7").drop("c")


def fill(voxels: DataFrame, by: list[str]) -> DataFrame:
    """Voxels with their enclosed holes: the empty cells of the box around a group that a flood from outside doesn't reach."""
    full = cut(voxels.select(*by, "i", "j", "k").distinct())
    box = full.groupBy(*by).agg(*[F.min(c).alias(f"{c}0") for c in "ijk"], *[F.max(c).alias(f"{c}1") for c in "ijk"])
    cells = box
    for c in "ijk":
        cells = cells.withColumn(c, F.explode(F.sequence(F.col(f"{c}0") - 1, F.col(f"{c}1") + 1)))
    on = [*by, "i", "j", "k"]
    empty = cells.join(full, on, "left_anti")
    rim = F.lit(False)
    for c in "ijk":
        rim = rim | (F.col(c) < F.col(f"{c}0")) | (F.col(c) > F.col(f"{c}1"))
    empty = cut(empty.select(*on, rim.alias("wet")))
    dry = cut(empty.where(~F.col("wet")).select(*on))
    edge = empty.where("wet").select(*on)
    while True:
        reached = cut(dry.join(_grown(edge, by), on, "left_semi"))
        if reached.isEmpty():
            return full.unionByName(dry)
        left = cut(dry.join(reached, on, "left_anti"))
        drop(dry)
        dry, edge = left, reached


def shell(voxels: DataFrame, by: list[str]) -> DataFrame:
    """Voxels with a free face."""
    on = [*by, "i", "j", "k"]
    return voxels.select(*on).distinct().join(exposed_faces(voxels, by).select(*on), on, "left_semi")


def mesh(voxels: DataFrame, by: list[str], side: float) -> tuple[DataFrame, DataFrame]:
    """Free faces as triangles: vertices (by, vertex, x, y, z), equal corners being one, and triangles (by, face, half, a, b, c).

    Corners have whole coordinates, so equal ones meet in a group-by; numbers run from 0 within a group.
    """
    corners = {}
    for d in FACES:
        axis = next(k for k in range(3) if d[k])
        p, q = [k for k in range(3) if k != axis]
        loop = []
        for a, b in ((0, 0), (1, 0), (1, 1), (0, 1)):
            c = [0, 0, 0]
            c[axis], c[p], c[q] = int(d[axis] > 0), a, b
            loop.append(tuple(c))
        # seen from outside the corners run counter-clockwise
        turn = d[axis] * (1 if axis != 1 else -1)
        corners[d] = loop if turn > 0 else loop[::-1]
    faces = exposed_faces(voxels, by)
    pick = F.lit(None).cast("array<struct<x:int,y:int,z:int>>")
    for d, loop in corners.items():
        lit = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(c, "xyz")]) for c in loop])
        pick = F.when((F.col("dx") == d[0]) & (F.col("dy") == d[1]) & (F.col("dz") == d[2]), lit).otherwise(pick)
    quads = ranks(faces.select(*by, "i", "j", "k", "dx", "dy", "dz"), by, [F.col(c).asc() for c in ("i", "j", "k", "dx", "dy", "dz")])
    quads = quads.select(*by, (F.col("_rn") - 1).alias("face"), "i", "j", "k", F.posexplode(pick).alias("turn", "c"))
    quads = quads.select(*by, "face", "turn", *[(F.col(c) + F.col(f"c.{n}")).alias(n) for c, n in zip("ijk", "xyz")])
    numbered = ranks(quads.select(*by, "x", "y", "z").distinct(), by, [F.col(c).asc() for c in "xyz"]).withColumn("vertex", F.col("_rn") - 1)
    four = quads.join(numbered, [*by, "x", "y", "z"]).groupBy(*by, "face").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "vertex"))), lambda s: s["vertex"]).alias("q"))
    half = F.posexplode(F.array(F.array(F.lit(0), F.lit(1), F.lit(2)), F.array(F.lit(0), F.lit(2), F.lit(3)))).alias("half", "t")
    tri = four.select(*by, "face", "q", half)
    tri = tri.select(*by, "face", "half", *[F.get("q", F.col("t")[k]).alias(n) for k, n in enumerate("abc")])
    return numbered.select(*by, "vertex", *[(F.col(c) * side).alias(c) for c in "xyz"]), tri


def similarity_fit(pairs: DataFrame) -> tuple[float, np.ndarray, np.ndarray]:
    """Scale, rotation and shift that take (x, y, z) nearest to (tx, ty, tz) in the least squares; moments come from one aggregate, the
    3 x 3 decomposition is done on the driver."""
    a, b = ["x", "y", "z"], ["tx", "ty", "tz"]
    sums = [F.count("*"), *[F.avg(c) for c in a + b], *[F.avg(F.col(p) * F.col(q)) for p in a for q in b], F.avg(sum(F.col(c) ** 2 for c in a))]
    m = [float(v or 0) for v in pairs.agg(*[s.alias(f"s{k}") for k, s in enumerate(sums)]).first()]
    if m[0] < 3:
        raise ValueError("a fit needs three pairs")
    mean, to = np.array(m[1:4]), np.array(m[4:7])
    cov = np.array(m[7:16]).reshape(3, 3) - np.outer(mean, to)
    var = m[16] - (mean**2).sum()
    u, s, vt = np.linalg.svd(cov.T)
    sign = np.array([1.0, 1.0, np.sign(np.linalg.det(u @ vt)) or 1.0])
    rot = u @ np.diag(sign) @ vt
    scale = float((s * sign).sum() / var) if var > 0 else 1.0
    return scale, rot, to - scale * rot @ mean


def moved(df: DataFrame, scale: float, rot: np.ndarray, shift: np.ndarray) -> DataFrame:
    """x, y, z after scale, rotation and shift."""
    x = [F.col(c) for c in "xyz"]
    return df.withColumns({c: scale * sum(float(rot[k, j]) * x[j] for j in range(3)) + float(shift[k]) for k, c in enumerate("xyz")})


def align(source: DataFrame, target: DataFrame, key: str, radius: float, rounds: int = 5, trim: float = 0.8) -> tuple[float, np.ndarray, np.ndarray]:
    """Trimmed fit by closest points: each round pairs every source point with its nearest target point at any distance, keeps the
    share ``trim`` of nearest pairs and fits. Gives scale, rotation and shift of ``source``."""
    scale, rot, shift = 1.0, np.eye(3), np.zeros(3)
    one = F.lit(0).alias("_g")
    # written once: every round reads them again
    start, goal = cut(source.select(key, "x", "y", "z")), cut(target.select(one, key, "x", "y", "z"))
    for _ in range(rounds):
        near = nearest_k(moved(start.select(one, key, "x", "y", "z"), scale, rot, shift), key, ["_g"], radius, 1, others=goal)
        limit = near.agg(F.percentile("dist", F.lit(trim))).first()[0]
        pairs = near.where(F.col("dist") <= limit).select(F.col("a").alias(key), F.col("b").alias("_b"))
        pairs = pairs.join(start, key).join(goal.select(F.col(key).alias("_b"), F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("z").alias("tz")), "_b")
        scale, rot, shift = similarity_fit(pairs)
        drop(near)
    drop(start, goal)
    return scale, rot, shift
