"""Spatial joins on grids: boxes, nearest centres, neighbours within a radius, connected components, DBSCAN, column owners.

Defined results: rows with null coordinates take no part; distances include their limit; ties go to the lower id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from ..util import cut, drop, hot_keys, salted_join
from .points import ranks


def box_join(points: DataFrame, boxes: DataFrame, by: list[str], side: float) -> DataFrame:
    """Points in boxes (x_min .. z_max, borders included) through the cells that a box touches: an equi-join with a residual test."""
    b = boxes
    for a in "xy":
        b = b.withColumn(f"c{a}", F.explode(F.sequence(F.floor(F.col(f"{a}_min") / side), F.floor(F.col(f"{a}_max") / side))))
    p = points.withColumn("cx", F.floor(F.col("x") / side)).withColumn("cy", F.floor(F.col("y") / side))
    inside = F.lit(True)
    for a in "xyz":
        inside = inside & F.col(a).between(F.col(f"{a}_min"), F.col(f"{a}_max"))
    return p.join(b, [*by, "cx", "cy"]).where(inside).drop("cx", "cy")


def nearest_centre(rows: DataFrame, centres: list[list[float]], cols: list[str]) -> DataFrame:
    """Adds code and dist of the nearest of a few given centres (a literal array: no join); ties to the lower code."""
    scored = [
        F.struct(F.sqrt(sum((F.col(c).cast("double") - float(v)) ** 2 for c, v in zip(cols, centre))).alias("dist"), F.lit(k).alias("code")) for k, centre in enumerate(centres)
    ]
    return rows.withColumn("_b", F.array_min(F.array(*scored))).select(*rows.columns, "_b.code", "_b.dist")


def lloyd(rows: DataFrame, centres: list[list[float]], cols: list[str], rounds: int = 5) -> list[list[float]]:
    """Lloyd steps from given centres; an empty cluster becomes the zero vector. A round is one aggregate of one row per centre."""
    for _ in range(rounds):
        means = nearest_centre(rows, centres, cols).groupBy("code").agg(*[F.avg(c).alias(c) for c in cols]).collect()
        by = {r["code"]: [float(r[c]) for c in cols] for r in means}
        centres = [by.get(k, [0.0] * len(cols)) for k in range(len(centres))]
    return centres


def within(df: DataFrame, key: str, by: list[str], radius: float | str, axes: tuple[str, ...] = ("x", "y", "z"), side: float = 1.0) -> DataFrame:
    """Pairs (a, b, dist), a < b, of points of a group within a radius: each point asks in its 3^d neighbouring cells. The radius is a
    number or names a column with one positive number per group. With a ``side`` above 1, cells have so many radii, and a point asks
    only in those that its ball touches: fewer repeats of points, for more pairs to be tested; for few points a radius."""
    p = df.where(F.col(key).isNotNull()).select(*by, F.col(key).alias("a"), *axes, (F.col(radius) if isinstance(radius, str) else F.lit(float(radius))).alias("_r"))
    home = p.select("*", *[F.floor(F.col(x) / (F.col("_r") * side)).alias(f"c{x}") for x in axes])
    ask = home.select(*by, F.col("a").alias("b"), *[F.col(x).alias(f"q{x}") for x in axes], *[F.col(f"c{x}").alias(f"d{x}") for x in axes], *([F.col("_r").alias("_w")] if side > 1 else []))
    for x in axes:
        if side > 1:
            # a little more than the radius, for rounding
            reach = F.col("_w") * (1 + 1e-9) + F.abs(f"q{x}") * 1e-12
            touched = F.sequence(F.floor((F.col(f"q{x}") - reach) / (F.col("_w") * side)), F.floor((F.col(f"q{x}") + reach) / (F.col("_w") * side)))
        else:
            touched = F.array(*[F.col(f"d{x}") + k for k in (-1, 0, 1)])
        ask = ask.withColumn(f"c{x}", F.explode(touched)).drop(f"d{x}")
    ask = ask.drop("_w")
    d = F.sqrt(sum((F.col(x).cast("double") - F.col(f"q{x}").cast("double")) ** 2 for x in axes))
    return home.join(ask, [*by, *[f"c{x}" for x in axes]]).where("a < b").withColumn("dist", d).where(F.col("dist") <= F.col("_r")).select(*by, "a", "b", "dist")


#: Links of a task that are folded at a time, and nodes that a task holds before it passes them on.
FOLD, HELD = 1 << 18, 1 << 22
#: Graphs of at most so many folded links are finished in one task; the components do not depend on it.
LOCAL_LINKS = 2_000_000


def _lowest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links (a, b) and the lowest node that each is connected to."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    p = np.arange(len(ids))
    while len(a):
        low = np.minimum(a, b)
        np.minimum.at(p, np.maximum(a, b), low)
        while True:
            q = p[p]
            if np.array_equal(p, q):
                break
            p = q
        a, b = p[a], p[b]
        apart = a != b
        a, b = a[apart], b[apart]
    return ids, ids[p]


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) as fewer with the same components: each node that isn't the lowest of its links' component, with the lowest."""
    a = b = np.zeros(0, dtype=np.int64)
    more, n = [], 0
    for batch in batches:
        more.append([batch.column(k).to_numpy().astype(np.int64) for k in (0, 1)])
        n += batch.num_rows
        if n >= max(FOLD, len(a)):
            a, b = _lowest(*[np.concatenate([x, *[m[k] for m in more]]) for k, x in enumerate((a, b))])
            a, b, more, n = a[a != b], b[a != b], [], 0
            if len(a) > HELD:
                yield pa.record_batch({"a": a, "b": b})
                a = b = np.zeros(0, dtype=np.int64)
    if n:
        a, b = _lowest(*[np.concatenate([x, *[m[k] for m in more]]) for k, x in enumerate((a, b))])
        a, b = a[a != b], b[a != b]
    if len(a):
        yield pa.record_batch({"a": a, "b": b})


def components(nodes: DataFrame, edges: DataFrame, local_links: int = LOCAL_LINKS) -> DataFrame:
    """node, component (its lowest node), nodes and edges by whole numbers.

    Every task first folds its links to at most one a node. If at most ``local_links`` are left, one task folds these to the
    components; otherwise smallest labels with pointer jumping run over them until no label moves. Nodes with a hundredth of the rows
    or more are spread over tasks.
    """
    kind = dict(nodes.dtypes)["node"]
    links = edges.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b")).where("a is not null and b is not null")
    links = cut(links.mapInArrow(_fold, "a bigint, b bigint"))
    if links.count() <= local_links:
        low = cut(links.coalesce(1).mapInArrow(_fold, "a bigint, b bigint"))
        drop(links)
        named = nodes.select(F.col("node").cast("bigint").alias("node")).distinct().join(low.withColumnRenamed("a", "node"), "node", "left")
        return named.select(F.col("node").cast(kind).alias("node"), F.coalesce("b", "node").cast(kind).alias("component"))
    both = cut(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    drop(links)
    busy = hot_keys(both, "b")
    label = cut(nodes.select(F.col("node").cast("bigint").alias("node")).distinct().select("node", F.col("node").alias("component"), F.lit(True).alias("moved")))
    while True:
        near = salted_join(both, label.select(F.col("node").alias("b"), "component"), ["b"], hot=busy).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("low"))
        step = cut(label.join(near, "node", "left").select("node", "component", F.least("component", "low").alias("to")))
        hop = label.select(F.col("node").alias("to"), F.col("component").alias("root"))
        new = salted_join(step, hop, ["to"], "left", hot=hot_keys(step, "to")).select("node", F.least("to", "root").alias("component"), (F.least("to", "root") < F.col("component")).alias("moved"))
        new = cut(new)
        drop(label, step)
        label = new
        if label.where("moved").isEmpty():
            drop(both)
            return label.select(F.col("node").cast(kind).alias("node"), F.col("component").cast(kind).alias("component"))


def dbscan(df: DataFrame, key: str, by: list[str], eps: float | str, min_samples: int, side: float = 1.0) -> DataFrame:
    """key, component: DBSCAN. A core point has ``min_samples`` points within eps, itself included; a border point joins the component
    with the lowest number among its core neighbours; noise has component null. ``eps`` may name a column (see ``neighbour_eps``), ``side`` is that of ``within``."""
    pairs = cut(within(df, key, by, eps, side=side).select("a", "b"))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    core = cut(both.groupBy("a").agg((F.count("*") + 1).alias("n")).where(F.col("n") >= min_samples).select(F.col("a").alias("node")))
    if min_samples <= 1:
        core = df.where(F.col(key).isNotNull()).select(F.col(key).alias("node")).distinct()
    inner = pairs.join(core.select(F.col("node").alias("a")), "a", "left_semi").join(core.select(F.col("node").alias("b")), "b", "left_semi")
    comp = components(core, inner)
    border = both.join(comp.select(F.col("node").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("near"))
    keys = df.where(F.col(key).isNotNull()).select(F.col(key).alias("node")).distinct()
    out = keys.join(comp, "node", "left").join(border.withColumnRenamed("a", "node"), "node", "left")
    return out.select(F.col("node").alias(key), F.coalesce("component", "near").alias("component"))


def relabel(df: DataFrame, label: str, min_size: int, by: list[str]) -> DataFrame:
    """Contiguous labels 1..N of the groups of at least ``min_size`` rows, in ascending order of the old label; others 0."""
    keep = df.groupBy(*by, label).agg(F.count("*").alias("_n")).where((F.col("_n") >= min_size) & F.col(label).isNotNull())
    new = keep.withColumn("new_label", F.dense_rank().over(Window.partitionBy(*by).orderBy(label))).drop("_n")
    return df.join(new, [*by, label], "left").withColumn("new_label", F.coalesce("new_label", F.lit(0)))


def column_owner(df: DataFrame, by: list[str], label: str, side: float) -> DataFrame:
    """Owner of each column (cx, cy): the largest of the labels in it, ties to the lower label."""
    size = df.where(F.col(label) > 0).groupBy(*by, label).agg(F.count("*").alias("size"))
    cells = df.where(F.col(label) > 0).select(*by, label, F.floor(F.col("x") / side).alias("cx"), F.floor(F.col("y") / side).alias("cy")).distinct()
    return cells.join(size, [*by, label]).groupBy(*by, "cx", "cy").agg(F.min(F.struct((-F.col("size")).alias("s"), F.col(label).alias("owner")))["owner"].alias("owner"))


#: Points of a group to choose from that a task holds at a time, and points of a leaf.
SLAB, LEAF = 1 << 18, 48


def _kd(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the points x (n, 3) in which neighbours stand together, and the starts of its leaves: halves of the widest axis."""
    order, starts = np.arange(len(x)), np.zeros(1, dtype=np.int64)
    while (size := np.diff(np.r_[starts, len(x)])).max() > LEAF:
        p = x[order]
        axis = (np.maximum.reduceat(p, starts, axis=0) - np.minimum.reduceat(p, starts, axis=0)).argmax(axis=1)
        leaf = np.repeat(np.arange(len(starts)), size)
        order = order[np.lexsort((p[np.arange(len(p)), axis[leaf]], leaf))]
        starts = np.union1d(starts, (starts + size // 2)[size > LEAF])
    return order, starts


def _distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Distances of the rows of q to those of x, summed over the axes in their order as SQL does."""
    d = np.zeros((len(q), len(x)))
    for j in range(3):
        d += (q[:, j, None] - x[None, :, j]) ** 2
    return np.sqrt(d, out=d)


def _nearest(q: np.ndarray, x: np.ndarray, number: np.ndarray, own: np.ndarray | None, k: int, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Place in q, place in x, distance and rank of the up to k rows of x nearest to each row of q and no farther than ``most``; ties go to
    the lower ``number`` of x. A row of x whose number is the query's ``own`` is left out.

    A leaf of queries first meets the leaves nearest to it, which bounds how far its neighbours lie, then the leaves within that.
    """
    order, starts = _kd(x)
    x, number, size = x[order], number[order], np.diff(np.r_[starts, len(x)])
    low, high = np.minimum.reduceat(x, starts, axis=0).T, np.maximum.reduceat(x, starts, axis=0).T
    q_order, q_starts = _kd(q)
    few = min(len(starts), 4 + 2 * k // LEAF)
    out = []
    for s, e in zip(q_starts, np.r_[q_starts[1:], len(q)]):
        mine = q_order[s:e]
        p = q[mine]
        far = most[mine].max()
        if len(starts) > few:
            a, b = p.min(axis=0), p.max(axis=0)
            gap = np.sqrt(sum(np.maximum(np.maximum(low[j] - b[j], a[j] - high[j]), 0.0) ** 2 for j in range(3))) * (1 - 1e-9)
            first = np.argpartition(gap, few - 1)[:few]
            at = np.concatenate([np.arange(starts[i], starts[i] + size[i]) for i in first])
            if len(at) > k:
                # one more, as a point is not its own neighbour
                d = np.partition(_distances(p, x[at]), k, axis=1)[:, k]
                far = min(far, d.max())
            near = np.flatnonzero(gap <= far)
            if not len(near):
                continue
            at = np.repeat(starts[near] - np.r_[0, np.cumsum(size[near])[:-1]], size[near]) + np.arange(size[near].sum())
        else:
            at = np.arange(len(x))
        d = _distances(p, x[at])
        ok = d <= most[mine][:, None]
        kth = k - 1
        if own is not None:
            ok &= number[at][None, :] != own[mine][:, None]
            kth = k
        if len(at) > kth:
            ok &= d <= np.partition(d, kth, axis=1)[:, kth][:, None]
        row, col = np.nonzero(ok)
        sort = np.lexsort((number[at][col], d[row, col], row))
        row, col = row[sort], col[sort]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        keep = rank < k
        row, col = row[keep], col[keep]
        out.append((mine[row], order[at[col]], d[row, col], rank[keep] + 1))
    if not out:
        return tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, float, np.int64))
    return tuple(np.concatenate(c) for c in zip(*out))


def _neighbours_of(table: pa.Table, apart: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Neighbours of the queries of a slab (rows with ``want``) among its points (rows with ``point``; most rows are both), and each query
    whose neighbours may lie in another slab once more without a neighbour, with its place and reach. ``apart``: an equal id is no query's own."""
    asks, points = table.filter(table.column("want").is_valid()), table.filter(table.column("point"))
    place = lambda t: np.column_stack([t.column(a).to_numpy() for a in "xyz"])
    q, x = place(asks), place(points)
    want, most = asks.column("want").to_numpy(), asks.column("reach").to_numpy()
    left, right = asks.column("left").to_numpy(), asks.column("right").to_numpy()
    ids, names = asks.column("a").combine_chunks(), points.column("a").combine_chunks()
    _, number = np.unique(np.concatenate([names.to_numpy(zero_copy_only=False), ids.to_numpy(zero_copy_only=False)]), return_inverse=True)
    number, own = number[: len(names)], None if apart else number[len(names) :]
    got = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0, dtype=np.int64))
    most_wanted = int(want.max()) if len(want) else 0
    # so many queries at a time that their neighbours fit
    step = max(1, (1 << 21) // max(most_wanted, 1))
    order = np.argsort(q[:, 0], kind="stable") if len(q) > step else np.arange(len(q))
    for s in range(0, len(q), step):
        mine = order[s : s + step]
        if len(x):
            i, j, d, rank = _nearest(q[mine], x, number, None if own is None else own[mine], most_wanted, most[mine])
            i = mine[i]
            keep = rank <= want[i]
            got = tuple(c[keep] for c in (i, j, d, rank))
        i, j, d, rank = got
        reach = most.copy()
        last = rank == want[i]
        reach[i[last]] = d[last]
        # slabs hold their left border; where there is none, there is no other slab
        wide = reach * (1 + 1e-9)
        with np.errstate(over="ignore"):
            crosses = ((q[:, 0] - wide < left) & (left > -np.inf)) | ((q[:, 0] + wide >= right) & (right < np.inf))
        again = mine[crosses[mine]]
        n, m = len(i), len(again)
        none = pa.nulls(m, names.type)
        columns = [
            pa.concat_arrays([ids.take(pa.array(i)), ids.take(pa.array(again))]), pa.concat_arrays([names.take(pa.array(j)), none]),
            pa.array(np.r_[d, reach[again]]), pa.array(np.r_[rank, want[again]].astype(np.int32)), pa.array(np.r_[crosses[i], np.ones(m, dtype=bool)]),
            *[pa.concat_arrays([pa.nulls(n, pa.float64()), pa.array(q[again, k])]) for k in range(3)],
            *[pa.concat_arrays([pa.nulls(n, asks.schema.field(c).type), asks.column(c).combine_chunks().take(pa.array(again))]) for c in schema.names[8:]],
        ]
        yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)


def _slabs(batches: Iterator[pa.RecordBatch], key: list[str], apart: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """``_neighbours_of`` on each stretch of rows of equal ``key``."""
    held: list[pa.RecordBatch] = []
    name = None
    for batch in batches:
        if not batch.num_rows:
            continue
        code = np.stack([batch.column(c).dictionary_encode().indices.to_numpy() for c in key])
        starts = np.flatnonzero(np.r_[True, (code[:, 1:] != code[:, :-1]).any(axis=0)])
        for at, size in zip(starts, np.diff(np.r_[starts, batch.num_rows])):
            piece = batch.slice(int(at), int(size))
            its = tuple(piece.column(c)[0].as_py() for c in key)
            if its != name and held:
                yield from _neighbours_of(pa.Table.from_batches(held), apart, schema)
                held = []
            name = its
            held.append(piece)
    if held:
        yield from _neighbours_of(pa.Table.from_batches(held), apart, schema)


def nearest_k(df: DataFrame, key: str, by: list[str], radius: float, k: int | Callable[[Column], Column], others: DataFrame | None = None, slab: int = SLAB) -> DataFrame:
    """The k nearest others of each point of its group: a, b, dist, rank; ties to the lower id. Fewer only where the group has fewer.

    With ``others`` (the same columns) the nearest are taken from these instead, equal ids included. ``k`` may be an expression of the
    group's number of points to choose from, such as its root. ``radius`` is a guess of the distance; the result doesn't depend on it.

    Groups of more than ``slab`` points to choose from are cut into slabs of about so many along x. Every point looks in its own slab
    first; only those whose farthest neighbour lies beyond its borders, or that found too few, ask in the slabs that their reach touches.
    No point is repeated, only the groups with more than one slab are looked up for it, and nothing goes to the driver but counts.
    """
    spark, apart = df.sparkSession, others is not None

    def placed(rows: DataFrame) -> DataFrame:
        for c in (key, *by):
            rows = rows.where(F.col(c).isNotNull())
        for x in "xyz":
            rows = rows.where(F.col(x).isNotNull() & ~F.isnan(x) & (F.abs(F.col(x).cast("double")) < float("inf")))
        return cut(rows.select(*by, F.col(key).alias("a"), *[F.col(x).cast("double").alias(x) for x in "xyz"]))

    p = placed(df)
    pool = p if others is None else placed(others)
    own = F.ceil(F.col("_n") / slab)
    # a point of a group of n points has n - 1 others, so it waits for no more
    n = F.col("_n") - (1 if others is None else 0)
    sizes = cut(pool.groupBy(*by).agg(F.count("*").alias("_n")))
    most, groups = sizes.agg(F.max("_n"), F.sum(own)).first()
    parts = -(-(most or 1) // slab)
    want = sizes.select(*by, "_n", F.least(n, k(F.col("_n")).cast("bigint") if callable(k) else F.lit(k)).cast("int").alias("want"))
    none = F.array().cast("array<double>")
    if parts > 1:
        # borders that part a group evenly into the slabs of the largest; smaller groups take every so many of them
        large = cut(want.where(own > 1))
        edges = pool.join(large, by).groupBy(*by, "_n", "want").agg(F.percentile_approx("x", [i / parts for i in range(1, parts)]).alias("_e"))
        pick = F.transform(F.sequence(F.lit(1), F.greatest(own - 1, F.lit(1)).cast("int")), lambda i: F.element_at("_e", F.greatest(F.lit(1), F.least(F.lit(parts - 1), F.round(i * parts / own).cast("int")))))
        sliced = cut(edges.select(*by, "want", F.array_distinct(pick).alias("_e")))
        drop(large)
    which = lambda x: F.size(F.filter("_e", lambda e: e <= x))
    border = lambda i, end: F.coalesce(F.get("_e", i), F.lit(end))
    inf = float("inf")
    cols = [*by, "_s", "a", "x", "y", "z", "want", "reach", "left", "right", "point"]

    def told(rows: DataFrame) -> DataFrame:
        """With the number of neighbours wanted, and the borders of the group's slabs. A group in one slab stands whole in its task, so a fixed number isn't looked up."""
        if callable(k):
            rows = rows.join(want.drop("_n"), by)
            return rows.join(sliced.drop("want"), by, "left").withColumn("_e", F.coalesce("_e", none)) if parts > 1 else rows.withColumn("_e", none)
        rows = rows.join(sliced, by, "left") if parts > 1 else rows.withColumns({"want": F.lit(None).cast("int"), "_e": none})
        return rows.withColumns({"want": F.coalesce("want", F.lit(k)), "_e": F.coalesce("_e", none)})

    def points(rows: DataFrame) -> DataFrame:
        void = {"want": F.lit(None).cast("int"), **{c: F.lit(None).cast("double") for c in ("reach", "left", "right")}, "point": F.lit(True)}
        return rows.withColumn("_s", which(F.col("x"))).withColumns(void).select(*cols)

    ask = told(p).withColumn("_s", which(F.col("x")))
    ask = ask.withColumns({"want": F.when(F.col("want") > 0, F.col("want")), "reach": F.lit(inf), "left": border(F.col("_s") - 1, -inf), "right": border(F.col("_s"), inf), "point": F.lit(not apart)}).select(*cols)
    on = [*by, "_s"]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(int(groups or 1), 8 * spark.sparkContext.defaultParallelism))
    schema = StructType([StructField("a", p.schema["a"].dataType), StructField("b", p.schema["a"].dataType), *StructType.fromDDL("dist double, rank int, open boolean, x double, y double, z double").fields, *[p.schema[c] for c in by]])
    arrow = to_arrow_schema(schema)

    def look(rows: DataFrame) -> DataFrame:
        return rows.repartition(tasks, *on).sortWithinPartitions(*on).mapInArrow(lambda batches: _slabs(batches, on, apart, arrow), schema)

    found = look(points(told(pool)).unionByName(ask.where("want is not null")) if apart else ask)
    if parts == 1:
        out = cut(found.where("b is not null").select("a", "b", "dist", "rank"))
    else:
        found = cut(found)
        # without a neighbour: the queries that go on, dist being their reach and rank what they want
        more = found.where("b is null").join(sliced.drop("want"), by).withColumn("_own", which(F.col("x")))
        wide = F.col("dist") * (1 + 1e-9)
        more = more.withColumn("_s", F.explode(F.sequence(which(F.col("x") - wide), which(F.col("x") + wide)))).where("_s <> _own")
        more = more.select(*by, "_s", "a", "x", "y", "z", F.col("rank").alias("want"), F.col("dist").alias("reach"), F.lit(-inf).alias("left"), F.lit(inf).alias("right"), F.lit(False).alias("point"))
        again = look(points(pool.join(sliced.drop("want"), by)).unionByName(more))
        both = found.where("open and b is not null").select("a", "b", "dist").unionByName(again.where("b is not null").select("a", "b", "dist"))
        wanted = found.where("b is null").select("a", F.col("rank").alias("want"))
        ranked = both.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy("dist", "b"))).join(wanted, "a").where("rank <= want").drop("want")
        ranked = cut(ranked)
        # most rows are final where they were found, and aren't written again
        out = found.where("not open").select("a", "b", "dist", "rank").unionByName(ranked)
        out._cut_parts = (found, ranked)
        drop(sliced)
    drop(p, pool, sizes)
    return out


def neighbour_eps(df: DataFrame, key: str, by: list[str], k: int, quantile: float, start: float, least: float = 1e-4) -> DataFrame:
    """One eps per group: the quantile, interpolated, of its points' distances to their k-th nearest other (the farthest in groups of k
    or fewer); ``least`` where it is 0 or the group has one point. Two ranks of a group are picked, so no group stands in one task.
    ``start`` is where the search for neighbours starts."""
    near = nearest_k(df, key, by, start, k)
    groups = df.where(F.col(key).isNotNull()).select(*by, F.col(key).alias("a"))
    last = cut(near.groupBy("a").agg(F.max("dist").alias("dist")).join(groups, "a").select(*by, "a", "dist"))
    place = last.groupBy(*by).agg(((F.count("*") - 1) * quantile).alias("_place"))
    at = ranks(last, by, [F.col("dist").asc(), F.col("a").asc()]).join(place, by).withColumn("_i", F.col("_rn") - 1)
    low, high = F.floor("_place"), F.ceil("_place")
    two = at.where((F.col("_i") == low) | (F.col("_i") == high)).groupBy(*by).agg(F.min("dist").alias("lo"), F.max("dist").alias("hi"), F.first(F.col("_place") - low).alias("part"))
    eps = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("part")
    return groups.select(*by).distinct().join(two, by, "left").select(*by, F.when(eps > 0, eps).otherwise(least).alias("eps"))


def sparse_outliers(neighbours: DataFrame, times: float = 1.0) -> DataFrame:
    """Points whose mean squared neighbour distance reaches mean + times * deviation over all neighbours: a, mean_d2."""
    d2 = neighbours.withColumn("d2", F.col("dist") * F.col("dist"))
    limit = d2.agg((F.avg("d2") + times * F.stddev_samp("d2")).alias("t")).first()["t"]  # one number
    mean = d2.groupBy("a").agg(F.avg("d2").alias("mean_d2"))
    return mean.where(F.col("mean_d2") >= F.lit(limit)) if limit is not None else mean.limit(0)
