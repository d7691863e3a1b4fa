"""Clusters of mutually similar records by bisecting k-means (problem 2).

Every node that isn't compact is split in two by 2-means, from the same start points (a quarter of the range beside the mean on the widest axis) by the same steps whether the node's rows are
spread over the cluster or stand in one task: coordinates are taken as whole multiples of a grid step, so sums are exact and do not
depend on their order, and the leaves are the same for every ``local_rows``. Large nodes are split in rounds of group-bys over all
rows with one row per node as result, small ones in a task each. As the limit has to hold for every leaf, every node that isn't
compact is split in the end; the order, such as the largest dispersion first, changes no leaf, so all open nodes are split in one round.

A leaf is compact when no member lies farther than the limit from its anchor, the member of the lowest id. A split may cut a cluster,
so leaves whose anchors lie within the limit are put together again (a grid join of anchors, then components); a component stays whole
only if all its anchors lie within the limit of each other, else its leaves stay apart.

Defined results: vectors that are null, short, non-finite or all zero take no part; repeated rows of a key are one record; equal
vectors are in one cluster; ties of typical members go to the lower id; without usable vectors there are no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.spatial import components
from ..util import cut, drop, hot_keys, salted_join

#: A node of at most so many rows is finished in one task; the leaves do not depend on it.
LOCAL_ROWS = 50_000
#: 2-means steps of a split.
STEPS = 3
#: Tasks a core in which a pass of a round reads the rows, at most. A pass streams, so larger tasks take no more memory, while every
#: task leaves its record with the driver: with one for each file of 8 MB, 14 rounds over 6 GB left some 50,000.
TASKS = 16
#: Side of a cell of the anchors' grid, in limits.
CELL = 8.0
#: Steps of the coordinates' grid in a limit.
GRID = 1 << 16


def usable(df: DataFrame, key: str, vector: str, dims: int) -> DataFrame:
    """One row per key: id, f0..fN in the vector's own type. Of repeated rows of a key the greatest vector counts."""
    v = F.col(vector)
    good = (F.size(v) == dims) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    one = df.where(F.col(key).isNotNull() & good).groupBy(F.col(key).cast("bigint").alias("id")).agg(F.max(v).alias("v"))
    return one.select("id", *[F.col("v")[j].alias(f"f{j}") for j in range(dims)])


def _sq(dims: int, a: str, b: str):
    return sum((F.col(f"{a}{j}").cast("double") - F.col(f"{b}{j}").cast("double")) ** 2 for j in range(dims))


def split_round(rows: DataFrame, dims: int, reach: float, local_rows: int) -> tuple[DataFrame, bool]:
    """One round over rows (id, node, open, x*; whole coordinates): every open node is measured and, if it isn't compact, split in two.

    ``open`` is 2 for a node to be measured, 1 for a node left to one task, 0 for a leaf. Gives the rows with new nodes, and whether
    any is still to be measured. The 2-means start a quarter of the range beside the mean on the widest axis. A pass is a hash
    aggregation of whole sums and extremes with one row per node as result. A node's number is a hash of its path; should two collide,
    they are measured as one node and split again.
    """
    rows = rows.coalesce(TASKS * rows.sparkSession.sparkContext.defaultParallelism)
    todo = rows.where("open = 2")
    x = [f"x{j}" for j in range(dims)]
    stats = todo.groupBy("node").agg(F.count("*").alias("n"), *[g(c).alias(f"{k}{j}") for j, c in enumerate(x) for k, g in (("s", F.sum), ("l", F.min), ("h", F.max))])
    width = [F.col(f"h{j}") - F.col(f"l{j}") for j in range(dims)]
    widest = F.greatest(*width) if dims > 1 else width[0]
    axis = F.array_position(F.array(*width), widest) - 1
    quarter = [F.when(axis == j, widest / 4.0).otherwise(0.0) for j in range(dims)]
    mean = [F.col(f"s{j}") / F.col("n") for j in range(dims)]
    diagonal = F.sqrt(sum((w.cast("double") ** 2 for w in width), F.lit(0.0)))
    # within this box a node may be compact or not; a larger box can't hold a compact node, a smaller one no other
    near = F.when(diagonal <= reach, 0).when(diagonal > 2 * reach * float(np.sqrt(dims)), 2).otherwise(1)
    centres = cut(stats.select("node", "n", near.alias("near"), *[(m - q).alias(f"b{j}") for j, (m, q) in enumerate(zip(mean, quarter))], *[(m + q).alias(f"c{j}") for j, (m, q) in enumerate(zip(mean, quarter))]))
    # nodes with a hundredth of the rows or more, at most a hundred
    total = centres.agg(F.sum("n")).first()[0] or 0
    hot = [r["node"] for r in centres.where(F.col("n") > total * 0.01).select("node").collect()]
    doubtful = centres.where((F.col("near") == 1) & (F.col("n") > local_rows))
    small = F.lit(False)
    if not doubtful.isEmpty():
        # the anchor is the member of the lowest id
        mine = todo.join(doubtful.select("node"), "node")
        anchor = mine.groupBy("node").agg(F.min(F.struct("id", *x)).alias("a")).select("node", *[F.col(f"a.x{j}").alias(f"a{j}") for j in range(dims)])
        far = salted_join(mine, anchor, ["node"], hot=hot).groupBy("node").agg((F.sqrt(F.max(_sq(dims, "x", "a"))) <= reach).alias("tight"))
        centres, old = cut(centres.join(far, "node", "left")), centres
        drop(old)
        small = F.coalesce("tight", F.lit(False))
    state = F.when((F.col("near") == 0) | small, 0).when(F.col("n") <= local_rows, 1).otherwise(2)
    centres, old = cut(centres.select("node", state.alias("state"), *[f"{c}{j}" for c in "bc" for j in range(dims)])), centres
    drop(old)
    again = not centres.where("state = 2").isEmpty()
    side = (_sq(dims, "x", "c") < _sq(dims, "x", "b")).cast("int")
    for _ in range(STEPS - 1 if again else 0):
        # whole sums over whole counts are the same in any order
        sums = salted_join(todo, centres.where("state = 2").drop("state"), ["node"], hot=hot).withColumn("side", side).groupBy("node").agg(
            *[F.sum(F.when(F.col("side") == s, F.col(c))).alias(f"{'bc'[s]}s{j}") for s in (0, 1) for j, c in enumerate(x)],
            *[F.count(F.when(F.col("side") == s, 1)).alias(f"{'bc'[s]}n") for s in (0, 1)],
        )
        better = [F.when(F.col(f"{c}n") > 0, F.col(f"{c}s{j}") / F.col(f"{c}n")).otherwise(F.col(f"{c}{j}")).alias(f"{c}{j}") for c in "bc" for j in range(dims)]
        centres, old = cut(centres.join(sums, "node", "left").select("node", "state", *better)), centres
        drop(old)
    moved = salted_join(todo, centres, ["node"], hot=hot)
    child = F.when(F.col("state") < 2, F.col("node")).otherwise(F.xxhash64("node", side))
    out = cut(rows.where("open < 2").select("id", "node", "open", *x).unionByName(moved.select("id", child.alias("node"), F.col("state").alias("open"), *x)))
    drop(centres)
    return out, again


def _distance(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances, summed over the axes in their order as the SQL does."""
    out = np.zeros(len(x))
    for j in range(x.shape[1]):
        out = out + (x[:, j] - c[:, j]) ** 2
    return out


def _bisect(ids: np.ndarray, x: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Ids and their leaf (its lowest id), by the splits of ``split_round`` on all open nodes at a time."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    leaf = np.zeros(len(ids), dtype=np.int64)
    rows, node = np.arange(len(ids)), np.zeros(len(ids), dtype=np.int64)
    while len(rows):
        order = np.argsort(node, kind="stable")  # rows stay in the order of their ids within a node
        rows, node = rows[order], node[order]
        start = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        size = np.diff(np.r_[start, len(rows)])
        which = np.repeat(np.arange(len(start)), size)
        p = x[rows]

        top = np.maximum.reduceat(_distance(p, p[start][which]), start)
        compact = np.sqrt(top) <= reach
        leaf[rows] = np.where(compact[which], ids[rows[start]][which], leaf[rows])
        go = ~compact[which]
        if not go.any():
            break
        rows, p, which = rows[go], p[go], which[go]
        _, which = np.unique(which, return_inverse=True)
        start = np.flatnonzero(np.r_[True, which[1:] != which[:-1]])
        size = np.diff(np.r_[start, len(rows)])
        low, high = np.minimum.reduceat(p, start, axis=0), np.maximum.reduceat(p, start, axis=0)
        mean = np.add.reduceat(p, start, axis=0) / size[:, None]
        axis = (high - low).argmax(axis=1)
        quarter = np.zeros(mean.shape)
        quarter[np.arange(len(axis)), axis] = (high - low)[np.arange(len(axis)), axis] / 4.0
        b, c = mean - quarter, mean + quarter
        for step in range(STEPS):
            side = _distance(p, c[which]) < _distance(p, b[which])
            if step + 1 < STEPS:
                # whole numbers below 2^53 add up exactly
                n_c = np.add.reduceat(side.astype(float), start)[:, None]
                s_c = np.add.reduceat(p * side[:, None], start, axis=0)
                s_all = np.add.reduceat(p, start, axis=0)
                n_b = size[:, None] - n_c
                b = np.where(n_b > 0, (s_all - s_c) / np.maximum(n_b, 1), b)
                c = np.where(n_c > 0, s_c / np.maximum(n_c, 1), c)
        node = which * 2 + side
    return ids, leaf


def leaves(rows: DataFrame, dims: int, limit: float, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """Leaf of each row: id, leaf BIGINT (the leaf's lowest id). The limit is shortened by the diagonal of a grid step, so that no
    rounding lets a member lie farther than the limit from its anchor."""
    step = limit / GRID
    x = [f"x{j}" for j in range(dims)]
    whole = [F.rint(F.col(f"f{j}").cast("double") / step).cast("bigint").alias(x[j]) for j in range(dims)]
    reach = limit / step - np.sqrt(dims)
    state, more = cut(rows.select("id", F.lit(1).cast("bigint").alias("node"), F.lit(2).alias("open"), *whole)), True
    while more:
        (state, more), old = split_round(state, dims, reach, local_rows), state
        drop(old)

    def finish(key, table):
        ids, leaf = _bisect(table.column("id").to_numpy(), np.column_stack([table.column(c).to_numpy().astype(float) for c in x]), reach)
        return pa.table({"id": ids, "leaf": leaf})

    small = state.where("open = 1").select("node", "id", *x).groupBy("node").applyInArrow(finish, "id bigint, leaf bigint")
    done = state.where("open = 0").select("id", "node")
    name = done.groupBy("node").agg(F.min("id").alias("leaf"))
    return salted_join(done, name, ["node"], hot=hot_keys(state, "node")).select("id", "leaf").unionByName(small)


def join_leaves(anchors: DataFrame, dims: int, limit: float) -> DataFrame:
    """leaf and cluster of anchors (leaf, f*): leaves whose anchors lie within the limit get one label.

    Each anchor stands in the one cell of a grid where it lies and asks in all cells that its box of the limit's size touches.
    """
    side = CELL * limit
    home = anchors.withColumn("cell", F.xxhash64(*[F.floor(F.col(f"f{j}") / side) for j in range(dims)]))
    ask = anchors
    for j in range(dims):
        low, high = F.floor((F.col(f"f{j}") - limit) / side), F.floor((F.col(f"f{j}") + limit) / side)
        ask = ask.withColumn(f"c{j}", F.explode(F.sequence(low, high)))
    ask = ask.select(F.col("leaf").alias("other"), F.xxhash64(*[F.col(f"c{j}") for j in range(dims)]).alias("cell"), *[F.col(f"f{j}").alias(f"g{j}") for j in range(dims)])
    near = (F.sqrt(_sq(dims, "f", "g")) <= limit) & (F.col("leaf") != F.col("other"))
    links = cut(home.join(ask, "cell").where(near).select("leaf", "other").distinct())
    label = anchors.select("leaf", F.col("leaf").alias("cluster"))
    if links.isEmpty():
        return label
    linked = cut(components(links.select(F.col("leaf").alias("node")).distinct(), links.where("leaf < other").select(F.col("leaf").alias("a"), F.col("other").alias("b"))))
    # all anchors of a component lie within the limit of each other if each has links to all others
    size = linked.groupBy("component").agg(F.count("*").alias("n"))
    count = links.join(linked.select(F.col("node").alias("leaf"), "component"), "leaf").groupBy("component").agg(F.count("*").alias("m"))
    whole = size.join(count, "component").where(F.col("m") == F.col("n") * (F.col("n") - 1)).select("component")
    good = linked.join(whole, "component").select(F.col("node").alias("leaf"), F.col("component").alias("low"))
    return label.join(good, "leaf", "left").select("leaf", F.coalesce("low", "cluster").alias("cluster"))


def cluster(df: DataFrame, key: str, vector: str, dims: int, limit: float, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """Members: id, f*, cluster BIGINT (its lowest id)."""
    f = [f"f{j}" for j in range(dims)]
    rows = cut(usable(df, key, vector, dims))
    leaf = cut(leaves(rows, dims, limit, local_rows))
    anchors = cut(rows.join(leaf.where("id = leaf"), "id").select("leaf", *f))
    merged = cut(join_leaves(anchors, dims, limit))
    moved = merged.where("cluster <> leaf")
    named = salted_join(leaf, moved, ["leaf"], "left", hot=hot_keys(leaf, "leaf")).select("id", F.coalesce("cluster", "leaf").alias("cluster"))
    return rows.join(named, "id").select("id", "cluster", *f)


def chain(members: DataFrame, group: str = "cluster", key: str = "id", width: int = 1 << 16) -> DataFrame:
    """Neighbouring pairs (a, b) of each group's members in ascending order.

    A group is cut into ranges of ids, each a window of its own; the first of a range follows the last of the range before.
    """
    rng = members.select(group, key, F.floor(F.col(key) / width).alias("r"))
    inner = rng.withColumn("a", F.lag(key).over(Window.partitionBy(group, "r").orderBy(key)))
    ends = rng.groupBy(group, "r").agg(F.min(key).alias("first"), F.max(key).alias("last"))
    across = ends.withColumn("a", F.lag("last").over(Window.partitionBy(group).orderBy("r"))).select("a", F.col("first").alias("b"))
    return inner.select("a", F.col(key).alias("b")).unionByName(across).where(F.col("a").isNotNull())


def describe(members: DataFrame, dims: int, typical: int = 5) -> DataFrame:
    """Per cluster: first_id (its lowest id), size, dispersion (mean squared distance to the centre), radius and the ids of the most typical members."""
    f = [f"f{j}" for j in range(dims)]
    centre = members.groupBy("cluster").agg(F.count("*").alias("size"), *[F.avg(x).alias(f"m{j}") for j, x in enumerate(f)])
    d = salted_join(members, centre, ["cluster"]).withColumn("d2", _sq(dims, "f", "m"))
    # the nearest of each shard first, so that no group meets in one task whole
    d = d.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(64)))
    order = ["d2", "id"]
    near = d.select("cluster", "shard", *order).withColumn("r", F.row_number().over(Window.partitionBy("cluster", "shard").orderBy(*order))).where(F.col("r") <= typical)
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("cluster").orderBy(*order))).where(F.col("r") <= typical)
    lists = near.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("r", "id")))["id"].alias("typical_ids"))  # at most ``typical``
    stats = d.groupBy("cluster").agg(F.count("*").alias("size"), F.avg("d2").alias("dispersion"), F.sqrt(F.max("d2")).alias("radius"))
    return stats.join(lists, "cluster").withColumnRenamed("cluster", "first_id")
