"""The k most similar vectors of every vector, by NN-descent (problem 4).

Repeated keys are one record, and records at one place are one node: of a place's ids only the lowest k + 1 can be anybody's
neighbour, so copies never multiply. A first graph links places that stand in one block of a curve through space: shifted Z-order
curves up to ten dimensions, signs of random projections beyond. Then each round joins the graph with itself: every node tells the
nodes that it names its vector and its worst distance; a node that hears of several proposes each to the others where they are nearer
than their worst neighbour so far. Links are ids and distances; a vector travels once with each of its node's links, and a node that
very many name hears a fresh sample of them in each round, as the published method has it. Rounds end when few links change (each
change shortens a link, so they do end). Distances are exact, so only the candidates are approximate. ``graph_search`` answers
queries by greedy walks over the graph.

Defined results: rows with null, short or non-finite vectors take no part; equal distances go to the lower id; a collection of
one place gives its ids among themselves; fewer than k + 1 ids give what there is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..util import cut, drop, salted_join

#: Share of links that must change for another round.
MIN_CHANGE = 0.002
#: Curves of the first graph, and places of a block on a curve.
CURVES, BLOCK = 3, 64
#: Most nodes that a node hears of in one round.
HEARD = 64
#: Bits of a coordinate on the Z-order curve, signs of a projected code, and dimensions from which codes are projected.
BITS, SIGNS, PROJECT = 20, 24, 11
#: Nodes of the sample from which graph searches start.
PIVOTS = 4096


def kept_links(k: int, dims: int) -> int:
    """Neighbours of a node while the graph is built: those beyond k keep the descent from ending in local minima, and the more
    dimensions, the more are needed."""
    return k + 3 + max(0, min(dims, 64) - 4) // 2


def clean_vectors(df: DataFrame, key: str, vector: str, dims: int) -> DataFrame:
    """One row per key with a vector of ``dims`` finite numbers: id BIGINT, v ARRAY<DOUBLE> (of repeats the greatest array)."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ok = df.where(F.col(key).isNotNull() & (F.size(v) == dims) & finite)
    # adding zero makes -0.0 and 0.0 one place
    return ok.groupBy(F.col(key).cast("bigint").alias("id")).agg(F.max(F.transform(v, lambda x: x + F.lit(0.0))).alias("v"))


def places(vectors: DataFrame, k: int) -> DataFrame:
    """One row per distinct vector: node (its lowest id), v, ids (the lowest k + 1 ids, in order).

    Only places of several ids rank theirs, shard by shard first, so a place with a third of all rows is no large group.
    """
    one = vectors.groupBy("v").agg(F.min("id").alias("node"), F.count("*").alias("n"))
    many = one.where("n > 1").select("v", "node")
    top = Window.partitionBy("node", "shard").orderBy("id")
    shard = vectors.join(many, "v").select("node", "id", F.pmod(F.xxhash64("id"), F.lit(64)).alias("shard"))
    low = shard.withColumn("r", F.row_number().over(top)).where(F.col("r") <= k + 1)
    low = low.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("id"))).where(F.col("r") <= k + 1)
    lists = low.groupBy("node").agg(F.sort_array(F.collect_list("id")).alias("ids"))  # at most k + 1 of a place
    return one.join(lists, "node", "left").select("node", "v", F.coalesce("ids", F.array("node")).alias("ids"))


def _z_codes(x: np.ndarray, low: np.ndarray, span: float, shift: float) -> np.ndarray:
    """Z-order codes of shifted points; up to 62 bits over the dimensions."""
    d = x.shape[1]
    bits = min(BITS, 62 // d)
    q = ((x - low) / span * 0.5 + shift).clip(0, 1 - 1e-12) * (1 << bits)
    q = q.astype(np.int64)
    code = np.zeros(len(x), dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for j in range(d):
            code = (code << 1) | ((q[:, j] >> b) & 1)
    return code


def _sign_codes(x: np.ndarray, mean: np.ndarray, curve: int) -> np.ndarray:
    """Signs of projections on random directions, the first the highest bit: vectors of one code point the same way from the mean."""
    directions = np.random.default_rng(1000 + curve).normal(size=(x.shape[1], SIGNS))
    return ((x - mean) @ directions > 0) @ (1 << np.arange(SIGNS - 1, -1, -1, dtype=np.int64))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """The non-null lists of a column as rows."""
    return column.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _lists(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32), np.ascontiguousarray(values).ravel())


def _coded(nodes: DataFrame, dims: int) -> DataFrame:
    """``nodes`` with their place z0, z1, .. on each curve."""
    if dims < PROJECT:
        box = nodes.agg(*[F.min(F.col("v")[j]).alias(f"l{j}") for j in range(dims)], *[F.max(F.col("v")[j]).alias(f"h{j}") for j in range(dims)]).first()
        low = np.array(box[:dims], dtype=float)
        span = max(float(np.max(np.array(box[dims:], dtype=float) - low)), 1e-300)
        code = lambda x, c: _z_codes(x, low, span, 0.5 * c / CURVES)
    else:
        mean = np.array(nodes.agg(*[F.avg(F.col("v")[j]) for j in range(dims)]).first(), dtype=float)
        code = lambda x, c: _sign_codes(x, mean, c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("v"), dims)
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("v"), *[pa.array(code(x, c)) for c in range(CURVES)]], ["node", "v", *[f"z{c}" for c in range(CURVES)]])

    return nodes.select("node", "v").mapInArrow(run, "node bigint, v array<double>, " + ", ".join(f"z{c} bigint" for c in range(CURVES)))


def _block_links(ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest others of each row within its block of BLOCK rows: ids (-1 where there are none) and distances."""
    n, dims = x.shape
    near, dist = np.full((n, k), -1, dtype=np.int64), np.full((n, k), np.inf)
    for size, first, blocks in ((BLOCK, 0, n // BLOCK), (n % BLOCK, n - n % BLOCK, 1)):
        m = min(k, size - 1)
        step = max(1, 400_000 // (size * size * max(1, dims // 8))) if size else 1
        for a in range(0, blocks if m > 0 else 0, step):
            rows = slice(first + a * size, first + min(a + step, blocks) * size)
            y = x[rows].reshape(-1, size, dims)
            if dims < 8:
                d = sum((y[:, :, None, j] - y[:, None, :, j]) ** 2 for j in range(dims))
            else:
                norm = (y**2).sum(2)
                d = np.maximum(norm[:, :, None] + norm[:, None, :] - 2 * y @ y.transpose(0, 2, 1), 0.0)
            d[:, np.arange(size), np.arange(size)] = np.inf
            # the place in the block stands in the lowest bits, so that one partition of integers gives the nearest
            packed = (d.view(np.int64) & ~np.int64(127)) | np.arange(size)
            at = np.partition(packed, m - 1, axis=2)[:, :, :m] & 127
            at = np.minimum(at, size - 1)
            z = np.take_along_axis(y[:, None], at[..., None], axis=2)
            near[rows, :m] = np.take_along_axis(ids[rows].reshape(-1, 1, size), at, axis=2).reshape(-1, m)
            dist[rows, :m] = np.sqrt(((z - y[:, :, None]) ** 2).sum(-1)).reshape(-1, m)
    return near, dist


def _smallest(near: np.ndarray, dist: np.ndarray, fresh: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row the k nearest different ids, by distance and id. Of two links to one id the one that isn't fresh counts."""
    order = np.lexsort((fresh, near))
    near, dist, fresh = (np.take_along_axis(z, order, axis=1) for z in (near, dist, fresh))
    gone = near < 0
    gone[:, 1:] |= near[:, 1:] == near[:, :-1]
    order = np.argsort(np.where(gone, np.inf, dist), axis=1, kind="stable")[:, :k]
    near, dist, fresh, gone = (np.take_along_axis(z, order, axis=1) for z in (near, dist, fresh, gone))
    return np.where(gone, -1, near), np.where(gone, np.inf, dist), fresh & ~gone


GRAPH = "node bigint, v array<double>, near array<bigint>, dist array<double>, fresh array<boolean>"


def _graph_rows(node, v, near, dist, fresh) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(node), v, _lists(near), _lists(dist), _lists(fresh)], ["node", "v", "near", "dist", "fresh"])


def _whole_groups(batches: Iterator[pa.RecordBatch], key: str, rows: int = 50_000) -> Iterator[pa.RecordBatch]:
    """Batches of rows sorted by ``key``, cut anew so that no group spans two."""
    held: list[pa.RecordBatch] = []
    count = 0
    for b in batches:
        held.append(b)
        count += len(b)
        if count < rows:
            continue
        t = pa.concat_batches(held)
        keys = t.column(key).to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(keys, keys[-1]))
        if last:
            yield t.slice(0, last)
            t = t.slice(last)
        held, count = [t], len(t)
    if count:
        yield pa.concat_batches(held)


def first_graph(nodes: DataFrame, dims: int, k: int) -> DataFrame:
    """The graph of the nearest within blocks of each curve, and each node's blocks: nodes that share one have met. A curve is
    range-partitioned; a task sorts its own range."""
    coded = cut(_coded(nodes, dims))
    rows = None
    for c in range(CURVES):

        def link(batches: Iterator[pa.RecordBatch], c=c) -> Iterator[pa.RecordBatch]:
            shift, base = BLOCK * c // CURVES, np.int64(TaskContext.get().partitionId() + 1) << 40
            for t in _rebatch(batches, 512 * BLOCK):
                ids, x = t.column("node").to_numpy(zero_copy_only=False), _matrix(t.column("v"), dims)
                parts = [_block_links(ids[p], x[p], k) for p in (slice(0, shift), slice(shift, None))]
                v = t.column("v") if c == 0 else pa.nulls(len(t), t.column("v").type)
                near, dist = (np.concatenate(z) for z in zip(*parts))
                block = base + (np.arange(len(t)) - shift) // BLOCK
                base += 1024
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(len(t), c, dtype=np.int32)), v, _lists(near), _lists(dist), pa.array(block)], ["node", "c", "v", "near", "dist", "block"])

        curve = coded.select("node", "v", f"z{c}").repartitionByRange(f"z{c}", "node").sortWithinPartitions(f"z{c}", "node")
        one = curve.select("node", "v").mapInArrow(link, "node bigint, c int, v array<double>, near array<bigint>, dist array<double>, block bigint")
        rows = one if rows is None else rows.unionByName(one)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_groups(batches, "node"):
            # each node has one row of every curve, the first with its vector
            near, dist = (_matrix(t.column(n), k).reshape(-1, CURVES * k) for n in ("near", "dist"))
            near, dist, fresh = _smallest(near, dist, np.ones(near.shape, dtype=bool), k)
            rows = _graph_rows(t.column("node").to_numpy(zero_copy_only=False)[::CURVES], t.column("v").drop_null(), near, dist, fresh)
            yield rows.append_column("blocks", _lists(t.column("block").to_numpy(zero_copy_only=False).reshape(-1, CURVES)))

    graph = cut(rows.repartition("node").sortWithinPartitions("node", "c").mapInArrow(merge, GRAPH + ", blocks array<bigint>"))
    drop(coded)
    return graph


def _rebatch(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``rows``."""
    held: list[pa.RecordBatch] = []
    count = 0
    for b in batches:
        held.append(b)
        count += len(b)
        while count >= rows:
            t = pa.concat_batches(held)
            yield t.slice(0, rows)
            t = t.slice(rows)
            held, count = [t], len(t)
    if count:
        yield pa.concat_batches(held)


def _introduce(dims: int, met: bool):
    """Local joins: of all pairs of those that name a node, one of the links fresh, the pairs that are nearer than the worst of the
    first; with ``met`` without those that stood in one block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_groups(batches, "other"):
            key = t.column("other").to_numpy(zero_copy_only=False)
            ids, worst, fresh = (t.column(c).to_numpy(zero_copy_only=False) for c in ("node", "worst", "fresh"))
            w = _matrix(t.column("v"), dims)
            blocks = _matrix(t.column("blocks"), CURVES) if met else None
            start = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
            size = np.minimum(np.diff(start, append=len(key)), HEARD)
            out: list[tuple[np.ndarray, ...]] = []
            for m in np.unique(size[size > 1]).tolist():
                of_size = start[size == m]
                step = max(1, 400_000 // (m * m * max(1, dims // 8)))
                for r in range(0, len(of_size), step):
                    at = of_size[r : r + step, None] + np.arange(m)
                    i, x, top, f = ids[at], w[at], worst[at], fresh[at]
                    if dims < 8:
                        d = np.sqrt(sum((x[:, :, None, j] - x[:, None, :, j]) ** 2 for j in range(dims)))
                    else:
                        norm = (x**2).sum(2)
                        d = np.sqrt(np.maximum(norm[:, :, None] + norm[:, None, :] - 2 * x @ x.transpose(0, 2, 1), 0.0))
                    g, p, q = np.nonzero((d <= top[:, :, None] * (1 + 1e-9)) & (f[:, :, None] | f[:, None, :]) & ~np.eye(m, dtype=bool))
                    if met:
                        new = ~(blocks[at[g, p]] == blocks[at[g, q]]).any(axis=1)
                        g, p, q = g[new], p[new], q[new]
                    if len(g):
                        out.append((i[g, p], i[g, q], np.sqrt(((x[g, p] - x[g, q]) ** 2).sum(1))))
            if out:
                node, other, dist = (np.concatenate(z) for z in zip(*out))
                # one proposal of a pair
                order = np.lexsort((other, node))
                node, other, dist = node[order], other[order], dist[order]
                first = np.ones(len(node), dtype=bool)
                first[1:] = (node[1:] != node[:-1]) | (other[1:] != other[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(z[first]) for z in (node, other, dist)], ["node", "other", "dist"])

    return run


def _improve(dims: int, k: int):
    """New lists of nodes out of their old list and the proposals; a list without proposals is only no longer fresh."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_groups(batches, "node"):
            key = t.column("node").to_numpy(zero_copy_only=False)
            own = np.flatnonzero(t.column("v").is_valid().to_numpy(zero_copy_only=False))  # a node's own row stands first
            near, dist = _matrix(t.column("near"), k).copy(), _matrix(t.column("dist"), k).copy()
            fresh = np.zeros(near.shape, dtype=bool)
            size = np.diff(own, append=len(key)) - 1
            other = t.column("one").to_numpy(zero_copy_only=False)
            way = t.column("one_dist").to_numpy(zero_copy_only=False)
            left = np.flatnonzero(size)
            # rows with similar numbers of proposals at a time
            for low in np.unique(2 ** np.ceil(np.log2(size[left])).astype(int)).tolist() if len(left) else ():
                rows = left[(size[left] <= low) & (size[left] > low // 2)]
                at = own[rows, None] + 1 + np.arange(low)
                there = np.arange(low) < size[rows, None]
                at = np.where(there, at, 0)
                more, more_d = np.where(there, other[at], -1).astype(np.int64), np.where(there, way[at], np.inf)
                old = np.zeros((len(rows), k), dtype=bool)
                near[rows], dist[rows], fresh[rows] = _smallest(
                    np.concatenate([near[rows], more], axis=1), np.concatenate([dist[rows], more_d], axis=1), np.concatenate([old, there], axis=1), k
                )
            yield _graph_rows(key[own], t.column("v").drop_null(), near, dist, fresh)

    return run


def nn_descent(nodes: DataFrame, dims: int, k: int, min_change: float = MIN_CHANGE) -> DataFrame:
    """The neighbour graph: node, v, near, dist (k each, in order; -1 where there are fewer). ``nodes`` has node and v, one row per
    distinct vector."""
    if nodes.isEmpty():
        return nodes.sparkSession.createDataFrame([], GRAPH)
    graph, number = first_graph(nodes, dims, k), 0
    while True:
        link = F.explode(F.arrays_zip("near", "fresh")).alias("l")
        told = ["node", "v", *(["blocks"] if not number else [])]
        said = graph.select(*told, F.element_at("dist", -1).alias("worst"), link).select(*told, "worst", F.col("l.near").alias("other"), F.col("l.fresh").alias("fresh")).where("other >= 0")
        if number:
            # only who is named by a fresh link has anything new to tell
            new = graph.where(F.exists("fresh", lambda x: x)).select(F.explode(F.filter(F.arrays_zip("near", "fresh"), lambda x: x["fresh"])).alias("l"))
            said = said.join(new.select(F.col("l.near").alias("other")).distinct(), "other", "left_semi")
        heard = said.repartition("other").sortWithinPartitions("other", F.xxhash64("node", F.lit(number)))
        proposed = heard.mapInArrow(_introduce(dims, not number), "node bigint, other bigint, dist double")
        lists = graph.drop("fresh", "blocks").unionByName(proposed.select("node", F.col("other").alias("one"), F.col("dist").alias("one_dist")), allowMissingColumns=True)
        lists = lists.repartition("node").sortWithinPartitions("node", F.col("v").isNull())
        better = cut(lists.mapInArrow(_improve(dims, k), GRAPH))
        changed, total = better.agg(F.sum(F.size(F.filter("fresh", lambda x: x))), F.count("*") * k).first()
        drop(graph)
        graph, number = better, number + 1
        if not total or changed <= min_change * total:
            return graph


def neighbours(df: DataFrame, key: str, vector: str, dims: int, k: int) -> DataFrame:
    """The k nearest other ids of every id: id, other, dist, rank (from 1)."""
    vectors = cut(clean_vectors(df, key, vector, dims))
    spots = cut(places(vectors, k))
    graph = nn_descent(spots.select("node", "v"), dims, kept_links(k, dims))
    return _of_places(vectors, spots, graph, k)


def _of_places(vectors: DataFrame, spots: DataFrame, graph: DataFrame, k: int) -> DataFrame:
    """The nearest ids of every id out of the nearest places of every place."""
    far = graph.select("node", F.explode(F.arrays_zip("near", "dist")).alias("n")).select("node", F.col("n.dist").alias("dist"), F.col("n.near").alias("other")).where("other >= 0")
    many = spots.where(F.size("ids") > 1).select(F.col("node").alias("other"), "ids")
    # most places have one id, which is the node itself
    far = far.join(many, "other", "left").select("node", "dist", F.explode(F.coalesce("ids", F.array("other"))).alias("id"))
    own = spots.where(F.size("ids") > 1).select("node", F.lit(0.0).alias("dist"), F.explode("ids").alias("id"))
    lists = far.unionByName(own).groupBy("node").agg(F.slice(F.sort_array(F.collect_list(F.struct("dist", "id"))), 1, k + 1).alias("near"))
    single = spots.where(F.size("ids") == 1).select(F.col("node").alias("id"), "node")
    copies = vectors.join(spots.where(F.size("ids") > 1).select("node", "v"), "v").select("id", "node")
    # every id of a place takes the place's list without itself
    mine = salted_join(copies, lists, ["node"]).unionByName(single.join(lists, "node").select("node", "id", "near"))
    mine = mine.select("id", F.slice(F.filter("near", lambda n: n["id"] != F.col("id")), 1, k).alias("near"))
    return mine.select("id", F.posexplode("near").alias("pos", "n")).select("id", F.col("n.id").alias("other"), F.col("n.dist").alias("dist"), (F.col("pos") + 1).alias("rank"))


def unordered_pairs(found: DataFrame) -> DataFrame:
    """Distinct pairs a < b of which one names the other."""
    return found.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()


def entries(graph: DataFrame, queries: DataFrame, dims: int, starts: int = 4, pivots: int = PIVOTS) -> DataFrame:
    """query and node: the nearest ``starts`` of a sample of at most ``pivots`` nodes, for each query (query, qv).

    The sample is those of the lowest hash, so its size is bounded and it is the same at every partitioning.
    """
    sample = graph.select("node", "v").orderBy(F.xxhash64("node"), "node").limit(pivots).collect()  # at most ``pivots`` nodes
    ids, x = np.array([r["node"] for r in sample], dtype=np.int64), np.array([r["v"] for r in sample], dtype=float).reshape(-1, dims)
    sent = graph.sparkSession.sparkContext.broadcast((ids, x))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = sent.value
        m = min(starts, len(ids))
        for b in batches:
            y = _matrix(b.column("qv"), dims)
            for a in range(0, len(y) if m else 0, 256):
                d = ((y[a : a + 256, None] - x[None]) ** 2).sum(-1) if dims < 8 else (x**2).sum(1)[None] - 2 * y[a : a + 256] @ x.T
                at = np.argpartition(d, m - 1, axis=1)[:, :m]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column("query").to_numpy(zero_copy_only=False)[a : a + 256], m)), pa.array(ids[at].ravel())], ["query", "node"])

    return queries.select("query", "qv").mapInArrow(run, "query bigint, node bigint")


def graph_search(graph: DataFrame, queries: DataFrame, dims: int, k: int, beam: int = 24) -> DataFrame:
    """Greedy search: each query walks from its entry nodes to the neighbours of the nearest nodes that it has seen, until none of
    its ``beam`` nearest is left to be visited (which ends, since each step either nears or visits).

    ``queries`` has query and qv. A step is one join of the queries' frontiers with the graph and one with the vectors. Gives
    query, other, dist, rank.
    """
    vec = graph.select("node", "v")
    dist = F.sqrt(F.aggregate(F.zip_with("qv", "v", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    queries = cut(queries.select("query", "qv"))

    def best(rows: DataFrame) -> DataFrame:
        one = rows.groupBy("query", "node").agg(F.min("dist").alias("dist"), F.max("done").alias("done"))
        rank = F.row_number().over(Window.partitionBy("query").orderBy("dist", "node"))
        return cut(one.withColumn("r", rank).where(F.col("r") <= beam))

    first = entries(graph, queries, dims).distinct().join(vec, "node").join(queries, "query")
    state = best(first.select("query", "node", dist.alias("dist"), F.lit(False).alias("done")))
    while True:
        front = state.where(~F.col("done"))
        if front.isEmpty():
            break
        step = front.join(graph.select("node", "near"), "node").select("query", F.explode("near").alias("node")).where("node >= 0").distinct()
        new = step.join(state.select("query", "node"), ["query", "node"], "left_anti").join(vec, "node").join(queries, "query")
        both = state.select("query", "node", "dist", F.lit(True).alias("done")).unionByName(new.select("query", "node", dist.alias("dist"), F.lit(False).alias("done")))
        state, old = best(both), state
        drop(old)
    return state.where(F.col("r") <= k).select("query", F.col("node").alias("other"), "dist", F.col("r").alias("rank"))


def search(df: DataFrame, key: str, vector: str, dims: int, k: int, every: int = 50) -> DataFrame:
    """The k nearest other ids of the ids divisible by ``every`` against all rows, by greedy search: id, other, dist, rank."""
    vectors = cut(clean_vectors(df, key, vector, dims))
    spots = cut(places(vectors, k))
    graph = nn_descent(spots.select("node", "v"), dims, kept_links(k, dims))
    asked = vectors.where(F.col("id") % every == 0).select(F.col("id").alias("query"), F.col("v").alias("qv"))
    hits = graph_search(graph, asked, dims, k + 1)
    ids = hits.join(spots.select(F.col("node").alias("other"), "ids"), "other").select(F.col("query").alias("id"), "dist", F.explode("ids").alias("other")).where("other <> id")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("dist", "other"))
    return ids.withColumn("rank", rank).where(F.col("rank") <= k).select("id", "other", "dist", "rank")
