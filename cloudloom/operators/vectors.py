"""Lookups by vector: nearest centres and prototypes, leaves and texts, seeds, clicks, two-level codebooks.

Defined results: vectors that are null, of another length or hold a null take no part; a zero vector has cosine 0 with everything;
equal scores go to the lower code; an empty seed or a missing text raises, as nothing could be looked up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X

#: Numbers of centres that go out at once; more centres are looked at in blocks of this size.
BLOCK_NUMBERS = 4_000_000


def mean_vectors(rows: DataFrame, by: list[str], vector: str, extra: float = 0.0, matched: Column | None = None) -> DataFrame:
    """Sum of the matched vectors of each group over (their number + ``extra``), element by element: by, feat, n. Groups without a
    matched vector have zeros if ``extra`` is positive."""
    hit = F.coalesce(matched, F.lit(False)) if matched is not None else F.lit(True)
    long = rows.where(F.col(vector).isNotNull()).select(*by, hit.alias("_hit"), F.posexplode(vector).alias("i", "x"))
    sums = long.groupBy(*by, "i").agg(F.sum(F.when(F.col("_hit"), F.col("x").cast("double")).otherwise(0.0)).alias("s"), F.count_if("_hit").alias("n"))
    value = F.col("s") / F.when(F.col("n") + extra > 0, F.col("n") + extra)
    pairs = sums.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("i", F.coalesce(value, F.lit(0.0)).alias("x")))).alias("a"), F.max("n").alias("n"))
    return pairs.select(*by, F.transform("a", lambda p: p["x"]).alias("feat"), "n")


def nearest_of(rows: DataFrame, key: str, vector: str, centres: DataFrame, code: str, centre: str, metric: str = "l2", k: int = 1) -> DataFrame:
    """The k nearest centres of each row: key, code, score (distance, or cosine for ``metric`` cosine), rank.

    Centres go out in blocks of at most BLOCK_NUMBERS numbers, so their number has no bound; a task scores a batch of rows against
    a block by one matrix product.
    """
    dims = centres.select(F.max(F.size(centre))).first()[0] or 0
    n = centres.count()
    blocks = max(1, -(-n * dims // BLOCK_NUMBERS))
    kinds = dict(rows.dtypes)
    ok = rows.where((F.size(vector) == dims) & F.forall(vector, lambda x: x.isNotNull())).select(key, F.col(vector).cast("array<double>").alias("_v"))
    out = None
    for b in range(blocks):
        part = centres.where(F.size(centre) == dims)
        if blocks > 1:
            part = part.where(F.pmod(F.xxhash64(code), F.lit(blocks)) == b)
        table = part.select(F.col(code).cast("bigint"), F.col(centre).cast("array<double>")).orderBy(code).collect()  # about BLOCK_NUMBERS numbers
        sent = rows.sparkSession.sparkContext.broadcast((np.array([r[0] for r in table], dtype=np.int64), np.array([r[1] for r in table], dtype=float).reshape(len(table), dims)))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            codes, c = sent.value
            m = min(k, len(codes))
            for batch in batches:
                v = batch.column("_v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
                for a in range(0, len(v) if m else 0, 1024):
                    x = v[a : a + 1024]
                    if metric == "cosine":
                        size = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(c, axis=1)[None]
                        score = -np.divide(x @ c.T, size, out=np.zeros(size.shape), where=size > 0)
                    else:
                        score = np.sqrt(((x[:, None] - c[None]) ** 2).sum(-1)) if len(c) * dims <= 4096 else np.sqrt(np.maximum((x**2).sum(1)[:, None] + (c**2).sum(1)[None] - 2 * x @ c.T, 0))
                    at = np.argsort(score, axis=1, kind="stable")[:, :m]
                    best = np.take_along_axis(score, at, axis=1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(batch.column(key).slice(a, 1024).to_numpy(zero_copy_only=False), m)), pa.array(codes[at].ravel()), pa.array((-best if metric == "cosine" else best).ravel()), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(x)))],
                        [key, "code", "score", "rank"],
                    )

        one = ok.mapInArrow(run, f"{key} {kinds[key]}, code bigint, score double, rank int")
        out = one if out is None else out.unionByName(one)
    if blocks == 1:
        return out
    order = [F.desc("score") if metric == "cosine" else F.asc("score"), F.asc("code")]
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= k)


def text_query(leaves: DataFrame, texts: DataFrame, min_occupied: int = 5, top: int = 10, max_code: float = 0.9, code_dims: int = 6) -> DataFrame:
    """Leaves that answer each text (text, feat): the ``top`` leaves (leaf, feat, n) by cosine whose code lies nearer than ``max_code``
    to the best leaf's code. Leaves with fewer than ``min_occupied`` members score 0. Gives text, leaf, score, rank."""
    gated = leaves.withColumn("feat", F.when(F.col("n") >= min_occupied, F.col("feat")).otherwise(F.transform("feat", lambda x: F.lit(0.0))))
    near = nearest_of(texts, "text", "feat", gated, "leaf", "feat", "cosine", top).withColumnRenamed("code", "leaf")
    code = leaves.select("leaf", F.slice("feat", 1, code_dims).alias("c"))
    best = near.where("rank = 1").join(code, "leaf").select("text", F.col("c").alias("best"))
    return near.join(code, "leaf").join(best, "text").where(X.l2(F.col("c"), F.col("best")) < max_code).select("text", "leaf", "score", "rank")


def leaf_classes(leaves: DataFrame, texts: DataFrame, min_occupied: int = 2, min_score: float | None = None, unknown: int = 255) -> DataFrame:
    """Class of each leaf: the best text by cosine. Leaves with fewer than ``min_occupied`` members count as zero vectors, which go to
    the lowest class; with ``min_score`` these and those below it become ``unknown``. Gives leaf, label, score."""
    few = F.col("n") < min_occupied
    gated = leaves.withColumn("feat", F.when(few, F.transform("feat", lambda x: F.lit(0.0))).otherwise(F.col("feat")))
    best = nearest_of(gated, "leaf", "feat", texts, "text", "feat", "cosine").select("leaf", F.col("code").alias("label"), "score")
    if min_score is None:
        return best
    bad = (F.col("score") < min_score) | few
    return best.join(leaves.select("leaf", "n"), "leaf").select("leaf", F.when(bad, F.lit(unknown)).otherwise(F.col("label")).alias("label"), "score")


def by_dictionary(rows: DataFrame, index: Column, dictionary: DataFrame, code: str, n: int) -> DataFrame:
    """Rows with the dictionary's columns of their index, clipped to 0 .. n - 1; the dictionary has one row per code."""
    return rows.withColumn(code, F.least(F.greatest(index, F.lit(0)), F.lit(n - 1))).join(dictionary, code)


def mask_features(rows: DataFrame, on: list[str], features: DataFrame, dims: int) -> DataFrame:
    """Rows with ``feat`` of their mask; masks without one, and mask 0, have the zero vector."""
    zero = F.array_repeat(F.lit(0.0), dims)
    named = features.select(*on, "feat").where(F.col(on[-1]) != 0)
    return rows.join(named, on, "left").withColumn("feat", F.coalesce("feat", zero))


def named_texts(texts: DataFrame, names: list[str]) -> DataFrame:
    """The first (lowest id) entry of each name; raises for a name that no entry has."""
    asked = texts.sparkSession.createDataFrame([(k, n) for k, n in enumerate(names)], "place int, text string")
    found = asked.join(texts.groupBy("text").agg(F.min("id").alias("id")), "text", "left")
    return found.select("place", "text", F.when(F.col("id").isNull(), F.raise_error(F.concat(F.lit("no text "), "text"))).otherwise(F.col("id")).alias("id"))


def seed_similar(rows: DataFrame, by: list[str], vector: str, inside: Column, min_cosine: float, missing: str = "raise") -> DataFrame:
    """Rows of each group whose vector is near the mean vector of the group's seed (rows for which ``inside`` holds). A group without
    seed rows raises, or with ``missing`` drop gives no rows."""
    seed = mean_vectors(rows.where(inside), by, vector).select(*by, F.col("feat").alias("_seed"))
    if missing == "raise" and seed.isEmpty():
        raise ValueError("no rows in the seed")
    return rows.join(seed, by).withColumn("cosine", X.cosine(F.col(vector), F.col("_seed"))).where(F.col("cosine") >= min_cosine).drop("_seed")


def clicked_leaf(pixels: DataFrame, clicks: DataFrame, radius: int, roots: DataFrame, leaves: DataFrame) -> DataFrame:
    """Leaf under each click (click, view_idx, u, v): the mean feature of the pixels (view_idx, u, v, feat) within ``radius`` of it,
    its nearest root (root, centre), and the nearest leaf (leaf, root, centre) within that root. Clicks on nothing give no row."""
    near = pixels.select("view_idx", F.col("u").alias("pu"), F.col("v").alias("pv"), "feat").join(clicks, "view_idx")
    near = near.where((F.abs(F.col("pu") - F.col("u")) <= radius) & (F.abs(F.col("pv") - F.col("v")) <= radius))
    mean = mean_vectors(near, ["click"], "feat").select("click", "feat")
    root = nearest_of(mean, "click", "feat", roots, "root", "centre").select("click", F.col("code").alias("root"))
    d = X.l2(F.col("feat"), F.col("centre"))
    inner = mean.join(root, "click").join(leaves, "root").select("click", "root", F.struct(d.alias("dist"), "leaf").alias("s"))
    return inner.groupBy("click", "root").agg(F.min("s").alias("s")).select("click", "root", F.col("s.leaf").alias("leaf"), F.col("s.dist").alias("dist"))


def codebook(rows: DataFrame, key: str, vector: str, start: DataFrame, rounds: int = 5) -> tuple[DataFrame, DataFrame]:
    """Lloyd rounds from the centres ``start`` (code, centre): the last assignment (key, code, score, rank) and centres. An empty code
    becomes the zero vector. A round is one pass of matrix products and one aggregate with a row per code."""
    centres = start.select("code", "centre")
    dims = centres.select(F.max(F.size("centre"))).first()[0] or 0
    ok = rows.where((F.size(vector) == dims) & F.forall(vector, lambda x: x.isNotNull()))
    for _ in range(rounds):
        near = nearest_of(ok, key, vector, centres, "code", "centre")
        mean = mean_vectors(near.select(key, "code").join(ok.select(key, vector), key), ["code"], vector).select("code", F.col("feat").alias("mean"))
        centres = start.select("code").join(mean, "code", "left").select("code", F.coalesce("mean", F.array_repeat(F.lit(0.0), dims)).alias("centre"))
        centres = rows.sparkSession.createDataFrame(centres.collect(), "code bigint, centre array<double>")  # one row per code
    return nearest_of(ok, key, vector, centres, "code", "centre"), centres


def two_level(rows: DataFrame, key: str, feature: str, position: str, roots: DataFrame, leaf_counts: DataFrame, rounds: int = 3) -> DataFrame:
    """Two-level codes: key, root, leaf. Roots quantise feature and position together from the centres ``roots`` (code, centre); inside
    a root of ``leaf_counts`` (root, n) leaves, rows are quantised by feature alone from the root's n rows of lowest key. Leaf numbers
    run on over the roots."""
    joint = rows.withColumn("_joint", F.concat(feature, position))
    root = codebook(joint, key, "_joint", roots, rounds)[0].select(key, F.col("code").alias("root"))
    inner = rows.join(root, key)
    counts = leaf_counts.withColumn("first", F.coalesce(F.sum("n").over(Window.orderBy("root").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row per root
    rank = F.row_number().over(Window.partitionBy("root").orderBy(key))
    seeds = inner.withColumn("k", rank).join(counts, "root").where(F.col("k") <= F.col("n")).select("root", (F.col("first") + F.col("k") - 1).alias("leaf"), F.col(feature).cast("array<double>").alias("centre"))
    distance = X.l2(F.col(feature), F.col("centre"))
    for step in range(rounds + 1):
        # a row meets the leaves of its own root only
        near = inner.join(seeds, "root").groupBy(key, "root").agg(F.min(F.struct(distance.alias("d"), "leaf"))["leaf"].alias("leaf"))
        if step < rounds:
            mean = mean_vectors(near.join(rows.select(key, feature), key), ["root", "leaf"], feature).select("root", "leaf", F.col("feat").alias("mean"))
            dims = F.size("centre")
            seeds = seeds.join(mean, ["root", "leaf"], "left").select("root", "leaf", F.coalesce("mean", F.array_repeat(F.lit(0.0), dims)).alias("centre"))
    return near


def leaf_counts(matched: DataFrame, cap: int) -> DataFrame:
    """Leaves of each root: one more than the most masks that matched it in a view (root, view_idx, mask_id), at most ``cap``."""
    per = matched.select("root", "view_idx", "mask_id").distinct().groupBy("root", "view_idx").agg(F.count("*").alias("m"))
    return per.groupBy("root").agg(F.least(F.max("m") + 1, F.lit(cap)).cast("int").alias("n"))


def matched_pairs(overlap: DataFrame, min_score: float = 0.2) -> DataFrame:
    """The best mask of each cluster (a, b, iou, l1) by IoU * (1 - L1), accepted above ``min_score``; ties to the lower mask."""
    scored = overlap.withColumn("score", F.col("iou") * (1 - F.col("l1")))
    best = scored.groupBy("a").agg(F.max(F.struct("score", (-F.col("b")).alias("nb"))).alias("m"))
    return best.where(F.col("m.score") > min_score).select("a", (-F.col("m.nb")).alias("b"), F.col("m.score").alias("score"))


def related(overlap: DataFrame, min_iou: float = 0.2, max_l1: float = 0.9, max_l2: float = 0.5, top: int = 10) -> DataFrame:
    """Masks related to each cluster: IoU (base former) above a limit, then distances below limits; the ``top`` by IoU."""
    ok = overlap.where((F.col("iou") > min_iou) & (F.col("l1") < max_l1) & (F.col("l2") < max_l2))
    return ok.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("iou"), "b"))).where(F.col("rank") <= top)
