"""Queries of the llm problems."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..util import table
from . import bpe, clusters, leaks, neighbours, sentences
from . import consensus as C


def _votes(spark, d):
    return C.usable_labels(table(spark, d, "mask_labels"), table(spark, d, "camera_views"), table(spark, d, "id2label"))


def _fitted(spark, d):
    votes = _votes(spark, d)
    return C.fit(votes)


def p5_found(spark, d):
    model, now = _fitted(spark, d)
    return C.consensus(now, model).select("view_idx", "label_id")


def p5_consensus(spark, d):
    model, now = _fitted(spark, d)
    return C.consensus(now, model)


def p5_reliability(spark, d):
    return C.reliability(_fitted(spark, d)[0])


def p5_alpha(spark, d):
    return C.krippendorff(_votes(spark, d))


def p6_ids(spark, d):
    return bpe.encode(table(spark, d, "documents"))


def _neighbours(spark, d):
    return neighbours.neighbours(table(spark, d, "basic_cloud"), "bp_id", "points", 3, 5)


def p4_found(spark, d):
    return neighbours.unordered_pairs(_neighbours(spark, d)).select(F.col("a").alias("bp_id_a"), F.col("b").alias("bp_id_b"))


def p4_neighbours(spark, d):
    return _neighbours(spark, d).select(F.col("id").alias("bp_id"), F.col("other").alias("other_bp_id"), "dist", "rank")


def p4_search(spark, d):
    """Ids divisible by 50 as queries against all rows."""
    return neighbours.search(table(spark, d, "basic_cloud"), "bp_id", "points", 3, 5).select(F.col("id").alias("bp_id"), F.col("other").alias("other_bp_id"), "dist", "rank")


def p4_embeddings(spark, d):
    """The five nearest vectors of every vector of 64 dimensions."""
    return neighbours.neighbours(table(spark, d, "embeddings"), "vec_id", "embedding", 64, 5).select(F.col("id").alias("vec_id"), F.col("other").alias("other_vec_id"), "dist", "rank")


#: Members of one cluster of ins_feat vectors lie at most this far apart.
SAME_INSTANCE = 0.12


def _clusters(spark, d):
    return clusters.cluster(table(spark, d, "points"), "point_id", "ins_feat", 6, SAME_INSTANCE)


def p2_found(spark, d):
    return clusters.chain(_clusters(spark, d)).select(F.col("a").alias("point_id_a"), F.col("b").alias("point_id_b"))


def p2_clusters(spark, d):
    return clusters.describe(_clusters(spark, d), 6)


def p7_found(spark, d):
    return leaks.leaked(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_report(spark, d):
    docs, items = table(spark, d, "documents"), table(spark, d, "eval_items")
    return leaks.leak_report(leaks.leaked(docs, items), items, docs)


def p8_found(spark, d):
    return sentences.sentence_units(table(spark, d, "documents"))


def p8_units(spark, d):
    return sentences.unit_table(table(spark, d, "documents"))


QUERIES = {
    "p7_found": p7_found,
    "p7_report": p7_report,
    "p8_found": p8_found,
    "p8_units": p8_units,
    "p2_found": p2_found,
    "p2_clusters": p2_clusters,
    "p4_found": p4_found,
    "p4_neighbours": p4_neighbours,
    "p4_search": p4_search,
    "p4_embeddings": p4_embeddings,
    "p6_ids": p6_ids,
    "p5_found": p5_found, "p5_consensus": p5_consensus, "p5_reliability": p5_reliability, "p5_alpha": p5_alpha}
ORACLES = {}
