"""Dangling references between tables (problem 1).

Keys of parents and children are put into one long form ``(ref_table, key, is_parent, ...)``, grouped by parent table and
key, and the groups that lack a parent row (or whose parent is deleted, or can be later than a referrer) are kept. The
grouping is a plain hash aggregation, so a key that is named by a third of all rows is pre-aggregated before the shuffle.

Defined results: null keys and -1 name nothing; a record without any ``loaded_at`` has no time, so it is never late and makes
nothing late; empty tables give no rows; repeated rows of a key are one record, repeated references are one reference.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..util import salted_join


def record_state(df: DataFrame, key: str) -> DataFrame:
    """One row per key: ``key``, ``since`` (earliest loaded_at), ``is_deleted`` (by the row with the latest loaded_at; of rows
    that tie there, one deletion is enough)."""
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(F.col(key).cast("bigint").alias("key"))
        .agg(
            F.min("loaded_at").alias("since"),
            F.max(F.struct(F.col("loaded_at"), F.col("deleted_at").isNotNull().alias("d")))["d"].alias("is_deleted"),
        )
    )


def references(children: DataFrame, key: str, refs: DataFrame, src_field: str, ref_table: str) -> DataFrame:
    """Distinct references of living records: src_field, src_id, ref_table, ref_id, since.

    ``refs`` has the columns src_id and ref_id, one row per reference.
    """
    alive = record_state(children, key).where(~F.col("is_deleted")).select(F.col("key").alias("src_id"), "since")
    named = refs.where(F.col("src_id").isNotNull() & F.col("ref_id").isNotNull() & (F.col("ref_id") != -1)).distinct()
    return named.join(alive, "src_id").select(F.lit(src_field).alias("src_field"), "src_id", F.lit(ref_table).alias("ref_table"), "ref_id", "since")


def scene_references(cameras: DataFrame, images: DataFrame, sparse_points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All references of the scene tables, and the states of all records that can be named (ref_table, ref_id, ...)."""
    image_id = F.col("image_id").cast("bigint").alias("src_id")
    refs = (
        references(images, "image_id", images.select(image_id, F.col("camera_id").cast("bigint").alias("ref_id")), "images.camera_id", "cameras")
        .unionByName(
            references(images, "image_id", images.select(image_id, F.explode("points2d.point3d_id").alias("ref_id")), "images.points2d", "sparse_points")
        )
        .unionByName(
            references(
                sparse_points,
                "point3d_id",
                sparse_points.select(F.col("point3d_id").alias("src_id"), F.explode(F.col("track.image_id").cast("array<bigint>")).alias("ref_id")),
                "sparse_points.track",
                "images",
            )
        )
    )
    parents = None
    for name, df, key in (("cameras", cameras, "camera_id"), ("images", images, "image_id"), ("sparse_points", sparse_points, "point3d_id")):
        one = record_state(df, key).select(F.lit(name).alias("ref_table"), F.col("key").alias("ref_id"), F.col("since").alias("parent_since"), "is_deleted")
        parents = one if parents is None else parents.unionByName(one)
    return refs, parents


def dangling(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """References to records that are missing, deleted or late: refs' columns and ref_state.

    The long form holds one row per parent and one per reference; a group is suspicious when it lacks the parent flag, when its
    parent is deleted, or when the parent is later than its earliest referrer. Only suspicious keys meet the references again,
    in a salted join, since one key may be named by a large part of all rows.
    """
    tagged = parents.select("ref_table", "ref_id", F.lit(1).alias("is_parent"), "is_deleted", "parent_since", F.lit(None).cast("timestamp").alias("first_use")).unionByName(
        refs.select(
            "ref_table",
            "ref_id",
            F.lit(0).alias("is_parent"),
            F.lit(False).alias("is_deleted"),
            F.lit(None).cast("timestamp").alias("parent_since"),
            F.col("since").cast("timestamp").alias("first_use"),
        )
    )
    groups = tagged.groupBy("ref_table", "ref_id").agg(
        F.max("is_parent").alias("has_parent"),
        F.max("is_deleted").alias("is_deleted"),
        F.min("parent_since").alias("parent_since"),
        F.min("first_use").alias("first_use"),
    )
    suspicious = groups.where((F.col("has_parent") == 0) | F.col("is_deleted") | (F.col("parent_since") > F.col("first_use")))
    state = F.when(F.col("has_parent") == 0, "missing").when(F.col("is_deleted"), "deleted").when(F.col("parent_since") > F.col("since"), "late")
    return (
        salted_join(refs, suspicious.drop("first_use"), ["ref_table", "ref_id"])
        .withColumn("ref_state", state)
        .where(F.col("ref_state").isNotNull())
        .select("src_field", "src_id", "ref_table", "ref_id", "since", "ref_state")
    )


def dangling_counts(found: DataFrame) -> DataFrame:
    """Counts of dangling references per referring field, named table, state and month of loading of the referrer."""
    return found.groupBy("src_field", "ref_table", "ref_state", F.date_format("since", "yyyy-MM").alias("month")).agg(
        F.count("*").alias("n_refs"), F.countDistinct("ref_id").alias("n_keys")
    )
