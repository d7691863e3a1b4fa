"""Label votes over a stream of observations. Votes are sums, so they give the same counts in any order of arrival.

Defined results: rows with a null cluster or label cast no vote; with a watermark, rows later than it are dropped by Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_votes(stream: DataFrame, cluster: str = "cluster", label: str = "mask_id") -> DataFrame:
    """cluster, label, n so far, first_view; to be written in complete or update mode. Works on a batch table alike."""
    ok = stream.where(F.col(cluster).isNotNull() & F.col(label).isNotNull())
    return ok.groupBy(cluster, label).agg(F.count("*").alias("n"), F.min("view_idx").alias("first_view"))


def windowed_votes(stream: DataFrame, time: str, width: str = "1 hour", late: str = "1 hour", cluster: str = "cluster", label: str = "mask_id") -> DataFrame:
    """Votes per tumbling window of event time, kept open for ``late``; to be written in append mode."""
    ok = stream.where(F.col(cluster).isNotNull() & F.col(label).isNotNull()).withWatermark(time, late)
    return ok.groupBy(F.window(time, width), cluster, label).agg(F.count("*").alias("n"))
