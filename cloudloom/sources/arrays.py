"""NumPy files: label rasters (``.npy``) as rows of pixels, vectors (``.npy`` and ``.npz``) as rows.

Defined results: a file that isn't a NumPy array of the asked shape raises, with its name; levels that a raster lacks give no rows.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def read_masks(spark: SparkSession, path: str, level: int | None = None) -> DataFrame:
    """Pixels of rasters [H, W], [1, H, W] or [L, H, W]: path, level, v, u, mask_id; with ``level`` of this one only. A raster, which is
    one image, is read by one task and given out level by level."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"]):
                a = np.load(io.BytesIO(content), allow_pickle=False)
                a = a[None] if a.ndim == 2 else a
                if a.ndim != 3:
                    raise ValueError(f"{name}: {a.ndim} dimensions are no raster")
                for k in range(a.shape[0]) if level is None else range(level, min(level + 1, a.shape[0])):
                    v, u = np.mgrid[0 : a.shape[1], 0 : a.shape[2]]
                    yield pd.DataFrame({"path": name, "level": k, "v": v.ravel(), "u": u.ravel(), "mask_id": a[k].ravel().astype(np.int64)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, level int, v int, u int, mask_id bigint")


def read_vectors(spark: SparkSession, path: str, keys: tuple[str, ...] = ("feat", "features", "embeddings", "arr_0")) -> DataFrame:
    """Rows of vectors of ``.npy`` files, or of the first of ``keys`` that an ``.npz`` file has: path, row, feat ARRAY<DOUBLE>."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"]):
                a = np.load(io.BytesIO(content), allow_pickle=False)
                if hasattr(a, "files"):
                    found = [k for k in keys if k in a.files]
                    if not found:
                        raise ValueError(f"{name}: none of {keys}")
                    a = a[found[0]]
                for at in range(0, len(a), 4096):
                    part = np.atleast_2d(a[at : at + 4096]).astype(float)
                    yield pd.DataFrame({"path": name, "row": np.arange(at, at + len(part)), "feat": list(part)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, row bigint, feat array<double>")


def read_dense(spark: SparkSession, path: str) -> DataFrame:
    """Dense maps (``width&height&channels&`` and column-major floats): path, u, v, channel, value."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"]):
                head = bytes(content).split(b"&", 3)
                w, h, c = (int(x) for x in head[:3])
                a = np.frombuffer(head[3], dtype="<f4", count=w * h * c).reshape((w, h, c), order="F")
                u, v, k = np.meshgrid(np.arange(w), np.arange(h), np.arange(c), indexing="ij")
                yield pd.DataFrame({"path": name, "u": u.ravel(), "v": v.ravel(), "channel": k.ravel(), "value": a.ravel()})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, u int, v int, channel int, value float")
