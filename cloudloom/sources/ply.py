"""PLY files: a scan as a Python data source (binary little-endian or ASCII), split by ranges of vertices, and a writer.

Field names are resolved as the data model says: ins_feat_* (legacy letters or numbers) and f_rest_* become arrays; a missing
opacity or scale stays null. Files without a vertex element give no rows; list properties of the vertex element are refused.
"""

from __future__ import annotations

import glob
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

# PLY scalar types, their sizes, and Spark types wide enough for them.
NUMPY = {"char": "i1", "uchar": "u1", "short": "i2", "ushort": "u2", "int": "i4", "uint": "u4", "float": "f4", "double": "f8"}
ALIAS = {"int8": "char", "uint8": "uchar", "int16": "short", "uint16": "ushort", "int32": "int", "uint32": "uint", "float32": "float", "float64": "double"}
SPARK = {"char": "short", "uchar": "short", "short": "short", "ushort": "int", "int": "int", "uint": "bigint", "float": "float", "double": "double"}
#: Vertices of a split.
SPLIT = 1_000_000


def read_header(path: str) -> tuple[str, int, list[tuple[str, str]], int]:
    """Format, vertex count, vertex properties (name, type) and the place of the first vertex: bytes, or lines after the header for ASCII.

    Elements before the vertices are stepped over, which their lists make impossible in binary files; big-endian files are refused.
    """
    with open(path, "rb") as f:
        kind, n, props, element, before, skipped = "", 0, [], "", [], 0
        for line in f:
            words = line.decode("ascii", "replace").split()
            if words[:1] == ["format"]:
                kind = words[1]
                if kind not in ("ascii", "binary_little_endian"):
                    raise ValueError(f"{path}: format {kind} can't be read")
            elif words[:1] == ["element"]:
                element = words[1]
                if element != "vertex" and not props:
                    before.append([int(words[2]), 0])
                n = int(words[2]) if element == "vertex" else n
            elif words[:1] == ["property"] and element == "vertex":
                if words[1] == "list":
                    raise ValueError(f"{path}: list properties of vertices can't be read")
                props.append((words[2], ALIAS.get(words[1], words[1])))
            elif words[:1] == ["property"] and before and not props:
                if words[1] == "list" and kind != "ascii":
                    raise ValueError(f"{path}: lists before the vertices can't be stepped over")
                before[-1][1] += 0 if words[1] == "list" else np.dtype(NUMPY[ALIAS.get(words[1], words[1])]).itemsize
            elif words[:1] == ["end_header"]:
                if kind == "ascii":
                    for _ in range(sum(count for count, _ in before)):
                        f.readline()
                else:
                    skipped = sum(count * size for count, size in before)
                return kind, n, props, f.tell() + skipped
    raise ValueError(f"{path}: no end of header")


class _Range(InputPartition):
    def __init__(self, path: str, first: int, last: int):
        self.path, self.first, self.last = path, first, last


class PlyReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.files = schema, sorted(glob.glob(options["path"]) if not os.path.isdir(options["path"]) else glob.glob(f"{options['path']}/**/*.ply", recursive=True))

    def partitions(self) -> list[InputPartition]:
        parts = []
        for path in self.files:
            n = read_header(path)[1]
            parts += [_Range(path, a, min(a + SPLIT, n)) for a in range(0, n, SPLIT)]
        return parts or [_Range("", 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        kind, _, props, start = read_header(partition.path)
        dtype = np.dtype([(name, "<" + NUMPY[t]) for name, t in props])
        n = partition.last - partition.first
        with open(partition.path, "rb") as f:
            f.seek(start)
            if kind == "ascii":
                lines = [line for k, line in enumerate(f) if partition.first <= k < partition.last]
                rows = np.array([tuple(float(x) for x in line.split()[: len(props)]) for line in lines], dtype=[(name, "f8") for name, _ in props])
            else:
                f.seek(start + partition.first * dtype.itemsize)
                rows = np.frombuffer(f.read(n * dtype.itemsize), dtype=dtype)
        cols = []
        for field in self.schema.fields:
            if field.name == "path":
                cols.append(pa.array([partition.path] * n))
            elif field.name == "vertex_idx":
                cols.append(pa.array(np.arange(partition.first, partition.last, dtype=np.int64)))
            elif field.name in rows.dtype.names:
                cols.append(pa.array(rows[field.name].astype({"short": "i2", "integer": "i4", "long": "i8", "float": "f4", "double": "f8"}[field.dataType.typeName()])))
            else:
                cols.append(pa.nulls(n, {"short": pa.int16(), "integer": pa.int32(), "long": pa.int64(), "float": pa.float32(), "double": pa.float64()}[field.dataType.typeName()]))
        yield pa.RecordBatch.from_arrays(cols, names=self.schema.fieldNames())


class PlySource(DataSource):
    """``spark.read.format("ply").load(path)``: path, vertex_idx and the vertex properties of the first file by name."""

    @classmethod
    def name(cls) -> str:
        return "ply"

    def schema(self) -> str:
        path = self.options["path"]
        files = sorted(glob.glob(path) if not os.path.isdir(path) else glob.glob(f"{path}/**/*.ply", recursive=True))
        fields: dict[str, str] = {}
        for f in files:
            for name, t in read_header(f)[2]:
                fields[name] = SPARK[t] if fields.get(name, SPARK[t]) == SPARK[t] else "double"
        return ", ".join(["path string", "vertex_idx bigint", *[f"`{k}` {v}" for k, v in fields.items()]])

    def reader(self, schema: StructType) -> DataSourceReader:
        return PlyReader(schema, self.options)


def read_ply(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(PlySource)
    return spark.read.format("ply").load(path)


def gather(df: DataFrame) -> DataFrame:
    """ins_feat_* and f_rest_* columns as arrays ins_feat and f_rest: legacy letters in their order, numbers by value."""
    from pyspark.sql import functions as F

    legacy = [f"ins_feat_{c}" for c in ("r", "g", "b", "r2", "g2", "b2")]
    number = lambda c: int(re.search(r"(\d+)$", c).group(1))
    feats = legacy if all(c in df.columns for c in legacy) else sorted((c for c in df.columns if re.fullmatch(r"ins_feat_\d+", c)), key=number)
    rest = sorted((c for c in df.columns if re.fullmatch(r"f_rest_\d+", c)), key=number)
    keep = [c for c in df.columns if c not in feats and c not in rest]
    array = lambda cs: F.array(*[F.col(c).cast("float") for c in cs]) if cs else F.array().cast("array<float>")
    return df.select(*keep, array(feats).alias("ins_feat"), array(rest).alias("f_rest"))


def write_ply(df: DataFrame, folder: str, columns: list[tuple[str, str]]) -> DataFrame:
    """One binary PLY per partition below ``folder``; ``columns`` are (name, PLY type). Gives the paths and counts written."""
    names = [c for c, _ in columns]

    def run(batches):
        import uuid

        rows = [np.rec.fromarrays([b[c].to_numpy() for c in names], dtype=[(c, "<" + NUMPY[t]) for c, t in columns]) for b in batches if len(b)]
        if not rows:
            return
        os.makedirs(folder, exist_ok=True)
        n = sum(len(r) for r in rows)
        path = f"{folder}/part-{uuid.uuid4().hex}.ply"
        head = ["ply", "format binary_little_endian 1.0", f"element vertex {n}", *[f"property {t} {c}" for c, t in columns], "end_header"]
        with open(path, "wb") as f:
            f.write(("\n".join(head) + "\n").encode("ascii"))
            for r in rows:
                f.write(r.tobytes())
        import pandas as pd

        yield pd.DataFrame({"path": [path], "n": [n]})

    return df.select(*names).mapInPandas(run, "path string, n bigint")
