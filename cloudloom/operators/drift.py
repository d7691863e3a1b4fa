"""Schemas that drift between files (problem 3).

Each vertex row is loaded as a map from field name to raw text next to the declared types; statistics of fields and types are
aggregated per file; a field that disappears is compared with each field that appears, over the same vertices; the lineage of names
gives one consistent table of typed values, with casts that failed reported per file and field.

Defined results: a file without a readable vertex element has no fields; a property that a header names twice counts once, at its
first place; a file without an earlier file in its series has no changes; of repeated rows of a file the one loaded last (then the
larger text) counts, of a vertex the greater values; a missing number (NA, nan, empty) takes no part in the comparison of values;
fields are renamed one to one, ties going to the most equal relative place; a name that is free again may start a second lineage,
which then is called name#file.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..util import cut, drop, hot_keys, salted_join

# The scalar types of the PLY format and their other spellings.
PLY_TYPES = {
    "int8": "char",
    "uint8": "uchar",
    "int16": "short",
    "uint16": "ushort",
    "int32": "int",
    "uint32": "uint",
    "float32": "float",
    "float64": "double",
}
# The least and greatest numbers of the whole types, and the greatest of the float type.
RANGES = {"char": (-128, 127), "uchar": (0, 255), "short": (-32768, 32767), "ushort": (0, 65535), "int": (-2147483648, 2147483647), "uint": (0, 4294967295)}
FLOAT_MAX = 3.4028234663852886e38
#: Texts that stand for a missing number, in lower case.
MISSING = ["", "na", "n/a", "nan", "null", "none", "-"]


def header_fields(header: Column) -> Column:
    """Array of struct(name, type, pos) of the vertex properties of an ASCII PLY header; other elements are passed over."""
    vertex = F.regexp_extract(header, r"(?ms)^\s*element\s+vertex\b[^\r\n]*[\r\n]+(.*?)(?=^\s*(?:element|end_header)\b|\z)", 1)
    line = F.lit(r"(?m)^[ \t]*property[ \t]+(\S.*?)[ \t]+(\S+)[ \t]*$")
    types = F.create_map(*[F.lit(x) for kv in PLY_TYPES.items() for x in kv])

    def field(p, i):
        words = F.transform(F.split(F.lower(p["kind"]), r"\s+"), lambda t: F.coalesce(F.try_element_at(types, t), t))
        return F.struct(p["name"].alias("name"), F.array_join(words, " ").alias("type"), i.alias("pos"))

    all_ = F.transform(F.arrays_zip(F.regexp_extract_all(vertex, line, F.lit(1)).alias("kind"), F.regexp_extract_all(vertex, line, F.lit(2)).alias("name")), field)
    return F.filter(all_, lambda f, i: ~F.exists(F.slice(all_, 1, i), lambda g: g["name"] == f["name"]))


def files(ply_files: DataFrame) -> DataFrame:
    """One row per file: file_id, series, prev_id (the file of the series written before), fields."""
    one = (
        ply_files.where(F.col("file_id").isNotNull())
        .groupBy("file_id")
        .agg(F.max(F.struct("loaded_at", "ply_header", "series", "written_at")).alias("r"))
        .select("file_id", "r.series", "r.written_at", F.coalesce(header_fields(F.col("r.ply_header")), F.array().cast("array<struct<name:string,type:string,pos:int>>")).alias("fields"))
    )
    # the window carries ids only, so a series of many files sorts a few bytes a file
    order = one.select("file_id", "series", "written_at").withColumn(
        "prev_id", F.lag("file_id").over(Window.partitionBy("series").orderBy("written_at", "file_id"))
    )
    return one.drop("series", "written_at").join(order, "file_id").select("file_id", "series", "written_at", "prev_id", "fields")


def _words(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")


def vertex_maps(ply_vertices: DataFrame, fs: DataFrame) -> DataFrame:
    """Vertices as path-value maps of raw text: file_id, vertex_idx, raw (MAP name -> text). Fields beyond a short row are absent."""
    hot = hot_keys(ply_vertices, "file_id")
    one = ply_vertices.where(F.col("record_text").isNotNull()).groupBy("file_id", "vertex_idx").agg(F.max("record_text").alias("t"))
    joined = salted_join(one.withColumn("w", _words(F.col("t"))), fs.select("file_id", "fields"), ["file_id"], hot=hot)
    there = F.filter("fields", lambda f: f["pos"] < F.size("w"))
    return joined.select("file_id", "vertex_idx", F.map_from_entries(F.transform(there, lambda f: F.struct(f["name"].alias("k"), F.get("w", f["pos"]).alias("v")))).alias("raw"))


def number(text: Column) -> Column:
    """The number a raw text stands for, decimal commas included; null where there is none."""
    clean = F.translate(text, ",", ".")
    return F.when(F.lower(clean).isin(MISSING), None).otherwise(clean.try_cast("double"))


def half_unit(text: Column) -> Column:
    """Half a unit of the last printed digit of a raw number."""
    parts = F.split(F.lower(F.translate(text, ",", ".")), "e")
    decimals = F.length(F.substring_index(parts[0], ".", -1)) * parts[0].contains(".").cast("int")
    exponent = F.coalesce(F.try_element_at(parts, F.lit(2)).try_cast("int"), F.lit(0))
    return 0.5 * F.pow(F.lit(10.0), (exponent - decimals).cast("double"))


def failed_cast(kind: Column, text: Column) -> Column:
    """Whether a raw text that is no missing number isn't a number of the type: no number, a fraction of a whole type, or out of range."""
    value = number(text)
    missing = text.isNull() | F.lower(F.trim(text)).isin(MISSING)
    bad = value.isNull() | F.isnan(value)
    for name, (low, high) in RANGES.items():
        bad = bad | ((kind == name) & ((value != F.floor(value)) | (value < low) | (value > high)))
    bad = bad | ((kind == "float") & (F.abs(value) > FLOAT_MAX)) | ((kind == "double") & (F.abs(value) == float("inf")))
    return ~missing & F.coalesce(bad, F.lit(True))


def type_statistics(maps: DataFrame, fs: DataFrame) -> DataFrame:
    """Per file and field: declared type, vertices, missing values, values that aren't of the declared type, smallest and largest value."""
    types = fs.select("file_id", F.explode("fields").alias("f")).select("file_id", F.col("f.name").alias("field"), F.col("f.type").alias("type"))
    long = maps.select("file_id", F.explode("raw").alias("field", "text"))
    value = number(F.col("text"))
    stats = salted_join(long, types, ["file_id", "field"]).groupBy("file_id", "field", "type")
    return stats.agg(
        F.count("*").alias("n_values"),
        F.count_if(F.lower(F.trim("text")).isin(MISSING) | F.col("text").isNull()).alias("n_missing"),
        F.count_if(failed_cast(F.col("type"), F.col("text"))).alias("n_failed_cast"),
        F.min(value).alias("min_value"),
        F.max(value).alias("max_value"),
    )


def _one_to_one(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of the candidate renames of one file, the best disjoint ones. Its rows are bounded by the squared number of fields."""
    pdf = pdf.sort_values(["share", "place", "old_pos", "new_pos"], ascending=[False, True, True, True])
    old, new, keep = set(), set(), []
    for i, (a, b) in enumerate(zip(pdf["old_field"], pdf["new_field"])):
        if a not in old and b not in new:
            old.add(a)
            new.add(b)
            keep.append(i)
    return pdf.iloc[keep][["file_id", "old_field", "new_field"]]


def differences(fs: DataFrame) -> DataFrame:
    """Per file with an earlier one in its series: file_id, prev_id, gone, come, stayed (arrays of fields). One join of ids and headers;
    names are compared within the row."""
    before = fs.select(F.col("file_id").alias("prev_id"), F.col("fields").alias("old"))
    both = fs.where(F.col("prev_id").isNotNull()).join(before, "prev_id")
    name = lambda fields: F.transform(fields, lambda f: f["name"])
    without = lambda a, b: F.filter(a, lambda f: ~F.array_contains(name(b), f["name"]))
    stayed = F.transform(
        F.filter("fields", lambda f: F.array_contains(name("old"), f["name"])),
        lambda f: F.struct(f["name"].alias("name"), F.filter("old", lambda o: o["name"] == f["name"])[0]["type"].alias("old_type"), f["type"].alias("new_type")),
    )
    return both.select("file_id", "prev_id", without("old", "fields").alias("gone"), without("fields", "old").alias("come"), stayed.alias("stayed"))


def renames(ply_vertices: DataFrame, diff: DataFrame, min_share: float = 0.98) -> DataFrame:
    """file_id, old_field, new_field of fields that were renamed: at least ``min_share`` of the vertices that have both values hold the
    same number up to half a unit of the last printed digits of both.

    Only files that lost and gained fields are looked at, and of their vertices only the values of these fields are shuffled, once,
    to the vertex of both files.
    """
    asked = diff.where((F.size("gone") > 0) & (F.size("come") > 0))
    place = lambda c: F.transform(c, lambda f: f["pos"])
    roles = asked.select(F.col("file_id").alias("pair"), "file_id", F.lit(True).alias("new"), place("come").alias("at")).unionByName(
        asked.select(F.col("file_id").alias("pair"), F.col("prev_id").alias("file_id"), F.lit(False).alias("new"), place("gone").alias("at"))
    )
    roles = cut(roles)
    hot = hot_keys(ply_vertices, "file_id")
    rows = salted_join(ply_vertices.where(F.col("record_text").isNotNull()).select("file_id", "vertex_idx", "record_text"), roles, ["file_id"], hot=hot)
    words = rows.withColumn("w", _words(F.col("record_text"))).select("pair", "vertex_idx", "new", F.transform("at", lambda i: F.get("w", i)).alias("t"))
    vertex = words.groupBy("pair", "vertex_idx").agg(F.max(F.when(F.col("new"), F.col("t"))).alias("b"), F.max(F.when(~F.col("new"), F.col("t"))).alias("a"))
    read = lambda c: F.transform(c, lambda t: F.struct(number(t).alias("x"), half_unit(t).alias("h")))
    parsed = vertex.where(F.col("a").isNotNull() & F.col("b").isNotNull()).select("pair", read("a").alias("a"), read("b").alias("b"))
    crossed = parsed.select("pair", "b", F.posexplode("a").alias("i", "p")).select("pair", "i", "p", F.posexplode("b").alias("j", "q"))
    same = F.abs(F.col("p.x") - F.col("q.x")) <= 1.01 * (F.col("p.h") + F.col("q.h"))
    good = crossed.where(F.col("p.x").isNotNull() & F.col("q.x").isNotNull()).groupBy("pair", "i", "j").agg(F.avg(same.cast("double")).alias("share")).where(F.col("share") >= min_share)
    named = good.join(asked.select(F.col("file_id").alias("pair"), "gone", "come"), "pair").withColumn("o", F.get("gone", F.col("i"))).withColumn("n", F.get("come", F.col("j")))
    scored = named.select(
        F.col("pair").alias("file_id"), F.col("o.name").alias("old_field"), F.col("n.name").alias("new_field"), "share",
        F.abs(F.col("o.pos") - F.col("n.pos")).alias("place"), F.col("o.pos").alias("old_pos"), F.col("n.pos").alias("new_pos"),
    )
    return scored.groupBy("file_id").applyInPandas(_one_to_one, "file_id bigint, old_field string, new_field string")


def changes(fs: DataFrame, ply_vertices: DataFrame, min_share: float = 0.98) -> DataFrame:
    """Changes of the vertex fields of each file against the previous one: file_id, change_kind, old_field, new_field, old_type, new_type."""
    diff = cut(differences(fs))
    pairs = renames(ply_vertices, diff, min_share).groupBy("file_id").agg(F.collect_list(F.struct("old_field", "new_field")).alias("renamed"))
    one = diff.join(pairs, "file_id", "left").withColumn("renamed", F.coalesce("renamed", F.array().cast("array<struct<old_field:string,new_field:string>>")))
    empty = F.lit("")

    def row(kind: str, old, new, old_type, new_type):
        return F.struct(F.lit(kind).alias("change_kind"), old.alias("old_field"), new.alias("new_field"), old_type.alias("old_type"), new_type.alias("new_type"))

    kind_of = lambda fields, name: F.get(F.filter(fields, lambda f: f["name"] == name), F.lit(0))["type"]
    added = F.transform(F.filter("come", lambda f: ~F.exists("renamed", lambda r: r["new_field"] == f["name"])), lambda f: row("added", empty, f["name"], empty, f["type"]))
    removed = F.transform(F.filter("gone", lambda f: ~F.exists("renamed", lambda r: r["old_field"] == f["name"])), lambda f: row("removed", f["name"], empty, f["type"], empty))
    moved = F.transform("renamed", lambda r: row("renamed", r["old_field"], r["new_field"], kind_of("gone", r["old_field"]), kind_of("come", r["new_field"])))
    retyped = F.transform(F.filter("stayed", lambda f: f["old_type"] != f["new_type"]), lambda f: row("retyped", f["name"], f["name"], f["old_type"], f["new_type"]))
    moved_too = F.transform(F.filter(moved, lambda m: m["old_type"] != m["new_type"]), lambda m: row("retyped", m["old_field"], m["new_field"], m["old_type"], m["new_type"]))
    return one.select("file_id", F.explode(F.concat(added, removed, moved, retyped, moved_too)).alias("c")).select("file_id", "c.*")


def lineage(fs: DataFrame, drift: DataFrame) -> DataFrame:
    """file_id, field, path, kind: each field's path (the name of its first ancestor in the series) and its lineage's type: whole,
    float or double, the narrowest that holds all declared types.

    A field's ancestor is the field of its name in the previous file, or the one it was renamed from. The first is found by pointer
    jumping: a series of n files takes log n rounds, and no series meets in one task.
    """
    field = fs.select("file_id", "series", "written_at", "prev_id", F.explode("fields").alias("f")).select("file_id", "series", "written_at", "prev_id", F.col("f.name").alias("field"), F.col("f.type").alias("type"))
    moved = drift.where("change_kind = 'renamed'").select("file_id", F.col("new_field").alias("field"), F.col("old_field").alias("was"))
    new = drift.where("change_kind = 'added'").select("file_id", F.col("new_field").alias("field"), F.lit(True).alias("added"))
    step = field.join(moved, ["file_id", "field"], "left").join(new, ["file_id", "field"], "left")
    first = F.col("prev_id").isNull() | F.coalesce("added", F.lit(False))
    link = cut(step.select("file_id", "field", F.when(first, F.col("file_id")).otherwise(F.col("prev_id")).alias("up_file"), F.when(first, F.col("field")).otherwise(F.coalesce("was", "field")).alias("up_field")))
    while True:
        over = link.select(F.col("file_id").alias("up_file"), F.col("field").alias("up_field"), F.col("up_file").alias("top_file"), F.col("up_field").alias("top_field"))
        jumped = link.join(over, ["up_file", "up_field"]).select("file_id", "field", F.col("top_file").alias("up_file"), F.col("top_field").alias("up_field"), ((F.col("top_file") != F.col("up_file")) | (F.col("top_field") != F.col("up_field"))).alias("moved"))
        jumped = cut(jumped)
        drop(link)
        link = jumped
        if link.where("moved").isEmpty():
            break
    root = field.join(link.drop("moved"), ["file_id", "field"])
    rank = {"double": 2, "float": 1}
    wide = F.max(F.when(F.col("type").isin(list(RANGES)), 0).otherwise(F.coalesce(*[F.when(F.col("type") == t, r) for t, r in rank.items()], F.lit(2))))
    any_whole = F.max(F.col("type").isin("int", "uint"))
    kinds = root.groupBy("series", "up_file", "up_field").agg(wide.alias("w"), any_whole.alias("whole"))
    # a float can't hold every whole number of 32 bits
    kinds = kinds.withColumn("kind", F.when(F.col("w") == 0, "whole").when((F.col("w") == 1) & ~F.col("whole"), "float").otherwise("double"))
    starts = kinds.join(fs.select(F.col("file_id").alias("up_file"), "written_at"), "up_file")
    # lineages that start with one name in one series: few
    number_ = F.row_number().over(Window.partitionBy("series", "up_field").orderBy("written_at", "up_file"))
    named = starts.withColumn("k", number_).select("up_file", "up_field", "kind", F.when(F.col("k") == 1, F.col("up_field")).otherwise(F.concat_ws("#", "up_field", F.col("up_file").cast("string"))).alias("path"))
    return root.join(named, ["up_file", "up_field"]).select("file_id", "field", "path", "kind")


def consistent(maps: DataFrame, lines: DataFrame) -> DataFrame:
    """One consistent table in long form: file_id, vertex_idx, path, kind, text, value (a double), failed (no number of the lineage's type).

    ``lines`` is the result of ``lineage``.
    """
    named = lines.groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("field", F.struct("path", "kind")))).alias("paths"))
    wide = salted_join(maps, named, ["file_id"]).select("file_id", "vertex_idx", F.explode("raw").alias("field", "text"), "paths").withColumn("p", F.col("paths")[F.col("field")])
    declared = F.when(F.col("p.kind") == "whole", "int").otherwise(F.col("p.kind"))
    value = number(F.col("text"))
    whole_bad = (F.col("p.kind") == "whole") & (value != F.floor(value))
    failed = F.when(F.col("p.kind") == "whole", failed_cast(F.lit("double"), F.col("text")) | F.coalesce(whole_bad, F.lit(False))).otherwise(failed_cast(declared, F.col("text")))
    return wide.select("file_id", "vertex_idx", "p.path", "p.kind", "text", F.when(~failed, value).alias("value"), failed.alias("failed"))
