"""Tests of the findings of round 3."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudloom.operators import instances
from cloudloom.operators.instances import coded, decoded


def test_codes_give_their_numbers_again():
    import pyarrow as pa

    parts = [[0], [254, 255, 256], [], [255], [3, 4, 5, 700, 10**6], [0, 1], [509, 510, 765]]
    many = np.array([len(p) for p in parts])
    codes = coded(np.array([x for p in parts for x in p]), many)
    kept = [k for k, p in enumerate(parts) if p]
    assert [x.tolist() for x in decoded(pa.array([codes[k] for k in kept]), many[kept])] == [parts[k] for k in kept]


def some(spark):
    """Three scenes whose masks overlap, those of a view without a point in common; once in long form and once with codes."""
    r = random.Random(5)
    rows, packed = [], []
    for g in range(3):
        for v in range(40):
            free = list(range(300))
            r.shuffle(free)
            c = [r.randrange(260) for _ in range(4)]
            for k in range(4):
                mine = sorted(p for p in range(c[k], c[k] + r.randrange(40)) if p < 300 and p in free)
                free = [p for p in free if p not in mine]
                if len(mine) >= 3:
                    rows += [(g, v, k, p) for p in mine]
                    packed.append((g, v, k, len(mine), bytearray(coded(np.array(mine), np.array([len(mine)]))[0])))
    long = spark.createDataFrame(rows, "g bigint, view_idx bigint, mask_id int, point_id int")
    return long, spark.createDataFrame(packed, "_g bigint, view bigint, mask_id int, n bigint, code binary")


@pytest.mark.parametrize("layer", [None, 3])
def test_a_coded_fold_equals_the_fold_of_rows(spark, monkeypatch, layer):
    """g_fuse wrote a row for each point of a mask, and groups of many such points met in rounds of joins."""
    long, packed = some(spark)
    want = sorted(map(tuple, instances.best_instance(instances.fuse(long, "g", 3, 0.2), ["g"], 1).collect()))
    if layer:
        # also where lists are many and made anew at each view
        got = []
        batches = packed.orderBy("_g", "view", "mask_id").toArrow().to_batches()
        monkeypatch.setattr(instances._Sets, "LAYER", layer)
        monkeypatch.setattr(instances._Sets, "FRESH", 1)
        for b in instances._fold_coded(iter(batches), 0.2, False):
            got += zip(*[c.to_pylist() for c in b.columns])
    else:
        got = instances.fuse_coded(packed, 0.2).collect()
    assert sorted(map(tuple, got)) == want and len(want) > 500


def test_points_of_masks_are_not_shuffled_as_rows_by_g_fuse(spark):
    """F1."""
    import __spark_entry__ as entry

    plan = entry.queries()["g_fuse"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "collect_set" not in plan and "Generate explode(points" not in plan and "code" in plan


@pytest.mark.parametrize("layer", [None, 3])
def test_coded_masks_meet_once_and_give_the_same_components(spark, monkeypatch, layer):
    """g_fuse_by_graph repeated a mask once for each block of its scene, which grows with the square of the scene."""
    long, packed = some(spark)
    packed = packed.withColumn("node", F.xxhash64("_g", "view", "mask_id"))
    want = sorted(map(tuple, instances.best_instance(instances.fuse_by_graph(long, "g", 3, 0.2), ["g"], 1).collect()))
    if layer:
        got = []
        monkeypatch.setattr(instances._Graph, "LAYER", layer)
        monkeypatch.setattr(instances._Graph, "FRESH", 1)
        for b in instances._fold_coded(iter(packed.orderBy("_g", "view", "mask_id").toArrow().to_batches()), 0.2, True):
            got += zip(*[c.to_pylist() for c in b.columns])
    else:
        found = instances.fuse_by_graph_coded(packed, 0.2)
        assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
        got = found.collect()
    assert sorted(map(tuple, got)) == want and len(want) > 500
