"""Tests of the findings that were left of round 2."""

from pathlib import Path

from pyspark.sql import functions as F

from cloudloom import util
from cloudloom.llm import clusters


def test_tasks_of_a_round_do_not_grow_with_the_files_of_its_rows(spark):
    """a round of p2 read the rows with a task for each file in each of its passes, and every task leaves its record with the driver."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in before:
            spark.conf.set(k, "1024b")  # a task for each file
        x = [F.pmod(F.col("id") * (7 + j), F.lit(1000)).alias(f"x{j}") for j in range(2)]
        rows = spark.range(6000).select("id", F.lit(1).cast("bigint").alias("node"), F.lit(2).alias("open"), *x)
        state = util.cut(rows.repartition(300))
        out, more = clusters.split_round(state, 2, 50.0, 1000)
        files = len(list(Path(out._cut_path.removeprefix("file://")).glob("*.parquet")))
        assert files <= 2 * clusters.TASKS * spark.sparkContext.defaultParallelism
        assert more and out.count() == 6000 and out.select("node").distinct().count() == 2
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def some_masks(spark, views=14):
    """Three groups, one of them null, with masks that overlap, masks of a null view, points of two masks of a view, and small masks."""
    import random

    r = random.Random(11)
    data = []
    for g in ("a", "b", None):
        base = {"a": 0, "b": 1000, None: 2000}[g]
        for v in [*range(views), None]:
            for k in range(4):
                c = base + r.randrange(60)
                data += [(g, v, k, c + r.randrange(14)) for _ in range(r.randrange(25))]
    data += [("a", 0, 0, None)] * 5
    return spark.createDataFrame(data, "scene string, view_idx int, mask_id int, point_id bigint"), data


def test_a_fold_of_a_group_equals_rounds_and_takes_few_jobs(spark):
    """g_fuse ran some 15 rounds, each of which met all masks of a scene in joins."""
    from cloudloom.operators import instances

    df, _ = some_masks(spark)
    cols = ["scene", "instance", "point_id", "votes"]
    order = lambda rows: sorted(map(tuple, rows), key=str)
    spark.sparkContext.setJobGroup("fold", "fold")
    got = order(instances.fuse(df, "scene", 3, 0.2).select(*cols).collect())
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("fold"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 12
    assert got == order(instances.fuse(df, "scene", 3, 0.2, local_rows=0).select(*cols).collect())
    assert len(got) > 100 and all(r[2] is not None for r in got)


def test_masks_meet_without_a_join_of_points(spark, monkeypatch):
    """g_fuse_by_graph joined all masks of a scene by their points and shuffled a row for each pair."""
    from cloudloom.operators import instances

    df, data = some_masks(spark)
    masks: dict = {}
    for g, v, k, p in data:
        if p is not None:
            masks.setdefault((g, v, k), set()).add(p)
    masks = {m: s for m, s in masks.items() if len(s) >= 3}
    group = {m: m for m in masks}
    find = lambda m: m if group[m] == m else find(group[m])
    for a in masks:
        for b in masks:
            both = len(masks[a] & masks[b])
            if a[0] == b[0] and None not in (a[1], b[1]) and a[1] < b[1] and both / (len(masks[a]) + len(masks[b]) - both) >= 0.2:
                group[find(a)] = find(b)
    votes: dict = {}
    for m, s in masks.items():
        for p in s:
            votes.setdefault((m[0], find(m)), {}).setdefault(p, 0)
            votes[m[0], find(m)][p] += 1
    want = sorted((str(k[0]), tuple(sorted(v.items()))) for k, v in votes.items())
    plans = []
    real = instances.components
    monkeypatch.setattr(instances, "components", lambda nodes, links: plans.append(links._jdf.queryExecution().executedPlan().toString()) or real(nodes, links))
    for block in (instances.BLOCK_ROWS, 60):
        found: dict = {}
        for r in instances.fuse_by_graph(df, "scene", 3, 0.2, **({} if block == instances.BLOCK_ROWS else {"block_rows": block})).collect():
            found.setdefault((r.scene, r.instance), {})[r.point_id] = r.votes
        assert sorted((str(k[0]), tuple(sorted(v.items()))) for k, v in found.items()) == want
    assert all("Join [point_id" not in p for p in plans)


def test_points_meet_their_neighbours_without_a_join(spark, monkeypatch):
    """j_mean_3nn repeated every point in 27 cells, a table that the planner took for small and broadcast; later it joined every
    point to its group twice and sent it twice to its task."""
    import __spark_entry__ as entry
    from cloudloom.operators import spatial

    plans, cut = [], spatial.cut
    monkeypatch.setattr(spatial, "cut", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut(df))
    got = entry.queries()["j_mean_3nn"](spark, "/root/testdata/sf0.001")
    assert got.count() > 50 and plans
    assert not [p for p in plans if any(x in p for x in ("Join", "Generate", "Union"))]

    rows = [(i, "abc"[i % 7 // 3], float(i * 37 % 101), float(i * 53 % 97), float(i % 11)) for i in range(400)] + [(400, None, 0.0, 0.0, 0.0), (401, "d", 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "id bigint, scene string, x double, y double, z double")
    left = set(util._LEFT)
    found = []
    for slab in (1 << 18, 70):
        near = spatial.nearest_k(df, "id", ["scene"], 1.0, 3, slab=slab)
        found.append(sorted(map(tuple, near.select("a", "b", "dist", "rank").collect())))
        spatial.drop(near)
        assert set(util._LEFT) == left
    assert found[0] == found[1] and len(found[0]) == 1200
