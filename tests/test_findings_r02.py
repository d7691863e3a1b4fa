"""Tests of the findings of round 2."""

import numpy as np
from pyspark.sql import functions as F

from cloudloom import util
from cloudloom.operators import geometry, rasters, spatial, views, voxels


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_small_side_that_is_broadcast_is_not_repeated(spark):
    """the planner broadcast the 32 repeats of a table that is small on disk, through the driver."""
    small = util.cut(spark.range(2000).select(F.col("id").alias("k"), F.lit(1).alias("v")))
    big = spark.range(20000).select((F.col("id") % 2000).alias("k"), F.col("id").alias("w"))
    out = util.salted_join(big, small, ["k"])
    assert "BroadcastHashJoin" in plan(out) and "Generate" not in plan(out)
    assert out.count() == 20000


def test_components_fold_and_labels_agree(spark):
    """components in one fold of the links and by labels are the same, as by a search."""
    rng = np.random.default_rng(5)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, size=(300, 2))] + [(1000 + k, 1001 + k) for k in range(100)] + [(2000, 2100 + k) for k in range(200)]
    ids = sorted({x for e in links for x in e} | {5000})
    want = {i: i for i in ids}
    moved = True
    while moved:
        moved = False
        for a, b in links:
            low = min(want[a], want[b])
            moved |= want[a] != low or want[b] != low
            want[a] = want[b] = low
    nodes = spark.createDataFrame([(i,) for i in ids], "node int")
    edges = spark.createDataFrame(links, "a int, b int").repartition(5)
    for local in (10**6, 0):
        got = spatial.components(nodes, edges, local)
        assert got.dtypes == [("node", "int"), ("component", "int")]
        assert {r.node: r.component for r in got.collect()} == want


def scene_views(spark):
    """Two scenes, perspective and orthographic views, points in shared pixels, equal depths and no coordinates."""
    rng = np.random.default_rng(3)
    xyz = np.round(rng.uniform(-6, 6, size=(6000, 3)), 1)
    rows = [(int(i), "ab"[int(i) % 3 == 0], *map(float, p), float(i % 11)) for i, p in enumerate(xyz)] + [(9000, "a", None, 0.0, 0.0, 1.0), (9001, "a", float("nan"), 0.0, 0.0, 1.0), (9002, None, 0.0, 0.0, 1.0, 1.0)]
    pts = spark.createDataFrame(rows, "point_id bigint, scene string, x double, y double, z double, w double")
    views = []
    for i in range(12):
        t = i * 0.7
        r = [float(x) for x in (np.cos(t), 0.0, np.sin(t), 0.0, 0.0, 1.0, 0.0, 0.0, -np.sin(t), 0.0, np.cos(t), 4.0, 0.0, 0.0, 0.0, 1.0)]
        mode = [None, "perspective", "orthographic", "Orthographic"][i % 4]
        views.append((i, "abc"[i % 3], r if i != 7 else [None, *r[1:]], None if i % 5 == 0 else 40.0, 45.0, None, 20.0, 48, 40, mode, -5.0, 5.0, -4.0, 4.0 if i != 10 else -4.0, ["auto", "direct", None][i % 3]))
    vw = spark.createDataFrame(views, "view_idx int, scene string, w2c array<double>, fx double, fy double, cx double, cy double, width int, height int, projection_mode string, ortho_x_min double, ortho_x_max double, ortho_y_min double, ortho_y_max double, ortho_v_mode string")
    return pts, vw


def test_visible_is_the_nearest_of_each_projected_pixel(spark):
    """views are thinned out where they are projected, in one block or many, without a shuffle of pixels."""
    pts, vw = scene_views(spark)
    cols = ["view_idx", "point_id", "u", "v", "depth"]
    want = sorted(views.nearest_per_pixel(views.project(pts, vw)).select(*cols).collect())
    assert len({r.view_idx for r in want}) > 5
    w = {r.point_id: r.w for r in pts.collect()}
    for block, pairs in ((1 << 20, 1 << 25), (700, 3000), (5000, 1)):
        got = views.visible(pts, vw, ("w",), block, pairs).collect()
        assert sorted(tuple(r[c] for c in cols) for r in got) == [tuple(r) for r in want]
        assert all(r.w == w[r.point_id] for r in got)
    assert views.visible(pts, vw)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(scene") >= 1
    assert "hashpartitioning(view_idx" not in plan(views.visible(pts, vw))


def test_painting_does_not_depend_on_the_order_of_rows():
    """of a mask's repeated pixels any may stay, but its greatest score counts."""
    import pandas as pd

    rows = pd.DataFrame([(0, 1, 0.2, 0, 0), (0, 1, 0.9, 0, 0), (0, 2, 0.5, 0, 0)], columns=["view_idx", "mask_id", "score", "v", "u"])
    for order in ([0, 1, 2], [1, 0, 2], [2, 1, 0]):
        assert rasters.painter()(rows.iloc[order])["mask_id"].tolist() == [1]


def test_each_view_is_worked_on_where_it_is_seen(spark):
    """a function of a view's rows gives the same in one block and in many."""
    pts, vw = scene_views(spark)
    count = lambda pdf: pdf.groupby("view_idx", as_index=False).agg(n=("w", "sum"))
    got = [sorted(map(tuple, views.visible(pts, vw, ("w",), block, each=(count, "view_idx int, n double")).collect())) for block in (1 << 20, 700)]
    assert got[0] == got[1] and len(got[0]) > 5


def test_boxes_of_many_groups_are_suppressed_as_alone(spark):
    """F16: many groups go to one call; each keeps the boxes that it keeps alone."""
    rng = np.random.default_rng(1)
    rows = [(int(i % 7), int(i % 3), i, *map(float, (x, y, x + 8, y + 8)), float(s)) for i, (x, y, s) in enumerate(rng.integers(0, 20, size=(200, 3)))]
    cols = "view_idx int, cls int, box_id int, x0 double, y0 double, x1 double, y1 double, score double"
    got = sorted(map(tuple, rasters.suppress(spark.createDataFrame(rows, cols), ["view_idx", "cls"], 0.3).collect()))
    want = []
    for g in {r[:2] for r in rows}:
        kept = []
        for r in sorted((r for r in rows if r[:2] == g), key=lambda r: (-r[7], r[2])):
            inter = [max(min(r[5], k[5]) - max(r[3], k[3]), 0) * max(min(r[6], k[6]) - max(r[4], k[4]), 0) for k in kept]
            if all(i / (128 - i) <= 0.3 for i in inter):
                kept.append(r)
        want += kept
    assert got == sorted(want) and len(got) < 200


def test_rounds_of_the_consensus_share_their_code(spark):
    """class shares stood as numbers in the generated code, so each round was compiled and kept anew in the driver."""
    from cloudloom.llm import consensus

    votes = spark.createDataFrame([(v, a, (v + a) % 2, 3) for v in range(20) for a in range(3)], "view_idx int, annotator_id int, j int, m bigint")
    table = spark.createDataFrame([(a, j, [-0.1 * (j + 1), -0.2 * (a + 1)]) for a in range(3) for j in range(2)], "annotator_id int, j int, l array<double>")
    compiled = spark._jvm.org.apache.spark.metrics.source.CodegenMetrics.METRIC_COMPILATION_TIME()

    def run(*share):
        model = consensus.Model([3, 4], np.array(share), table, 2.0, 0.5, 1)
        return {(r.view_idx, r.annotator_id): (r.q0, r.q1) for r in consensus._probabilities(votes, model, table).collect()}

    first = run(5.0, 7.0)
    n = compiled.getCount()
    second = run(50.0, 7.5)
    assert compiled.getCount() == n
    digamma = lambda s: consensus._digamma(np.array(s)) - consensus._digamma(np.array([sum(s)]))
    lift = digamma([50.0, 7.5]) - digamma([5.0, 7.0])
    for k, (a, b) in first.items():
        assert abs(np.log(second[k][0] / second[k][1]) - np.log(a / b) - (lift[0] - lift[1])) < 1e-9


def test_pixels_of_masks_are_made_once(spark):
    """the raster, which may be a whole projection, was computed for each of its uses."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    px = spark.createDataFrame([(0, v, u, 1) for v in range(3) for u in range(3)], "view_idx int, v int, u int, mask_id int").mapInArrow(count, "view_idx int, v int, u int, mask_id int")
    assert {r.area for r in rasters.mask_components(px).collect()} == {9}
    assert made.value == 9


def test_neighbours_in_slabs_are_those_of_all_pairs(spark):
    """nearest_k repeated every point in 27 cells and ran its search again with a doubled radius for the points that stand apart."""
    rng = np.random.default_rng(7)
    xyz = np.round(np.concatenate([rng.normal(0, 2, size=(500, 3)), rng.uniform(-300, 300, size=(20, 3)), np.ones((30, 3))]), 1)
    rows = [(int(i), "ab"[i % 4 == 0], *map(float, p)) for i, p in enumerate(xyz)] + [(900, "c", 0.0, 0.0, 0.0), (901, None, 0.0, 0.0, 0.0), (902, "a", None, 0.0, 0.0), (903, "a", float("nan"), 0.0, 0.0)]
    df = spark.createDataFrame(rows, "id int, scene string, x double, y double, z double")
    some = df.where("id % 3 = 0")
    good = [r for r in rows[:551]]

    def brute(k, pool, apart):
        out = set()
        for a in good:
            near = sorted((np.sqrt(sum((np.array(a[2:]) - np.array(b[2:])) ** 2)), b[0]) for b in pool if b[1] == a[1] and (apart or b[0] != a[0]))
            out |= {(a[0], b, round(float(d), 9), r + 1) for r, (d, b) in enumerate(near[: k(len([b for b in pool if b[1] == a[1]]))])}
        return out

    as_set = lambda got: {(r.a, r.b, round(r.dist, 9), r["rank"]) for r in got.collect()}
    for slab in (1 << 18, 60):
        assert as_set(spatial.nearest_k(df, "id", ["scene"], 0.3, 3, slab=slab)) == brute(lambda n: 3, good, False)
        assert as_set(spatial.nearest_k(df, "id", ["scene"], 0.3, lambda n: F.floor(F.sqrt(n)), slab=slab)) == brute(lambda n: int(n**0.5), good, False)
        assert as_set(spatial.nearest_k(df, "id", ["scene"], 0.3, 1, others=some, slab=slab)) == brute(lambda n: 1, [r for r in good if r[0] % 3 == 0], True)
    spark.sparkContext.setJobGroup("far", "far")
    spatial.nearest_k(df, "id", ["scene"], 1e-6, 3)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("far"))
    spark.sparkContext.setJobGroup("", "")
    assert jobs < 20


def test_alignment_reads_its_points_once(spark):
    """each round made source and target anew, with the shuffle that made them."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    rng = np.random.default_rng(2)
    kind = "id bigint, x double, y double, z double"
    source = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(rng.uniform(-9, 9, size=(200, 3)))], kind).mapInArrow(count, kind)
    goal = source.select("id", (F.col("x") + 0.05).alias("x"), "y", "z")
    scale, rot, shift = geometry.align(source, goal, "id", 1.0, 3, 1.0)
    assert made.value == 400
    assert abs(scale - 1) < 1e-9 and np.allclose(rot, np.eye(3)) and np.allclose(shift, [0.05, 0, 0])


def test_blocks_are_blended_where_they_are_projected(spark):
    """every projected point, hidden ones too, was shuffled to its pixel block and joined with its colour."""
    pts, vw = scene_views(spark)
    pts = pts.withColumns({"alpha": F.when(F.col("point_id") % 5 == 0, F.lit(0.001)).when(F.col("point_id") % 7 == 0, F.lit(1.0)).otherwise((F.col("point_id") % 13) / 14), "red": F.col("w") / 11})
    seen = views.project(pts, vw).join(pts.select("point_id", "alpha", "red"), "point_id")
    folded = voxels.composite(F.col("alpha"), F.col("red"), F.struct("depth", "point_id")).alias("s")
    want = seen.groupBy("view_idx", F.floor(F.col("u") / 16).alias("bu"), F.floor(F.col("v") / 16).alias("bv")).agg(folded).select("view_idx", "bu", "bv", "s.colour", "s.left")
    want = sorted(map(tuple, want.collect()))
    blend, pick = voxels.blender(16, "point_id", "alpha", "red")
    for block in (1 << 20, 700):
        out = views.visible(pts, vw, ("alpha", "red"), block, each=(blend, "view_idx int, bu bigint, bv bigint, red double, light double"), pick=pick)
        assert sorted(map(tuple, out.collect())) == want and len(want) > 40
    assert "ObjectHashAggregate" not in plan(out) and "SortMergeJoin" not in plan(out)


def test_pairs_of_wide_cells_are_those_of_narrow_ones(spark):
    """every point was repeated in 27 cells, which filled the disk."""
    rng = np.random.default_rng(4)
    rows = [(i, "ab"[i % 2], *map(float, p), (0.5, 1.25)[i % 2]) for i, p in enumerate(np.round(rng.uniform(-4, 4, size=(400, 3)) * 4) / 4)]
    df = spark.createDataFrame(rows, "id bigint, scene string, x double, y double, z double, eps double")
    narrow = sorted(map(tuple, spatial.within(df, "id", ["scene"], "eps").collect()))
    assert sorted(map(tuple, spatial.within(df, "id", ["scene"], "eps", side=3.0).collect())) == narrow and len(narrow) > 50
    assert sorted(map(tuple, spatial.within(df, "id", ["scene"], 1.0, side=2.0).collect())) == sorted(map(tuple, spatial.within(df, "id", ["scene"], 1.0).collect()))
