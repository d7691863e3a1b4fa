"""Tests that the registered queries do their whole job on the smallest tables."""

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def frame(name):
    return pq.read_table(f"{DATA}/{name}.parquet").to_pandas()


@pytest.mark.parametrize("name", ["j_project_zbuffer", "a_votes", "a_image_iou"])
def test_every_view_takes_part(spark, name):
    db = duckdb.connect()
    for t in ("points", "camera_views"):
        db.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    # the registered SQL without its filter of views
    want = db.execute(entry.oracle_sql()[name].replace("WHERE view_idx%2=0 ", "")).fetchall()
    got = rows(entry.queries()[name](spark, DATA))
    assert len(got) == len(want) > 0
    for a, b in zip(got, sorted(want)):
        assert a == pytest.approx(b, abs=1e-5)


def test_keep_lists_come_from_the_tables(spark):
    i, s = frame("images"), frame("sparse_points")
    last = i.sort_values("loaded_at").groupby("image_id").tail(1)
    keep = set(last[last.deleted_at.isna()].image_id)
    tracks = s.dropna(subset=["track"]).drop_duplicates("point3d_id")
    n = {r.point3d_id: sum(o["image_id"] in keep for o in r.track) for r in tracks.itertuples()}
    assert rows(entry.queries()["p_track_length"](spark, DATA)) == sorted((k, v) for k, v in n.items() if v >= 2)
    v, m = frame("camera_views"), frame("mask_labels")
    bare = lambda x: x.replace("\\", "/").split("/")[-1]
    names = {bare(x) for x in m.view_name.dropna()}
    lower, stems = {x.lower() for x in names}, {x.rpartition(".")[0] or x for x in names}
    masks = {bare(x) for x in m.mask_path.dropna()}
    want = {r.view_idx for r in v.itertuples() if r.name.lower() in lower or r.name.rpartition(".")[0] in stems or (r.mask_path and bare(r.mask_path).rpartition(".")[0] in {x.rpartition(".")[0] or x for x in masks})}
    assert {r.view_idx for r in entry.queries()["p_whitelist"](spark, DATA).collect()} == want


def test_nearest_of_points_far_from_all_others(spark):
    from cloudloom.operators import spatial

    rng = np.random.default_rng(2)
    x = np.concatenate([rng.random((60, 3)), rng.random((6, 3)) * 500])
    df = spark.createDataFrame([(i, "s", *map(float, p)) for i, p in enumerate(x)] + [(90, "two", 0.0, 0.0, 0.0), (91, "two", 40.0, 0.0, 0.0), (92, "one", 1.0, 1.0, 1.0), (93, "s", None, 0.0, 0.0)], "id bigint, scene string, x double, y double, z double")
    got = {}
    for a, b, dist, rank in rows(spatial.nearest_k(df, "id", ["scene"], 0.3, 3).select("a", "b", "dist", "rank")):
        got.setdefault(a, []).append((rank, b, dist))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    for i in range(len(x)):
        assert [b for _, b, _ in sorted(got[i])] == np.argsort(d[i], kind="stable")[:3].tolist()
        assert [v for _, _, v in sorted(got[i])] == pytest.approx(np.sort(d[i])[:3])
    assert got[90] == [(1, 91, 40.0)] and got[91] == [(1, 90, 40.0)] and 92 not in got and 93 not in got


@pytest.mark.parametrize("name", ["j_mean_3nn", "j_sparse_outliers", "a_voxel_size"])
def test_neighbours_have_no_radius(spark, name):
    db = duckdb.connect()
    db.execute(f"create view sparse_points as select * from '{DATA}/sparse_points.parquet'")
    # the registered SQL without its radius
    want = sorted(db.execute(entry.oracle_sql()[name].replace("WHERE dist <= 4.0 ", "")).fetchall())
    got = rows(entry.queries()[name](spark, DATA))
    assert len(got) == len(want) > 0
    for a, b in zip(got, want):
        assert a == pytest.approx(b, abs=2e-4)
