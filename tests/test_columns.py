"""Lattices inside meshes by column intervals, and the counting of close surfaces."""

import numpy as np
from pyspark.sql import functions as F
from test_spatial import cloud

from meshlark.operators import columns, points as P, spatial as S


CORNERS = ", ".join(f"{c} double" for c in ("ax", "ay", "az", "bx", "by_", "bz", "cx", "cy", "cz"))


def soup(spark, shape):
    return spark.createDataFrame([(k, 0, *map(float, t)) for k, t in enumerate(shape)], f"tri_id bigint, obj_id int, {CORNERS}")


def walked(heights, z):
    last, n = -np.inf, 0
    for h in sorted(heights):
        if h > z and h - last > S.SAME_SURFACE:
            last, n = h, n + 1
    return n


def test_intervals_are_the_walk_upwards():
    rng = np.random.default_rng(6)
    for _ in range(400):
        heights = rng.choice(np.arange(12) * 0.6e-4, rng.integers(1, 9)) + rng.choice([0.0, 1.0], 1)
        lo, hi = columns.inside_between(heights)
        for z in [*heights, *(heights + 0.3e-4), heights.min() - 1]:
            assert ((lo <= z) & (z < hi)).any() == (walked(heights, z) % 2 == 1), (heights, z)


def quad(z):
    return [[0, 0, z, 9, 0, z, 0, 9, z], [9, 9, z, 9, 0, z, 0, 9, z]]


def test_close_hits_restart_from_the_counted_one(spark):
    tris = soup(spark, np.array(quad(1.0) + quad(1.00009) + quad(1.00018), float))
    got = {r["pt_id"]: r["hits"] for r in S.ray_hits(cloud(spark, np.array([[2, 2, 0], [2, 2, 1.00005], [2, 2, 2]], float)), tris).collect()}
    assert got == {0: 2, 1: 1, 2: 0}


def test_inside_lattice_is_the_culled_whole_one(spark):
    """Crossing boxes and a slanted soup: the same points as testing every lattice point."""
    rng = np.random.default_rng(7)
    sphere = []
    for a, b in ((k, k + 1) for k in range(12)):
        for c, d in ((j, j + 1) for j in range(6)):
            at = lambda i, j: [np.cos(i * np.pi / 6) * np.sin(j * np.pi / 6), np.sin(i * np.pi / 6) * np.sin(j * np.pi / 6), np.cos(j * np.pi / 6)]
            sphere += [[*at(a, c), *at(b, c), *at(b, d)], [*at(a, c), *at(b, d), *at(a, d)]]
    for shape in (np.array(sphere), rng.normal(size=(60, 9))):
        tris = soup(spark, shape)
        bounds = P.tri_bounds(tris)
        want = S.cull_raycast(P.volume_scatter(bounds, 24.0), tris, keep="inside").select("pt_id", "x", "y", "z")
        got = columns.volume_scatter_inside(tris, bounds, 24.0).select("pt_id", "x", "y", "z")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 100


def test_nothing_inside(spark):
    flat = soup(spark, np.array(quad(0.0), float))
    box = P.tri_bounds(flat).withColumn("max_z", F.lit(5.0))
    assert columns.volume_scatter_inside(flat, box, 10.0).count() == 0
    assert columns.volume_scatter_inside(flat.limit(0), box, 10.0).count() == 0


def test_columns_stream_over_batches_of_any_size():
    """Crossings cut into batches anywhere give the intervals of the whole columns."""
    import pyarrow as pa

    rng = np.random.default_rng(8)
    columns_ = [rng.choice(np.arange(30) * 0.4e-4, rng.integers(1, 25)) + rng.choice([0.0, 1.0], 1) for _ in range(40)]
    rows = [(0, 1, k, h) for k, c in enumerate(columns_) for h in sorted(c, reverse=True)]
    names, types = ["obj_id", "ix", "iy", "hz"], [pa.int32(), pa.int64(), pa.int64(), pa.float64()]
    kind = pa.schema([("obj_id", pa.int32()), ("ix", pa.int64()), ("iy", pa.int64()), ("lo", pa.float64()), ("hi", pa.float64())])
    want = sorted((k, *map(float, i)) for k, c in enumerate(columns_) for i in zip(*columns.inside_between(c)))
    for size in (1, 2, 3, 7, 50, 10_000):
        batches = [pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(zip(*rows[i:i + size]), types)], names) for i in range(0, len(rows), size)]
        out = [r for b in columns._intervals(kind)(iter(batches)) for r in b.to_pylist()]
        assert sorted((r["iy"], r["lo"], r["hi"]) for r in out) == want


def test_the_boxes_are_the_side_that_is_broadcast(spark):
    tris = soup(spark, np.random.default_rng(9).normal(size=(50, 9)))
    plan = columns.volume_scatter_inside(tris, P.tri_bounds(tris), 20.0)._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.split("\n") if "BroadcastHashJoin" in line]
    assert len(joins) == 2 and all("BuildRight" in line for line in joins)


def test_hits_of_a_tile_are_the_walk_upwards():
    from meshlark.operators import rays

    rng = np.random.default_rng(10)
    tris, at = rng.uniform(-1, 1, (300, 9)), rng.uniform(-1, 1, (40, 3))
    tris[:, 8] = tris[:, 2] = tris[:, 5] = rng.choice(np.arange(60) * 0.4e-4, 300)  # level ones, many of them close
    got = rays.hits_of(at, tris)
    for point, n in zip(at, got):
        a, u, w = tris[:, :2], tris[:, 3:5] - tris[:, :2], tris[:, 6:8] - tris[:, :2]
        p, det = point[:2] - a, u[:, 0] * w[:, 1] - u[:, 1] * w[:, 0]
        s, t = (p[:, 0] * w[:, 1] - p[:, 1] * w[:, 0]) / det, (u[:, 0] * p[:, 1] - u[:, 1] * p[:, 0]) / det
        assert n == walked(tris[(s >= 0) & (t >= 0) & (s + t <= 1), 2], point[2])
    assert got.max() > 5


def test_crowded_tiles_are_parted(spark, monkeypatch):
    monkeypatch.setattr(S, "TILE", 16)
    rng = np.random.default_rng(11)
    xyz = np.vstack([rng.uniform(0, 3, (80, 3)) * (1, 1, 0), np.repeat([[2.0, 2.0, 0.0]], 50, 0), [[1e6, 0, 0], [2, 2, 9]]])
    got = {r["pt_id"]: r["hits"] for r in S.ray_hits(cloud(spark, xyz), soup(spark, np.array(quad(1.0) + quad(2.0), float))).collect()}
    assert got == {i: 0 if i >= 130 else 2 for i in range(132)}


def test_pairs_with_triangles_are_not_sorted(spark, monkeypatch):
    """The nearest of many candidates is kept by hashing; the least of whole rows has all of them sorted first."""
    plans, kept = [], S.cut
    monkeypatch.setattr(S, "cut", lambda df, label: plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df, label))
    rng = np.random.default_rng(12)
    near = S.nearest_triangle(cloud(spark, rng.normal(size=(30, 3))), soup(spark, rng.normal(size=(40, 9))))
    assert near.filter("tri_id IS NULL").count() == 0 and len(plans) > 3 and not any("SortAggregate" in p for p in plans)
