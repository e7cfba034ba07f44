import hashlib

import numpy as np
import pytest

from meshlark.operators import points as P, spatial as S


def cloud(spark, xyz, obj=0):
    return spark.createDataFrame([(obj, i, *map(float, p)) for i, p in enumerate(xyz)], "obj_id int, pt_id bigint, x double, y double, z double")


def brute_knn(xyz, k):
    d = ((xyz[:, None] - xyz[None]) ** 2).sum(2)
    out = {}
    for i, row in enumerate(d):
        order = sorted((row[j], j) for j in range(len(xyz)) if j != i)[:k]
        out.update({(i, r + 1): j for r, (_, j) in enumerate(order)})
    return out


def crowded():
    """A third of the points in a tiny cluster, a third copies of one point, the rest far apart."""
    rng = np.random.default_rng(7)
    return np.vstack([rng.normal(0, 1e-4, (60, 3)), np.repeat([[5.0, 5.0, 5.0]], 60, 0), rng.uniform(-50, 50, (60, 3))])


@pytest.mark.parametrize("k", [1, 8])
def test_knn_exact_on_crowded_points(spark, k):
    xyz = crowded()
    got = {(r["pt_id"], r["rank"]): r["nb_id"] for r in S.knn(cloud(spark, xyz), k).collect()}
    assert got == brute_knn(xyz, k)


def test_knn_fewer_points_than_k(spark):
    got = S.knn(cloud(spark, np.array([[0, 0, 0], [1, 0, 0], [0, 3, 0]], float)), 8).collect()
    assert len(got) == 6 and max(r["rank"] for r in got) == 2


def test_thin_keeps_distance_and_covers(spark):
    xyz = np.vstack([np.random.default_rng(3).uniform(0, 1, (150, 3)), np.repeat([[0.5, 0.5, 0.5]], 50, 0)])
    kept = {r["pt_id"] for r in S.min_distance_thin(cloud(spark, xyz), 0.2, 1).collect()}
    ids = sorted(kept)
    d = np.sqrt(((xyz[:, None] - xyz[ids][None]) ** 2).sum(2))
    assert all(d[i][np.array(ids) != i].min() >= 0.2 for i in ids)
    assert all(d[i].min() < 0.2 for i in range(len(xyz)) if i not in kept)
    first = []  # the same as one pass over all points in hash order
    for i in sorted(range(len(xyz)), key=lambda i: (hashlib.md5(f"1:{i}".encode()).hexdigest()[:8], i)):
        if all(((xyz[i] - xyz[j]) ** 2).sum() >= 0.2 * 0.2 for j in first):
            first.append(i)
    assert kept == set(first)


CUBE = [(-1, -1, -1), (1, -1, -1), (1, 1, -1), (-1, 1, -1), (-1, -1, 1), (1, -1, 1), (1, 1, 1), (-1, 1, 1)]
QUADS = [(0, 3, 2, 1), (4, 5, 6, 7), (0, 1, 5, 4), (1, 2, 6, 5), (2, 3, 7, 6), (3, 0, 4, 7)]


def cube(spark):
    tris = [t for a, b, c, d in QUADS for t in ((a, b, c), (a, c, d))]
    return spark.createDataFrame(
        [(i, 0, *[float(v) for k in t for v in CUBE[k]]) for i, t in enumerate(tris)],
        "tri_id bigint, obj_id int, ax double, ay double, az double, bx double, by_ double, bz double, cx double, cy double, cz double")


PROBES = np.array([[0, 0, 0], [0.2, 0.3, 0.1], [2, 0.1, 0.2], [0.3, 3, 0.1], [0.3, 0.2, -4], [0.9, 0.1, 0.2], [30, 0, 0]], float)
SIGNED = [-1, -0.7, 1, 2, 3, -0.1, 29]


def test_signed_distance_of_cube(spark):
    got = {r["pt_id"]: r["sdf"] for r in S.signed_distance(cloud(spark, PROBES), cube(spark)).collect()}
    assert [got[i] for i in range(len(PROBES))] == pytest.approx(SIGNED)


def test_culls_agree_on_cube(spark):
    pts, box = cloud(spark, PROBES), cube(spark)
    outside = {i for i, s in enumerate(SIGNED) if s > 0}
    for cull in (S.cull_raycast, S.cull_normal):
        assert {r["pt_id"] for r in cull(pts, box).collect()} == outside
        assert {r["pt_id"] for r in cull(pts, box, keep="inside").collect()} == set(range(len(PROBES))) - outside


def test_no_surface_keeps_points(spark):
    other = cloud(spark, PROBES, obj=5)
    assert S.cull_normal(other, cube(spark)).count() == len(PROBES)
    assert S.nearest_triangle(other, cube(spark)).filter("sdf IS NULL").count() == len(PROBES)


def test_one_sphere_has_closed_surface(spark):
    vox = S.points_to_sdf(cloud(spark, [[0, 0, 0]]), radius=1.2, voxel=1.0)
    faces = S.iso_surface_faces(vox).collect()
    # seven voxels inside: the centre and its six neighbours, whose five free sides each show
    assert len(faces) == 30 and sum(f["outward"] for f in faces) == 0


def test_circle_order_is_clockwise(spark):
    n = 8
    xyz = [(np.cos(a), np.sin(a), 0.0) for a in 2 * np.pi * (np.arange(n) + 0.25) / n]
    got = {r["ord"]: r["pt_id"] for r in P.order_by_angle(cloud(spark, xyz)).collect()}
    assert [got[i] for i in range(n)] == [3, 2, 1, 0, 7, 6, 5, 4]
    picks = sorted((r["idx"], r["ord"]) for r in P.pick_waypoints(P.order_by_angle(cloud(spark, xyz)), 5).collect())
    assert picks == [(i, int(i * n / 5)) for i in range(5)]


def test_sample_without_faces_gives_origin(spark):
    draws = spark.createDataFrame([(9, 0), (9, 1)], "obj_id int, draw bigint")
    got = P.area_weighted_sample(cube(spark), draws).collect()
    assert [(r["x"], r["y"], r["z"]) for r in got] == [(0, 0, 0)] * 2


def test_repaired_surface_is_closed(spark):
    from meshlark.plans.candidates import repair_surface

    faces = repair_surface(cube(spark), radius=0.6, voxel=0.4, overlap=0.7, iterations=1, seed=1).collect()
    along = {}
    for f in faces:
        line = (f["axis"], *[f[f"i{c}"] for c in "xyz" if c != f["axis"]])
        along[line] = along.get(line, 0) + f["outward"]
    assert faces and not any(along.values())  # every line through the shell leaves it as often as it enters


def closed(spark, corners, faces):
    rows = [(k, 0, *[float(v) for i in f for v in corners[i]]) for k, f in enumerate(faces)]
    return spark.createDataFrame(
        rows, "tri_id bigint, obj_id int, ax double, ay double, az double, bx double, by_ double, bz double, cx double, cy double, cz double")


def test_sign_at_sharp_corners(spark):
    """Beyond the tip of a spike and beside the edge of a thin wedge the nearest plane says nothing."""
    spike = closed(spark, [(0, -1, -1), (0, 1, -1), (0, 0, 1), (10, 0, 0)], [(0, 2, 1), (0, 1, 3), (1, 2, 3), (2, 0, 3)])
    tip = np.array([[11, 0.9, 0], [11, -0.4, 0.3], [9.9, 0.0, 0.001], [5, 0, 0], [-1, 0, 0]])
    got = {r["pt_id"]: r["sdf"] for r in S.signed_distance(cloud(spark, tip), spike).collect()}
    assert [got[k] > 0 for k in range(5)] == [True, True, False, False, True]
    wedge = closed(spark, [(0, 0, 0), (0, 10, 0), (5, 0, 0.1), (5, 10, 0.1), (5, 0, -0.1), (5, 10, -0.1)], [
        (0, 2, 3), (0, 3, 1), (0, 1, 5), (0, 5, 4), (2, 4, 5), (2, 5, 3), (0, 4, 2), (1, 3, 5)])
    edge = np.array([[-1, 5, 0.5], [-1, 5, -0.5], [4, 5, 0.01], [4, 5, 0.3], [-0.2, 5.3, 0]])
    got = {r["pt_id"]: r["sdf"] for r in S.signed_distance(cloud(spark, edge), wedge).collect()}
    assert [got[k] > 0 for k in range(5)] == [True, True, False, True, True]


def test_close_surfaces_count_once(spark):
    """Two sheets 2e-8 apart, on either side of a multiple of 1e-4, and one further up."""
    def sheet(z):
        return [(-9, -9, z), (9, -9, z), (0, 9, z)]
    corners = [c for z in (0.5 - 1e-8, 0.5 + 1e-8, 0.7) for c in sheet(z)]
    tris = closed(spark, corners, [(0, 1, 2), (3, 4, 5), (6, 7, 8)])
    got = {r["pt_id"]: r["hits"] for r in S.ray_hits(cloud(spark, np.array([[0, 0, 0], [0, 0, 0.6], [0, 0, 0.8], [50, 0, 0]], float)), tris).collect()}
    assert got == {0: 2, 1: 1, 2: 0, 3: 0}


def test_knn_leaves_out_what_has_no_place(spark):
    rng = np.random.default_rng(9)
    xyz = rng.uniform(0, 1, (50, 3))
    odd = np.vstack([xyz, [[np.nan, 0, 0], [np.inf, 0, 0]]])
    got = {(r["pt_id"], r["rank"]): r["nb_id"] for r in S.knn(cloud(spark, odd), 3).collect()}
    assert got == brute_knn(xyz, 3)


def test_field_is_near_the_exact_distance(spark):
    """Read between voxels, a cube's field is within a voxel of the distance; outside the band there is none."""
    voxel = 0.1
    rng = np.random.default_rng(9)
    points = cloud(spark, np.vstack([rng.uniform(-1.25, 1.25, (300, 3)), [[5, 5, 5]]]))
    field = S.mesh_to_sdf(cube(spark), voxel, 0.4)
    got = {r["pt_id"]: r["sdf"] for r in S.sample_field(points, field, voxel).collect()}
    exact = {r["pt_id"]: r["sdf"] for r in S.signed_distance(points, cube(spark)).collect()}
    near = [k for k in exact if abs(exact[k]) < 0.2]
    assert len(near) > 30 and all(got[k] is not None and abs(got[k] - exact[k]) < voxel for k in near)
    assert got[300] is None and len(got) == 301
