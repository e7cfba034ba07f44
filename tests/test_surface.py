"""Tiles of points and the triangles near them: few pairs are looked at, and the answers are those of all pairs."""

import numpy as np
from test_columns import soup
from test_spatial import cloud

from pyspark.sql import functions as F

from meshlark.operators import rays, spatial as S, surface


def lattice_soup():
    """Shared corners and edges, sheets closer than SAME_SURFACE, a sliver, a point of a triangle, and a random part."""
    tris = [[x, y, z, x + 1, y, z, x + 1, y + 1, z] for x in range(4) for y in range(4) for z in (0, 0.5, 0.50005, 0.5001)]
    tris += [[x, y, 0, x, y + 1, 0, x + 1, y + 1, 0] for x in range(4) for y in range(4)]
    tris += [[0, 0, 0, 2, 0, 1, 1, 0, 3], [1, 1, 1] * 3, [0, 0, 2, 1, 1, 2, 2, 2, 2]]
    return np.vstack([np.array(tris, float), np.random.default_rng(3).uniform(0, 4, (150, 9))])


def probes():
    at = np.arange(0, 4.3, 0.5)
    return np.array([[x, y, z] for x in at for y in at for z in (-1, 0, 0.5, 0.50005, 1.3)] + [[90.0, -70.0, 3.0]])


def test_boxes_drop_triangles_that_cannot_be_above(monkeypatch):
    rng = np.random.default_rng(4)
    xyz, tris = rng.uniform(0, 4, (600, 3)), np.repeat(rng.uniform(0, 4, (900, 3)), 3, 0).reshape(900, 9) + rng.uniform(0, 0.3, (900, 9))
    looked, found = [], rays._found
    monkeypatch.setattr(rays, "PAIRS", 512)
    monkeypatch.setattr(rays, "_found", lambda p, t: looked.append(p.shape[1] * t.shape[1]) or found(p, t))
    assert rays.hits_of(xyz, tris).sum() > 100 and sum(looked) < 600 * 900 / 10


def test_boxes_of_any_size_give_the_same_hits(monkeypatch):
    odd = np.vstack([probes(), [[np.nan, 1, 0], [1, np.inf, 0], [1, 1, -np.inf], [1, 1, np.nan]]])
    with np.errstate(all="ignore"):
        got = []
        for together, pairs in ((64, 1 << 15), (5, 64), (1, 1)):
            monkeypatch.setattr(rays, "TOGETHER", together)
            monkeypatch.setattr(rays, "PAIRS", pairs)
            got.append(rays.hits_of(odd, lattice_soup()).tolist())
    assert got[0] == got[1] == got[2] and got[0][-2] > got[0][-4] == got[0][-1] == 0


def test_pairs_are_measured_as_in_sql(spark):
    xyz, tris = probes(), lattice_soup()
    flat = S.distinct_tris(soup(spark, tris))
    rows = S.with_closest(cloud(spark, xyz).join(flat, "obj_id")).select("pt_id", "tri_id", "sx", "sy", "sz", "d2", "side").collect()
    s, d2, side = surface.closest(xyz[[r["pt_id"] for r in rows]].T, tris[[r["tri_id"] for r in rows]].T)
    assert [r["d2"] for r in rows] == d2.tolist() and [r["side"] for r in rows] == side.tolist()
    assert [(r["sx"], r["sy"], r["sz"]) for r in rows] == list(map(tuple, s.T.tolist()))


def test_nearest_of_a_tile_is_that_of_all_pairs(monkeypatch):
    for tris, off in ((lattice_soup(), 0.0), (lattice_soup(), 1e6), (lattice_soup() * 1e-5, 0.0)):
        xyz = (probes() * (1e-5 if tris.max() < 1e-3 else 1.0) + off).T.copy()
        tris = (tris + off).T.copy()
        all_ = np.array([surface.closest(np.repeat(p[:, None], tris.shape[1], 1), tris)[1] for p in xyz.T])
        for fewest, pairs, tried in ((16, 1 << 18, 8), (2, 32, 3), (1, 1, 1)):
            for name, value in (("FEWEST", fewest), ("PAIRS", pairs), ("TRIED", tried)):
                monkeypatch.setattr(surface, name, value)
            who, d2 = surface.nearest_of(xyz, tris, np.inf)
            assert (d2 == all_.min(1)).all() and (who == all_.argmin(1)).all()  # argmin: the first of equals
            within = float(np.sqrt(np.median(all_.min(1)))) + 1e-9
            who, d2 = surface.nearest_of(xyz, tris, within)
            sure = all_.min(1) <= within**2 * (1 - 1e-9)
            assert (who[sure] == all_.argmin(1)[sure]).all() and (d2[~sure] >= within**2 * (1 - 1e-9)).all()


def test_few_pairs_are_measured(monkeypatch):
    rng = np.random.default_rng(5)
    xyz, tris = rng.uniform(0, 1, (3, 500)), rng.uniform(0, 1, (9, 800))
    measured, exact = [], surface._exact
    monkeypatch.setattr(surface, "_exact", lambda p, t, row, col: measured.append(len(row)) or exact(p, t, row, col))
    assert (surface.nearest_of(xyz, tris, np.inf)[0] >= 0).all() and sum(measured) < 500 * 800 / 20


def test_crowded_tiles_far_points_and_objects_without_triangles(spark, monkeypatch):
    monkeypatch.setattr(S, "TILE", 16)
    tris, rng = lattice_soup(), np.random.default_rng(6)
    xyz = np.vstack([probes()[::7], np.repeat([[2.0, 2.1, 0.3]], 40, 0), rng.normal(0, 30, (30, 3)), [[1e4, 0, 0], [np.nan, 0, 0]]])
    points = cloud(spark, xyz).unionByName(cloud(spark, xyz[:5], obj=1))
    got = {(r["obj_id"], r["pt_id"]): r for r in S.nearest_triangle(points, soup(spark, tris)).collect()}
    assert len(got) == len(xyz) + 5 and all(got[1, k]["tri_id"] is None for k in range(5)) and got[0, len(xyz) - 1]["tri_id"] is None
    for k, p in enumerate(xyz[:-1]):
        s, d2, _ = surface.closest(np.repeat(p[:, None], len(tris), 1), tris.T)
        assert (got[0, k]["tri_id"], got[0, k]["dist"]) == (d2.argmin(), np.sqrt(d2.min()))


def test_tiles_are_smaller_where_points_are_crowded(spark):
    rng = np.random.default_rng(7)
    even, crowded = (cloud(spark, xyz) for xyz in (rng.uniform(-1, 1, (400, 3)), np.vstack([rng.normal(0, 0.05, (398, 3)), [[-1] * 3, [1] * 3]])))
    whole, small = (S._tile_size(c, "xyz")[0] for c in (even, crowded))
    assert whole / S.FINER * 0.9 < small < whole / 2


def test_the_nearest_is_found_without_moving_pairs(spark, monkeypatch):
    kept, plans = S.cut, []
    monkeypatch.setattr(S, "cut", lambda df, label: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or kept(df, label))
    rng = np.random.default_rng(8)
    near = S.nearest_triangle(cloud(spark, rng.normal(size=(60, 3))), soup(spark, rng.normal(size=(80, 9))))
    assert near.filter(F.col("tri_id").isNull()).isEmpty() and any("FlatMapCoGroupsInArrow" in p for p in plans)
