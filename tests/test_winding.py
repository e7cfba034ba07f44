"""Outward winding on closed, open and one-sided surfaces."""

import numpy as np
from pyspark.sql import functions as F

from meshlark.operators import mesh as M, winding as W


def ring_of(u, v, width=4):
    return [u * width + v % width, u * width + (v + 1) % width]


def torus(nu, nv):
    quads = []
    for u in range(nu):
        for v in range(nv):
            a, b = ring_of(u, v, nv)
            c, d = ring_of((u + 1) % nu, v, nv)
            quads.append([a, c, d, b])
    at = [((3 + np.cos(2 * np.pi * v / nv)) * np.cos(2 * np.pi * u / nu), (3 + np.cos(2 * np.pi * v / nv)) * np.sin(2 * np.pi * u / nu), np.sin(2 * np.pi * v / nv))
          for u in range(nu) for v in range(nv)]
    return quads, np.array(at)


def tables(spark, parts):
    """(loops, vertices) of [(obj_id, quads, places)], faces numbered through."""
    loops, verts, face = [], [], 0
    for obj, quads, at in parts:
        for q in quads:
            loops += [(obj, face, k, v, len(q)) for k, v in enumerate(q)]
            face += 1
        verts += [(obj, k, *map(float, p)) for k, p in enumerate(at)]
    return (spark.createDataFrame(loops, "obj_id int, face_id long, pos int, vert_id long, n int"),
            spark.createDataFrame(verts, "obj_id int, vert_id long, x double, y double, z double"))


def test_closed_surfaces_at_random(spark):
    rng = np.random.default_rng(5)
    quads, at = torus(24, 6)
    mixed = [q[::-1] if rng.random() < 0.5 else q for q in quads]
    far = at * 0.2 + 50
    loops, verts = tables(spark, [(0, mixed, at), (1, [q[::-1] for q in quads], far), (2, quads, far)])
    assert W.winding_conflicts(loops).filter("obj_id = 0").count() > 0
    out = W.outward_winding(loops, verts)
    assert out.columns == loops.columns and W.winding_conflicts(out).count() == 0
    got = {}
    for r in out.collect():
        got.setdefault((r.obj_id, r.face_id), {})[r.pos] = r.vert_id
    for (obj, face), ring in got.items():
        want, seen = quads[face % len(quads)], [ring[k] for k in range(4)]
        assert seen in [want[k:] + want[:k] for k in range(4)], (obj, face)
    turns = W.outward_turns(loops, verts)
    assert turns.select("obj_id", "part").distinct().count() == 3
    assert {r.obj_id: r.n for r in turns.groupBy("obj_id").agg(F.count_if("turn").alias("n")).collect()} == {0: sum(m != q for m, q in zip(mixed, quads)), 1: len(quads), 2: 0}


def test_a_one_sided_band_reports_its_conflict(spark):
    n = 9
    quads = [[2 * k, 2 * k + 1, 2 * k + 3, 2 * k + 2] for k in range(n - 1)] + [[2 * n - 2, 2 * n - 1, 0, 1]]
    loops, verts = tables(spark, [(0, quads, np.random.default_rng(1).normal(size=(2 * n, 3)))])
    assert W.winding_conflicts(W.outward_winding(loops, verts)).count() == 1


def test_open_and_odd_faces(spark):
    """Two triangles in a plane agree; three faces at one edge are listed; no faces give no rows."""
    loops, verts = tables(spark, [(0, [[0, 1, 2], [1, 2, 3]], [[0, 0, 0], [1, 0, 0], [0, 1, 0], [1, 1, 0]])])
    assert W.winding_conflicts(loops).count() == 1 and W.winding_conflicts(W.outward_winding(loops, verts)).count() == 0
    fan, at = tables(spark, [(0, [[0, 1, 2], [0, 1, 3], [1, 0, 4]], np.eye(5, 3))])
    assert [r.faces for r in W.winding_conflicts(W.outward_winding(fan, at)).collect()] == [3]
    assert W.outward_winding(loops.limit(0), verts).count() == 0


def test_the_cube_of_boxes_is_outward(spark):
    bounds = spark.createDataFrame([(0, -1.0, 1.0, -1.0, 1.0, -1.0, 1.0)], "obj_id int, min_x double, max_x double, min_y double, max_y double, min_z double, max_z double")
    loops = M.box_faces(bounds, "obj_id").withColumnRenamed("corner", "vert_id").withColumn("n", F.lit(4))
    verts = M.aabb_box(bounds, "obj_id").withColumnRenamed("corner", "vert_id")
    assert W.outward_turns(loops, verts).filter("turn").count() == 0


def test_faces_and_corners_are_not_gathered_on_the_driver(spark, monkeypatch):
    """Spark takes corners made by explode, and tables read back, for smaller than they are."""
    from meshlark.plans.mesh_queries import part_boxes
    from meshlark.sources.tables import Tables

    plans = []
    kept = W.cut
    monkeypatch.setattr(W, "cut", lambda df, label: plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df, label))
    turns = W.outward_winding(*part_boxes(Tables(spark, "/root/testdata/sf0.001")))
    plans.append(turns._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 3 and not any("Broadcast" in p for p in plans)
