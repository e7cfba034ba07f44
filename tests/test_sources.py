import json
import os
import struct
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshlark.operators import assets as A, mesh as M, trajectory as T
from meshlark.plans import inspector
from meshlark.sources import models, reports, scan
from meshlark.streaming import ingest


def glb(doc: dict) -> bytes:
    body = json.dumps(doc).encode()
    body += b" " * (-len(body) % 4)
    return b"glTF" + struct.pack("<II", 2, 20 + len(body)) + struct.pack("<I", len(body)) + b"JSON" + body


GOOD = {
    "asset": {"version": "2.0"}, "materials": [{"name": "m"}], "nodes": [{"mesh": 0}],
    "meshes": [{"primitives": [{"attributes": {"POSITION": 0}, "indices": 1, "material": 0}]}],
    "accessors": [{"count": 8, "min": [-0.5] * 3, "max": [0.5] * 3}, {"count": 36}],
}


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "ok.glb").write_bytes(glb(GOOD))
    (tmp_path / "in" / "bad.glb").write_bytes(b"abc")
    (tmp_path / "in" / "notes.txt").write_text("no model")
    (tmp_path / "in" / "deep" / "ok.glb").write_bytes(glb(GOOD))
    return str(tmp_path / "in")


def test_scan(spark, folder):
    names = lambda **k: sorted(r["path"].split("/in/")[1] for r in scan.asset_scan(spark, folder, **k).collect())
    assert names(ext="glb") == ["bad.glb", "ok.glb"]
    assert names(limit=1) == ["bad.glb"] and names(limit=0) == []
    assert names(recursive=True) == ["bad.glb", "deep/ok.glb", "ok.glb"]
    plan = scan.asset_scan(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1]


def test_glb_reports_and_summary(spark, folder, tmp_path):
    got = {r["path"].split("/in/")[1]: r for r in models.gltf_stats(scan.asset_contents(spark, folder, "*.glb")).collect()}
    ok, bad = got["ok.glb"], got["bad.glb"]
    assert (ok["status"], ok["vertices"], ok["faces"], ok["materials"], ok["min_x"], ok["max_z"]) == ("success", 8, 12, ["m"], -0.5, 0.5)
    assert (bad["status"], bad["error_message"], bad["vertices"]) == ("error", "Invalid header", None)
    summary = inspector.inspect_folder(spark, folder, str(tmp_path / "out")).first()
    assert summary["message"] == "Processed 3 files. 1 Error."


def test_stem_collision(spark, folder):
    files = scan.asset_scan(spark, folder, recursive=True)
    got = {r["output_path"]: r["n_same"] for r in A.with_collisions(files, "/out").collect()}
    assert got == {"/out/ok": 2, "/out/bad": 1}


@pytest.mark.parametrize("path,stem,ext", [("/a/x.tar.GLB", "x.tar", ".glb"), ("/a/.hidden", ".hidden", ""), ("plain", "plain", "")])
def test_names(spark, path, stem, ext):
    row = spark.createDataFrame([(path,)], "path string").select(A.stem(F.col("path")), A.extension(F.col("path"))).first()
    assert tuple(row) == (stem, ext)


def test_report_path(spark):
    df = spark.createDataFrame([("/o/a.json",), ("/o/a",), ("/o/a/",)], "p string")
    assert [r[0] for r in df.select(reports.report_path(F.col("p"))).collect()] == ["/o/a.json", "/o/a/report.json", "/o/a/report.json"]


def test_stream_handles_each_file_once(spark, folder, tmp_path):
    out, state = str(tmp_path / "rep"), str(tmp_path / "state")
    go = lambda: ingest.run_ingest(ingest.file_stream(spark, folder), inspector.model_reports, out, state).awaitTermination()
    go()
    first = spark.read.parquet(out)
    assert first.count() == 3 and first.select("batch").distinct().count() == 3
    go()
    assert spark.read.parquet(out).count() == 3


V = "v -1 -1 -1\nv 1 -1 -1\nv 1 1 -1\nv -1 1 -1\nv -1 -1 1\nv 1 -1 1\nv 1 1 1\nv -1 1 1\n"
SIDES = ["f 1 4 3 2", "f 1 2 6 5", "f 2/1/1 3//2 7 6", "f 3 4 8 7", "f -5 -8 -4 -1"]
TOP = "f 5 6 7 8"


def obj(spark, tmp_path, name, faces):
    (tmp_path / name).write_text("# model\n" + V + "\n".join(faces) + "\n")
    verts, loops = models.obj_tables(scan.asset_lines(spark, str(tmp_path), name))
    return verts, loops.withColumn("obj_id", F.lit(0))


def test_cube_obj(spark, tmp_path):
    verts, loops = obj(spark, tmp_path, "cube.obj", SIDES + [TOP])
    assert verts.count() == 8 and loops.select("face_id").distinct().count() == 6
    assert M.boundary_edges(M.face_edges(loops)).count() == 0
    assert M.single_sided_faces(loops).count() == 0
    faces = loops.filter("pos = 0")
    assert tuple(M.topology(faces).first()) == (0, 6, 0)
    assert M.triangulate(loops).count() == 12
    box = M.world_bbox(verts).first()
    assert (box["dim_x"], box["min_y"], box["max_z"]) == (2.0, -1.0, 1.0)


def test_open_box_obj(spark, tmp_path):
    _, loops = obj(spark, tmp_path, "open_box.obj", SIDES)
    assert M.boundary_edges(M.face_edges(loops)).count() == 4
    assert M.single_sided_faces(loops).select("face_id").distinct().count() == 4
    assert M.delete_boundary_faces(loops).select("face_id").distinct().count() == 1


def test_ring_of_one_face(spark, tmp_path):
    _, loops = obj(spark, tmp_path, "fan.obj", ["f 1 2 3 4 5 6 7 8"])
    got = {(r["vert_id"], r["b"], r["v0"]) for r in M.rings(loops).collect()}
    assert got == {(i, (i + 1) % 8, 0) for i in range(8)}


def test_stl(spark, tmp_path):
    head = bytes(80) + struct.pack("<I", 1)
    (tmp_path / "tri.stl").write_bytes(head + np.array([0, 0, 1, 0, 0, 0, 1, 0, 0, 0, 1, 0], "<f4").tobytes() + b"\0\0")
    (tmp_path / "text.stl").write_text("solid t\nfacet normal 0 0 1\nouter loop\nvertex 0 0 0\nvertex 2 0 0\nvertex 0 2 0\nendloop\nendfacet\nendsolid\n")
    binary = models.stl_triangles(scan.asset_contents(spark, str(tmp_path), "*.stl"))
    assert [r["area"] for r in M.face_areas(binary).collect()] == [0.5]
    text = models.stl_text_triangles(scan.asset_lines(spark, str(tmp_path), "text.stl"))
    assert [r["area"] for r in M.face_areas(text).collect()] == [2.0]


def test_empty_scene_gives_zeros(spark):
    none = spark.createDataFrame([], "x double, y double, z double")
    assert set(M.world_bbox(none).first()) == {0.0}


def test_orbit_quarters(spark):
    at = spark.createDataFrame([(0, 0.0, 0.0, 0.0)], "obj_id int, cx double, cy double, cz double")
    got = [(round(r["x"], 9) + 0, round(r["y"], 9) + 0) for r in T.orbit(at, radius=1.0, frame_count=4).orderBy("frame").collect()]
    assert got == [(1, 0), (0, 1), (-1, 0), (0, -1)]


def test_static_and_moving(spark):
    keys = spark.createDataFrame(
        [(1, 1, 0.0, 0.0, 0.0), (1, 9, 0.005, 0.0, 0.0), (2, 1, 0.0, 0.0, 0.0), (2, 9, 1.0, 0.0, 0.0), (3, 1, 4.0, 0.0, 0.0)],
        "obj_id int, frame int, x double, y double, z double")
    assert {r["obj_id"]: r["animated"] for r in T.animated(keys).collect()} == {1: False, 2: True, 3: False}


def test_linear_path_ends_one_past(spark):
    way = spark.createDataFrame([(1, i, float(i), 0.0, 0.0) for i in range(3)] + [(2, 0, 0.0, 0.0, 0.0)], "path_id int, idx int, x double, y double, z double")
    got = {r["frame"]: r["x"] for r in T.linear_path(way, 10).collect()}
    assert sorted(got) == list(range(1, 12)) and got[6] == 1.0 and got[11] == 2.0
    assert [r["path_id"] for r in T.path_errors(way).collect()] == [2]


BROKEN_OBJ = {
    "vertex": ["v x 2 3", "v 0 0 0", "v 1 0 0", "f 1 2 3"], "short": ["v 0 0"], "face": ["v 0 0 0", "f 1 q 1"], "zero": ["v 0 0 0", "f 0 1 1"],
    "far": ["v 0 0 0", "v 1 0 0", "v 0 1 0", "f 1 2 4"], "good": ["v 0 0 0", "v 1 0 0", "v 0 1 0", "f -3 -2 -1"],
}


def test_broken_obj_is_a_row(spark, tmp_path):
    for name, lines in BROKEN_OBJ.items():
        (tmp_path / f"{name}.obj").write_text("\n".join(lines))
    lines = scan.asset_lines(spark, str(tmp_path))
    good, bad = models.obj_quarantine(lines)
    assert {r["path"].rsplit("/", 1)[1]: r["error_message"] for r in bad.collect()} == {
        "vertex.obj": models.BAD_VERTEX, "short.obj": models.BAD_VERTEX, "face.obj": models.BAD_FACE, "zero.obj": models.BAD_FACE, "far.obj": models.NO_VERTEX}
    assert models.obj_status(lines).count() == len(BROKEN_OBJ)
    verts, loops = models.obj_tables(good)
    assert verts.count() == 3 and sorted(r["vert_id"] for r in loops.collect()) == [0, 1, 2]
    assert models.obj_tables(lines)[0].count() == sum(x.startswith("v") for v in BROKEN_OBJ.values() for x in v)  # broken lines don't end the job


def test_broken_stl_and_glb_are_rows(spark):
    stl = bytes(80) + struct.pack("<I", 2) + bytes(50)
    rows = [("cut.stl", stl), ("whole.stl", stl + bytes(50)), ("none.stl", b""), ("null.stl", None), ("solid.stl", b"solid"),
        ("text.stl", b"solid x\nfacet normal 0 0 1\nouter loop\nvertex 0 0 0\nvertex 1 0 0\nvertex 0 1 0\nendloop\nendfacet\nendsolid x\n"),
        ("half.stl", b"solid x\nfacet normal 0 0 1\nouter loop\nvertex 0 0 0\nendsolid"), ("empty.stl", b"solid x\nendsolid x"),
        ("named.stl", b"solid" + stl[5:] + bytes(50)), ("named_cut.stl", b"solid" + stl[5:])]
    files = spark.createDataFrame(rows, "path string, content binary")
    got = {r["path"]: r["status"] for r in models.stl_status(files).collect()}
    assert {k for k, v in got.items() if v == "success"} == {"whole.stl", "text.stl", "empty.stl", "named.stl"} and len(got) == len(rows)
    body = b'{"asset":{"version":"2.0"},"meshes":[{"name":"m"}]}'
    head = b"glTF" + struct.pack("<II", 2, 0)
    rows = [("endless.glb", head + b"\xff\xff\xff\xffJSON" + body), ("bare.glb", head + struct.pack("<I", len(body)) + b"JSON" + body)]
    files = spark.createDataFrame([(p, len(c), c) for p, c in rows], "path string, length long, content binary")
    got = {r["path"]: (r["status"], r["error_message"], r["faces"]) for r in models.gltf_stats(files).collect()}
    assert got == {"endless.glb": ("error", models.BAD_LENGTH, None), "bare.glb": ("success", None, 0)}


def test_stl_away_from_the_repository(tmp_path):
    """Workers that cannot import the package still read STL."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.path.insert(0, {root!r})
from meshlark.session import build_session
from meshlark.sources import models
spark = build_session("away", "local[1]", **{{"spark.ui.enabled": "false"}})
files = spark.createDataFrame([("a.stl", bytes(80) + (1).to_bytes(4, "little") + bytes(50))], "path string, content binary")
print("rows", models.stl_triangles(files).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert "rows 1" in done.stdout, done.stderr[-2000:]


def test_matching_faces_by_distance(spark, tmp_path):
    """Corners next to a multiple of the tolerance match at 2e-8 and not beyond the tolerance."""
    verts, loops = obj(spark, tmp_path, "pair.obj", ["f 1 2 3", "f 1 2 4"])
    places = {r["vert_id"]: (r["x"], r["y"], r["z"]) for r in verts.collect()}
    near = [(x + d, y, z) for k, (x, y, z) in places.items() for d in [(2e-8, -2e-8, 9e-5, 2e-4)[k % 4]]]
    reference = spark.createDataFrame(near[:4], "x double, y double, z double")
    left = M.delete_matching_faces(loops, verts.withColumn("obj_id", F.lit(0)), reference, 1e-4).select("face_id").distinct().collect()
    assert [r["face_id"] for r in left] == [1]


def test_obj_vertices_are_numbered_without_the_faces(spark):
    lines = spark.createDataFrame([("a", 0, 0, "v 1 2 3"), ("a", 0, 1, "f 1 2 -1"), ("a", 9, 2, "v 4 5 6")], "path string, block long, seq long, value string")
    verts, loops = models.obj_tables(lines)
    assert sorted(tuple(r) for r in verts.collect()) == [("a", 0, 1.0, 2.0, 3.0), ("a", 1, 4.0, 5.0, 6.0)]
    assert sorted((r.pos, r.vert_id, r.n) for r in loops.collect()) == [(0, 0, 3), (1, 1, 3), (2, 0, 3)]
    plan = verts._jdf.queryExecution().optimizedPlan().toString()
    assert "= v)" in plan[plan.rindex("Window"):]


def test_counted_lines_are_numbered_where_they_are_read(spark, tmp_path):
    """Files of many blocks and of one, with relative references: the same tables as by windows, and no line is moved."""
    import random

    rng = random.Random(4)
    for name, n in (("long.obj", 900), ("short.obj", 7), ("none.obj", 0)):
        lines = ["# a comment", "v 0 0 0", "v 1 0 0", "v 0 1 0"]
        lines += [rng.choice([f"v {k} {k + 0.5} -1", "f 1 2 -1", " f -1 -2 -3 1", "vn 0 0 1", "", "v"]) for k in range(n)]
        (tmp_path / name).write_text("\n".join(lines if n else ["# nothing"]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    try:
        read = scan.asset_lines(spark, str(tmp_path))
        assert read.filter("block > 0").select("block").distinct().count() > 5
        plain, counted = models.obj_tables(read), models.obj_tables(models.obj_counted(read))
        for a, b in zip(plain, counted):
            assert a.columns == b.columns and sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
        for table in counted:
            plan = table._jdf.queryExecution().executedPlan().toString()
            assert "Exchange hashpartitioning" not in plan and "Window" not in plan
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_blocks_are_counted_over_batches_of_any_size():
    import pyarrow as pa

    rows = [("a", 0, 1, "", k % 2, k % 3 == 0) for k in range(9)] + [("a", 70, 2, "", 1, 0)] * 3 + [("b", 70, 3, "", 1, 1)] * 4
    names, want, sums = ["path", "block", "seq", "value", "nv", "nf"], [], {}
    for r in rows:
        v, f = sums.get(r[:2], (0, 0))
        sums[r[:2]] = (v + r[4], f + r[5])
        want.append(sums[r[:2]])
    for size in (1, 2, 5, 100):
        batches = [pa.RecordBatch.from_arrays([pa.array(list(map(type(rows[0][i]) if i < 4 else int, c))) for i, c in enumerate(zip(*rows[k : k + size]))], names)
                   for k in range(0, len(rows), size)]
        assert [(r["nv"], r["nf"]) for b in models._count_blocks(iter(batches)) for r in b.to_pylist()] == want


def test_corners_of_obj_parts_are_dealt_once(spark):
    from meshlark.plans.asset_queries import obj_parts
    from meshlark.sources.tables import Tables

    plan = obj_parts(Tables(spark, "/root/testdata/sf0.001"))[1]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
