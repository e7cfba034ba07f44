"""glTF files: instances in world space, reads by ranges, decoded accessors, files written at exact paths."""

import base64
import json
import os
import struct
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from meshlark.plans import asset_queries, inspector
from meshlark.sources import gltf, places, reports, scan
from meshlark.sources.tables import Tables

CUBE = {"POSITION": 0}


def glb(doc, data=b""):
    body = json.dumps(doc).encode()
    body += b" " * (-len(body) % 4)
    chunks = struct.pack("<I", len(body)) + b"JSON" + body + (struct.pack("<I", len(data)) + b"BIN\0" + data if data else b"")
    return b"glTF" + struct.pack("<II", 2, 12 + len(chunks)) + chunks


def scene(nodes, **more):
    return {
        "asset": {"version": "2.0"}, "nodes": nodes, "meshes": [{"primitives": [{"attributes": CUBE, "indices": 1, "material": 0}]}],
        "accessors": [{"count": 8, "min": [-0.5] * 3, "max": [0.5] * 3}, {"count": 36}], "materials": [{"name": "m"}, {"name": "unused"}], **more}


def docs_of(spark, tmp_path):
    return gltf.documents(gltf.read_heads(scan.asset_scan(spark, str(tmp_path), "*", recursive=True).filter("path RLIKE '[.](glb|gltf)$'")))


def by_name(rows):
    return {os.path.basename(r["path"]): r for r in rows}


def test_instances_and_scale(spark, tmp_path):
    (tmp_path / "two.glb").write_bytes(glb(scene([{"mesh": 0, "scale": [10, 10, 10]}, {"mesh": 0, "translation": [20, 0, 0]}])))
    (tmp_path / "none.glb").write_bytes(glb(scene([{"name": "empty"}])))
    (tmp_path / "bare.glb").write_bytes(glb({"asset": {"version": "2.0"}}))
    (tmp_path / "loop.glb").write_bytes(glb(scene([{"mesh": 0, "children": [1]}, {"mesh": 0, "children": [0]}])))
    (tmp_path / "bad.glb").write_bytes(b"abc")
    got = by_name(gltf.gltf_scene(docs_of(spark, tmp_path)).collect())
    two = got["two.glb"]
    assert (two["vertices"], two["faces"], two["mesh_count"], two["materials"]) == (16, 24, 2, ["m"])
    assert (two["min_x"], two["max_x"], two["min_y"], two["max_y"]) == (-5.0, 20.5, -5.0, 5.0)
    for name in ("none.glb", "bare.glb"):
        assert (got[name]["status"], got[name]["vertices"], got[name]["mesh_count"], got[name]["materials"], got[name]["min_x"]) == ("success", 0, 0, [], None)
    assert (got["loop.glb"]["mesh_count"], got["loop.glb"]["max_x"]) == (2, None)
    assert (got["bad.glb"]["status"], got["bad.glb"]["error_message"]) == ("error", "Invalid header")


def quaternion(axis, angle):
    axis = np.array(axis, float) / np.linalg.norm(axis)
    return [*(axis * np.sin(angle / 2)), np.cos(angle / 2)]


def matrix_of(node):
    if "matrix" in node:
        return np.array(node["matrix"]).reshape(4, 4).T
    x, y, z, w = node.get("rotation", [0, 0, 0, 1])
    turn = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)],
                     [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])
    out = np.eye(4)
    out[:3, :3] = turn @ np.diag(node.get("scale", [1, 1, 1]))
    out[:3, 3] = node.get("translation", [0, 0, 0])
    return out


def test_worlds_of_deep_chains(spark, tmp_path):
    """Forty nodes in a chain and a wide fan, every kind of local transform, against products of matrices."""
    rng = np.random.default_rng(4)
    nodes = []
    for k in range(60):
        if k % 3 == 0:
            m = np.eye(4)
            m[:3] = rng.normal(size=(3, 4)) * 0.7
            node = {"matrix": m.T.ravel().tolist()}
        else:
            node = {"rotation": quaternion(rng.normal(size=3), rng.uniform(0, 6)), "scale": rng.uniform(0.5, 1.5, 3).tolist(), "translation": rng.normal(size=3).tolist()}
        nodes.append({**node, "mesh": 0})
    for k in range(39):
        nodes[k]["children"] = [k + 1]
    nodes[39]["children"] = list(range(40, 60))
    (tmp_path / "deep.glb").write_bytes(glb(scene(nodes)))
    docs = docs_of(spark, tmp_path)
    got = {r.node_id: np.array(r.world).reshape(4, 4) for r in gltf.gltf_instances(docs).collect()}
    worlds = {0: matrix_of(nodes[0])}
    for k, node in enumerate(nodes):
        for c in node.get("children", []):
            worlds[c] = worlds[k] @ matrix_of(nodes[c])
    assert set(got) == set(range(60)) and all(np.allclose(got[k], worlds[k]) for k in got)
    corners = np.array([[x, y, z, 1] for x in (-0.5, 0.5) for y in (-0.5, 0.5) for z in (-0.5, 0.5)])
    moved = np.concatenate([corners @ worlds[k].T for k in worlds])
    box = gltf.gltf_scene(docs).first()
    assert np.allclose([[box[f"{n}_{c}"] for c in "xyz"] for n in ("min", "max")], [moved[:, :3].min(0), moved[:, :3].max(0)])
    turned = gltf.gltf_scene(docs, z_up=True).first()
    assert (turned["min_z"], turned["max_z"], turned["min_y"]) == (box["min_y"], box["max_y"], -box["max_z"])


POSITIONS = np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0], [0, 0, 1.5]], "<f4")


def view(count, kind, width, **more):
    return {"count": count, "componentType": kind, "type": width, **more}


def test_accessors(spark, tmp_path):
    """Strided floats, normalised bytes, 8-, 16- and 32-bit indices, no indices; buffers inside, beside and written in the text."""
    strided = b"".join(p.tobytes() + b"\xff" * 4 for p in POSITIONS)
    small = (POSITIONS.clip(0, 1) * 127).astype("<i1").tobytes()
    index = [np.array([0, 1, 2, 2, 1, 3], d).tobytes() for d in ("<u1", "<u2", "<u4")]
    data = strided + small + b"".join(index)
    at = np.cumsum([0, len(strided), len(small), *map(len, index)]).tolist()
    doc = {
        "asset": {"version": "2.0"},
        "meshes": [{"primitives": [{"attributes": {"POSITION": 0}, "indices": 2}, {"attributes": {"POSITION": 1}, "indices": 3}]},
                   {"primitives": [{"attributes": {"POSITION": 0}, "indices": 4}, {"attributes": {"POSITION": 0}}, {"attributes": {"POSITION": 0}, "mode": 1}]},
                   {"primitives": [{"attributes": {"POSITION": 5}}, {"attributes": {"POSITION": 6}}]}],
        "nodes": [{"mesh": 0, "translation": [1, 2, 3]}, {"mesh": 0}],
        "accessors": [view(3, 5126, "VEC3", bufferView=0, byteOffset=16), view(4, 5120, "VEC3", bufferView=1, normalized=True),
                      *(view(6, k, "SCALAR", bufferView=2 + i) for i, k in enumerate((5121, 5123, 5125))),
                      view(9, 5126, "VEC3", bufferView=0), view(4, 5126, "VEC3", bufferView=0, sparse={"count": 1})],
        "bufferViews": [{"buffer": 0, "byteOffset": at[k], "byteLength": at[k + 1] - at[k], **({"byteStride": 16} if k == 0 else {})} for k in range(5)],
        "buffers": [{"byteLength": len(data)}]}
    (tmp_path / "in.glb").write_bytes(glb(doc, data))
    (tmp_path / "a b.bin").write_bytes(data)
    (tmp_path / "beside.gltf").write_text(json.dumps({**doc, "buffers": [{"uri": "a%20b.bin"}]}))
    (tmp_path / "written.gltf").write_text(json.dumps({**doc, "buffers": [{"uri": "data:application/octet-stream;base64," + base64.b64encode(data).decode()}]}))
    docs = docs_of(spark, tmp_path)
    for piece in (2, gltf.PIECE):
        verts, loops = gltf.gltf_vertices(docs, piece).collect(), gltf.gltf_loops(docs, piece).collect()
        for name in ("in.glb", "beside.gltf", "written.gltf"):
            of = lambda rows, *key: sorted(tuple(r)[3:] for r in rows if r["path"].endswith(f"/{name}") and (r["mesh"], r["prim"]) == key)
            assert of(verts, 0, 0) == of(verts, 1, 1) == [(k, *POSITIONS[k + 1].tolist()) for k in range(3)]
            assert np.allclose([v[1:] for v in of(verts, 0, 1)], POSITIONS.clip(0, 1))
            want = [(k // 3, k % 3, v, 3) for k, v in enumerate([0, 1, 2, 2, 1, 3])]
            assert of(loops, 0, 0) == of(loops, 0, 1) == of(loops, 1, 0) == want and of(loops, 1, 1) == [(0, k, k, 3) for k in range(3)]
            assert of(verts, 1, 2) == of(verts, 2, 0) == of(verts, 2, 1) == []
    unread = {(r["mesh"], r["prim"]): r["reason"] for r in gltf.gltf_unread(docs).collect()}
    assert unread == {(1, 2): gltf.OTHER_MODE, (2, 0): gltf.OUTSIDE, (2, 1): gltf.SPARSE}
    inside = docs.filter("path LIKE '%in.glb'")
    world = gltf.world_vertices(gltf.gltf_vertices(inside), gltf.gltf_instances(inside)).filter("prim = 0 AND vert_id = 0").collect()
    assert {r["node_id"]: (r["x"], r["y"], r["z"]) for r in world} == {0: (2.0, 2.0, 3.0), 1: (1.0, 0.0, 0.0)}


def test_geometry_stays_on_disk(spark, tmp_path):
    """A head costs its JSON and 28 bytes; a file cut short or gone is a row."""
    doc = scene([{"mesh": 0}], bufferViews=[], buffers=[{"byteLength": 4_000_000}])
    (tmp_path / "big.glb").write_bytes(glb(doc, bytes(4_000_000)))
    (tmp_path / "cut.glb").write_bytes(glb(doc, bytes(4_000_000))[:-1])
    heads = by_name(gltf.read_heads(scan.asset_scan(spark, str(tmp_path), ".glb")).collect())
    big = heads["big.glb"]
    assert big["bytes_read"] == 28 + len(big["json"]) < 1000 and (big["bin_length"], big["bin_start"]) == (4_000_000, 28 + len(big["json"]))
    assert heads["cut.glb"]["error_message"] == gltf.BAD_LENGTH
    gone = spark.createDataFrame([(str(tmp_path / "gone.glb"),)], "path string")
    assert gltf.documents(gltf.read_heads(gone)).first()["error_message"] == gltf.UNREADABLE


def listed(folder):
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, found in os.walk(folder) for f in found)


def test_files_at_their_paths(spark, tmp_path):
    rows = spark.createDataFrame([("a/x.bin", b"1"), ("y.bin", b"22"), (str(tmp_path / "else" / "z z.bin"), None)], "path string, content binary").filter("content IS NOT NULL")
    places.write_files(rows, str(tmp_path / "out"))
    places.write_files(rows, str(tmp_path / "out"))
    assert listed(tmp_path / "out") == ["a/x.bin", "y.bin"] and (tmp_path / "out" / "y.bin").read_bytes() == b"22"


def test_a_failed_attempt_leaves_nothing(spark, tmp_path):
    made = spark.range(20, numPartitions=1).select(
        F.concat(F.lit("f"), F.col("id").cast("string")).alias("path"), F.when(F.col("id") < 19, "x").otherwise(F.raise_error(F.lit("no"))).cast("binary").alias("content"))
    with pytest.raises(Exception, match="no"):
        places.write_files(made, str(tmp_path / "out"))
    assert not os.path.isdir(tmp_path / "out") or listed(tmp_path / "out") == []


def test_reports_beside_their_places(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    for name in ("ok.glb", "deep/ok.glb"):
        (tmp_path / "in" / name).write_bytes(glb(scene([{"mesh": 0, "scale": [2, 2, 2]}])))
    (tmp_path / "in" / "bad.glb").write_bytes(b"abc")
    summary = inspector.inspect_folder(spark, str(tmp_path / "in"), str(tmp_path / "out")).first()
    assert summary["message"] == "Processed 3 files. 1 Error."
    assert listed(tmp_path / "out") == ["bad_report.json", "deep/ok_report.json", "ok_report.json"]
    report = json.loads((tmp_path / "out" / "deep" / "ok_report.json").read_text())
    assert (report["status"], report["materials"], report["dim_x"], report["vertices"]) == ("success", ["m"], 2.0, 8)


def test_a_long_chain_is_measured_once(spark, tmp_path):
    """Worlds and mesh sizes belong to the file, not to each of its nodes: 1,200 nodes over 300 meshes."""
    n, m = 1200, 300
    nodes = [{"mesh": k % m, "translation": [1, 0, 0], **({"children": [k + 1]} if k < n - 1 else {})} for k in range(n)]
    (tmp_path / "chain.glb").write_bytes(glb(scene(nodes, meshes=[{"primitives": [{"attributes": CUBE, "indices": 1, "material": 0}]}] * m)))
    docs, start = docs_of(spark, tmp_path), time.time()
    got = {r.node_id: r.world[3] for r in gltf.gltf_instances(docs).collect()}
    box = gltf.gltf_scene(docs).first()
    assert got == {k: k + 1.0 for k in range(n)}
    assert (box["vertices"], box["faces"], box["mesh_count"], box["min_x"], box["max_x"]) == (8 * n, 12 * n, n, 0.5, n + 0.5)
    assert time.time() - start < 60


def test_a_file_is_parsed_once(spark):
    files = asset_queries.scene_files(Tables(spark, "/root/testdata/sf0.001"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    docs = gltf.content_documents(files)
    assert plan(gltf.gltf_instances(docs)).count("from_json(") == 1 == plan(gltf.gltf_scene(docs)).count("from_json(")


def test_scenes_of_a_small_table_are_dealt_out(spark):
    files = asset_queries.scene_files(Tables(spark, "/root/testdata/sf0.001"))
    assert files.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_reports_are_read_at_their_paths(spark, tmp_path):
    """Each once, by name, whatever else is in the folder; one that is not there is an error."""
    out = str(tmp_path / "out")
    rows = spark.createDataFrame([("a/x", 1), ("y.json", 2), ("z/", None)], "path string, n long")
    reports.write_report_files(rows, F.col("path"), out)
    (tmp_path / "out" / "stray.json").write_text('{"n": 9}')
    found = reports.read_reports_at(rows.union(rows), out, "n long, more string").collect()
    assert sorted(map(tuple, found)) == [("a/x/report.json", 1, None), ("y.json", 2, None), ("z/report.json", None, None)]
    with pytest.raises(Exception, match="gone.json"):
        reports.read_reports_at(spark.createDataFrame([("gone.json",)], "path string"), out, "n long").collect()


def test_report_files_lists_no_folder(spark):
    back = entry.queries()["report_files"](spark, "/root/testdata/sf0.001")
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "FileScan json" not in plan and plan.count("from_json(") == 1 and back.count() == Tables(spark, "/root/testdata/sf0.001").read("part").count()


def test_models_are_dealt_out_and_measured_in_one_pass(spark):
    rows = entry.queries()["validation_report"](spark, "/root/testdata/sf0.001")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json(") == 1 == plan.count("REPARTITION_BY_NUM") and "/glb-" not in plan
