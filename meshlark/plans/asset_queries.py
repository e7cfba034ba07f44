"""Registered asset, file and report queries with their SQL checks."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from meshlark.functions.vector import rounded
from meshlark.operators import assets as A, camera as C, ledger as L, mesh as M, points as P
from meshlark.plans import candidates, inspector
from meshlark.plans.common import registrar
from meshlark.plans.mesh_queries import BOX, CORNERS, LOCAL, rs, rxyz
from meshlark.plans.oracle_views import noise, r, sql
from meshlark.plans.point_queries import BOUNDS, CROSS, _AREAS, _CUM, _FLOW, folded_xyz
from meshlark.session import cut, fresh_dir, spread
from meshlark.sources import gltf, models, places, reports, scan
from meshlark.sources.tables import Tables
from meshlark.streaming import ingest, skip

QUERIES, ORACLES = {}, {}
query = registrar(QUERIES, ORACLES)

STEM = "regexp_extract({}, '([^/]+?)([.][^./]*)?$', 1)"
EXT = "lower(regexp_extract(path, '[^/]([.][^./]*)$', 1))"
ROUTED = f"""SELECT *, {EXT} AS format, CASE WHEN NOT present THEN 'Model file not found: ' || path
    WHEN {EXT} NOT IN ('.glb','.gltf','.obj','.fbx','.stl','.blend') THEN 'Unsupported file extension: ' || {EXT} END AS error_message FROM assets"""

# -- finding and routing ----------------------------------------------------


@query("asset_scan", sql("assets", f"""
    SELECT asset_id, {STEM.format('path')} AS id, path AS input_path, '/out/' || {STEM.format('path')} AS output_path
    FROM assets WHERE path LIKE '/data/d4/%.glb' AND path NOT LIKE '/data/d4/%/%'"""))
def _(t):
    found = A.folder_assets(t.assets(), "/data/d4/", "glb")
    return found.select("asset_id", A.stem(F.col("path")).alias("id"), F.col("path").alias("input_path"), A.output_path("/out", F.col("path")).alias("output_path"))


@query("asset_scan_limit", sql("assets", """
    SELECT asset_id, path FROM assets WHERE path LIKE '/data/d4/%.glb' ORDER BY path LIMIT 2"""))
def _(t):
    return A.folder_assets(t.assets(), "/data/d4", ".glb", limit=2).select("asset_id", "path")


@query("format_routing", sql("assets", f"SELECT asset_id, format, error_message FROM ({ROUTED})"))
def _(t):
    return A.format_routing(t.assets()).select("asset_id", "format", "error_message")


@query("quarantine_split", sql("assets", f"""
    SELECT coalesce(split_part(error_message, ':', 1), 'good') AS side, format, count(*) AS n FROM ({ROUTED}) GROUP BY 1, 2"""))
def _(t):
    good, bad = A.quarantine_split(A.format_routing(t.assets()))
    tally = lambda df, side: df.groupBy(side.alias("side"), "format").agg(F.count("*").alias("n"))
    return tally(good, F.lit("good")).unionByName(tally(bad, F.split("error_message", ":")[0]))


@query("output_path", sql("assets", """
    SELECT asset_id, output_path, count(*) OVER (PARTITION BY output_path) AS n_same
    FROM (SELECT asset_id, '/out/' || """ + STEM.format("path") + """ || '/report.json' AS output_path FROM assets)"""))
def _(t):
    return A.with_collisions(t.assets(), "/out", "report.json").select("asset_id", "output_path", "n_same")


# -- model files ------------------------------------------------------------


def _le_hex(n):
    h = F.lpad(F.hex(n), 8, "0")
    return F.concat(*[F.substring(h, i, 2) for i in (7, 5, 3, 1)])


def glb_rows(t):
    """One GLB per order, built in SQL: its lines are the mesh. Some are cut short, some hold broken JSON.

    Dealt out by order while a row is small: few files of the shared folder would hold millions of GLBs, and a task
    would read each of them whole.
    """
    lines = t.read("lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "A").alias("a"),
        F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"), F.max("l_suppkey").alias("top"),
    )
    text = lambda c: F.col(c).cast("string")
    json = F.concat(
        F.lit('{"asset":{"version":"2.0"},"meshes":[{"name":"m","primitives":[{"attributes":{"POSITION":0},"indices":1,"material":0},'
              '{"attributes":{"POSITION":2},"mode":1}]}],"accessors":[{"count":'), text("top"),
        F.lit(',"min":['), text("lo"), F.lit(",0,-1],\"max\":["), text("hi"), F.lit(',2,1]},{"count":'), (F.col("n") * 3).cast("string"),
        F.lit('},{"count":'), text("a"), F.lit(',"min":[0.0,0,0],"max":[9,0,0]}],"materials":[{"name":"'), text("o_orderpriority"),
        F.lit('"},{"name":"base"}],"nodes":[{"name":"root","children":[1],"translation":[1,0,0]},{"name":"part","mesh":0,"translation":['), text("n"), F.lit(",0,2.5]}]}"),
    )
    body = F.when(F.col("l_orderkey") % 13 == 0, F.substring(json, 1, 20)).otherwise(json)
    orders = t.read("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    made = spread(lines.join(orders, "l_orderkey"), "l_orderkey").withColumn("body", body)
    size = F.octet_length("body")
    head = F.unhex(F.concat(F.lit("676C5446" "02000000"), _le_hex(size + 20), _le_hex(size), F.lit("4A534F4E")))
    whole = F.concat(head, F.encode("body", "UTF-8"))
    content = F.when(F.col("l_orderkey") % 11 == 0, F.substring(whole, 1, 3)).otherwise(whole)
    path = F.concat(F.lit("assets/o"), text("l_orderkey"), F.lit(".glb"))
    return made.select(path.alias("path"), F.length(content).cast("long").alias("length"), content.alias("content"))


def glb_files(t):
    """``glb_rows`` written down, for what reads the contents more than once."""
    return cut(glb_rows(t), "glb")


_GLB = """SELECT 'assets/o' || l_orderkey || '.glb' AS path, CASE WHEN l_orderkey % 11 = 0 THEN 'Invalid header' WHEN l_orderkey % 13 = 0 THEN 'Invalid JSON chunk' END AS error_message,
    top + a AS vertices, n AS faces, least(lo, 0e0) AS min_x, greatest(hi, 9e0) AS max_x, n, o_orderpriority FROM (
        SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'A') AS a, min(l_quantity) AS lo, max(l_quantity) AS hi, max(l_suppkey) AS top
        FROM lineitem GROUP BY 1) JOIN orders ON o_orderkey = l_orderkey"""


def _ok(c: str, name: str) -> str:
    return f"CASE WHEN error_message IS NULL THEN {c} END AS {name}"


@query("gltf_ingest", sql("", f"""
    SELECT path, CASE WHEN error_message IS NULL THEN 'success' ELSE 'error' END AS status, error_message, {_ok('vertices', 'vertices')}, {_ok('faces', 'faces')},
        {_ok('faces', 'triangles')}, {_ok('0', 'quads')}, {_ok('1', 'mesh_count')}, {_ok('2', 'node_count')}, {_ok("o_orderpriority || ',base'", 'materials')},
        {_ok('min_x', 'min_x')}, {_ok('max_x', 'max_x')}, {_ok('-1e0', 'min_z')} FROM g""", g=_GLB))
def _(t):
    stats = models.gltf_stats(glb_files(t))
    return stats.select(
        "path", "status", "error_message", "vertices", "faces", "triangles", F.col("quads").cast("int").alias("quads"), "mesh_count", "node_count",
        F.array_join("materials", ",").alias("materials"), "min_x", "max_x", "min_z",
    )


@query("glb_quarantine", sql("", """
    SELECT 'assets/o' || l_orderkey || '.glb' AS path, CASE WHEN error_message IS NULL THEN 'success' ELSE 'error' END AS status, error_message FROM (
        SELECT l_orderkey, CASE WHEN l_orderkey % 11 = 0 THEN 'Invalid header' WHEN l_orderkey % 17 = 0 THEN 'Chunk longer than the file'
            WHEN l_orderkey % 13 = 0 THEN 'Invalid JSON chunk' END AS error_message FROM (SELECT DISTINCT l_orderkey FROM lineitem))"""))
def _(t):
    files = glb_files(t)
    order = F.regexp_extract("path", "o([0-9]+)", 1).cast("long")
    endless = F.concat(F.expr("substring(content, 1, 12)"), F.unhex(F.lit("FFFFFFFF")), F.expr("substring(content, 17)"))
    damaged = files.withColumn("content", F.when((order % 17 == 0) & (F.length("content") > 20), endless).otherwise(F.col("content")))
    return models.gltf_stats(damaged).select("path", "status", "error_message")


@query("obj_quarantine", sql("", """
    SELECT 'o' || l_orderkey || '.obj' AS path, CASE WHEN message IS NULL THEN 'success' ELSE 'error' END AS status, message AS error_message,
        CASE WHEN message IS NULL THEN n END AS vertices, CASE WHEN message IS NULL THEN 1 END AS faces FROM (
        SELECT l_orderkey, count(*) AS n, CASE WHEN l_orderkey % 7 = 0 AND min(l_linenumber) = 1 THEN 'Invalid vertex line'
            WHEN l_orderkey % 5 = 0 THEN 'Invalid face line' WHEN count(*) < 3 THEN 'Face of a vertex that is not there' END AS message
        FROM lineitem GROUP BY 1)"""))
def _(t):
    line = F.col("l_linenumber").cast("long")
    x = F.when((F.col("l_orderkey") % 7 == 0) & (line == 1), "x").otherwise(F.col("l_quantity").cast("string"))
    vertex = F.concat_ws(" ", F.lit("v"), x, F.col("l_tax").cast("string"), F.col("l_discount").cast("string"))
    items = t.read("lineitem").select("l_orderkey", line.alias("seq"), vertex.alias("value"))
    faces = items.select("l_orderkey").distinct().select("l_orderkey", F.lit(1000).cast("long").alias("seq"), F.when(
        F.col("l_orderkey") % 5 == 0, "f 1 2 0").otherwise("f 1/1 2/2 3/3").alias("value"))
    lines = items.union(faces).select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string"), F.lit(".obj")).alias("path"), F.lit(0).alias("block"), "seq", "value")
    return models.obj_status(lines)


@query("stl_quarantine", sql("tris", """
    SELECT 'part' || part || '.stl' AS path, CASE WHEN part % 3 = 1 THEN 'error' ELSE 'success' END AS status,
        CASE WHEN part % 3 = 1 THEN 'Length does not fit the header' END AS error_message, CASE WHEN part % 3 <> 1 THEN n ELSE 0 END AS triangles
    FROM (SELECT tri_id // 700 AS part, count(*) AS n FROM tris GROUP BY 1)"""))
def _(t):
    part = F.floor(F.col("tri_id") / 700)
    whole = models.stl_files_of(t.tris().withColumn("path", F.concat(F.lit("part"), part.cast("string"), F.lit(".stl"))))
    number = F.regexp_extract("path", "([0-9]+)", 1).cast("long")
    files = cut(whole.withColumn("content", F.when(number % 3 == 1, F.expr("substring(content, 1, length(content) - 50)")).otherwise(F.col("content"))), "stl")
    found = models.stl_triangles(files).groupBy("path").agg(F.count("*").alias("n"))
    return models.stl_status(files).join(found, "path", "left").select("path", "status", "error_message", F.coalesce("n", F.lit(0)).alias("triangles"))


@query("gltf_nodes", sql("", """
    SELECT path, CAST(k AS INT) AS node_id, CASE WHEN k = 1 THEN 0 END AS parent_id, CASE k WHEN 0 THEN 'root' ELSE 'part' END AS name,
        CASE k WHEN 0 THEN 1e0 ELSE CAST(n AS DOUBLE) END AS tx, CASE k WHEN 0 THEN 0e0 ELSE 2.5e0 END AS tz FROM g, range(2) t(k) WHERE error_message IS NULL""", g=_GLB))
def _(t):
    return models.gltf_nodes(glb_files(t)).select("path", "node_id", "parent_id", "name", "tx", "tz")


@query("validation_report", sql("", f"""
    SELECT path AS file, {STEM.format('path')} || '_report.json' AS report_name, CASE WHEN error_message IS NULL THEN 'success' ELSE 'error' END AS status, error_message,
        {_ok('vertices', 'vertices')}, {_ok('faces', 'faces')}, {_ok('round(max_x - min_x, 4)', 'dim_x')}, {_ok('2e0', 'dim_y')}, {_ok('2e0', 'dim_z')},
        {_ok('o_orderpriority', 'materials')} FROM g""", g=_GLB))
def _(t):
    return inspector.model_reports(glb_rows(t)).withColumn("materials", F.array_join("materials", ","))


def scene_files(t):
    """One GLB a part, built in SQL: a mesh shown by three nodes (turned below a scaled one, by a matrix, mirrored) and one that none shows."""
    text = lambda c: F.col(c).cast("string")
    lit = F.lit
    body = F.concat(
        lit('{"asset":{"version":"2.0"},"meshes":[{"primitives":[{"attributes":{"POSITION":0},"indices":1,"material":0}]},'
            '{"primitives":[{"attributes":{"POSITION":0},"material":1}]}],"accessors":[{"count":8,"min":[-1,0,0],"max":[1,2,'), text("p_size"),
        lit(']},{"count":36}],"materials":[{"name":"'), text("p_brand"), lit('"},{"name":"spare"}],"nodes":[{"children":[1,2],"translation":['),
        (F.col("p_partkey") % 7).cast("string"), lit(',0,1],"scale":[2,2,2]},{"mesh":0,"rotation":[0,0,0.6,0.8],"translation":[0,'), text("p_size"),
        lit(',0]},{"mesh":0,"matrix":[3,0,0,0,0,1,0,0,0,0,1,0,0,0,-'), text("p_size"), lit(',1]},{"mesh":0,"scale":[-1,1,1]}]}'))
    # a part is a few bytes on disk and a whole scene to read: dealt out, or one task would read the scenes of a million rows
    made = spread(t.read("part").select("p_partkey", "p_size", "p_brand"), "p_partkey").withColumn("body", body)
    size = F.octet_length("body")
    whole = F.concat(F.unhex(F.concat(lit("676C5446" "02000000"), _le_hex(size + 20), _le_hex(size), lit("4A534F4E"))), F.encode("body", "UTF-8"))
    content = F.when(F.col("p_partkey") % 11 == 0, F.substring(whole, 1, 3)).otherwise(whole)
    return made.select(F.concat(lit("scenes/p"), text("p_partkey"), lit(".glb")).alias("path"), content.alias("content"), F.length(content).cast("long").alias("length"))


_SCENE = """SELECT 'scenes/p' || p_partkey || '.glb' AS path, p_partkey % 11 <> 0 AS good, p_brand, p_partkey % 7 AS m, CAST(p_size AS DOUBLE) AS s FROM part"""
_SCENE_BOX = {"min_x": "least(m - 6, -1e0)", "max_x": "greatest(m + 6, 1e0)", "min_y": "least(2 * s - 1.92e0, 0e0)", "max_y": "greatest(2 * s + 3.04e0, 4e0)",
              "min_z": "least(1 - 2 * s, 0e0)", "max_z": "greatest(2 * s + 1, s)"}


@query("gltf_world_bbox", sql("", f"""
    SELECT path, CASE WHEN good THEN 'success' ELSE 'error' END AS status, CASE WHEN good THEN 24 END AS vertices, CASE WHEN good THEN 36 END AS faces,
        CASE WHEN good THEN 3 END AS mesh_count, CASE WHEN good THEN p_brand END AS materials,
        {', '.join(f'round(CASE WHEN good THEN {e} END, 6) + 0.0 AS {n}' for n, e in _SCENE_BOX.items())} FROM s""", s=_SCENE))
def _(t):
    scene = gltf.gltf_scene(gltf.content_documents(scene_files(t)))
    return scene.select("path", "status", "vertices", "faces", "mesh_count", F.array_join("materials", ",").alias("materials"), *[rounded(c).alias(c) for c in _SCENE_BOX])


@query("gltf_instances", sql("", """
    SELECT path, v.* FROM s, (VALUES (1, 0.56e0, -1.92e0, 0.56e0), (2, 6e0, 0e0, 2e0), (3, -1e0, 0e0, 1e0)) v(node_id, m00, m01, m11) WHERE good""", s=_SCENE))
def _(t):
    found = gltf.gltf_instances(gltf.content_documents(scene_files(t)))
    return found.select("path", "node_id", *[rounded(F.col("world")[k]).alias(n) for k, n in ((0, "m00"), (1, "m01"), (5, "m11"))])


def tri_documents(t):
    """The triangles of each object as one GLB on disk, then its document, read by ranges."""
    folder = fresh_dir(t.spark, "glb")
    named = t.tris().withColumn("path", F.concat(F.lit("o"), F.col("obj_id").cast("string"), F.lit("/mesh.glb")))
    places.write_files(gltf.glb_files_of(named), folder)
    return gltf.documents(gltf.read_heads(scan.asset_scan(t.spark, folder, ".glb", recursive=True)))


def _obj_of():
    return F.regexp_extract("path", "/o([0-9]+)/mesh.glb$", 1).cast("int").alias("obj_id")


_RANKED = "SELECT *, row_number() OVER (PARTITION BY obj_id ORDER BY tri_id) - 1 AS i FROM tris"


@query("gltf_vertices", sql("tris", f"""
    SELECT obj_id, 3 * i + c AS vert_id, {', '.join(f"CAST(CAST(CASE c WHEN 0 THEN a{c} WHEN 1 THEN b{c}{'_' if c == 'y' else ''} ELSE c{c} END AS FLOAT) AS DOUBLE) AS {c}" for c in 'xyz')}
    FROM ranked, range(3) r(c)""", ranked=_RANKED))
def _(t):
    return gltf.gltf_vertices(tri_documents(t), piece=1000).select(_obj_of(), "vert_id", "x", "y", "z")


@query("gltf_loops", sql("tris", "SELECT obj_id, i AS face_id, CAST(c AS INT) AS pos, 3 * i + c AS vert_id, 3 AS n FROM ranked, range(3) r(c)", ranked=_RANKED))
def _(t):
    return gltf.gltf_loops(tri_documents(t), piece=1000).select(_obj_of(), "face_id", "pos", "vert_id", "n")


@query("report_files", sql("", f"""
    SELECT 'scenes/p' || regexp_extract(path, '([0-9]+)', 1) || '_report.json' AS report, CASE WHEN good THEN 'success' ELSE 'error' END AS status,
        CASE WHEN good THEN p_brand END AS materials, round(CASE WHEN good THEN {_SCENE_BOX['max_x']} - {_SCENE_BOX['min_x']} END, 4) + 0.0 AS dim_x FROM s""", s=_SCENE))
def _(t):
    folder = fresh_dir(t.spark, "reports")
    rows, path = inspector.model_reports(scene_files(t)), F.concat(F.lit("scenes/"), F.col("report_name"))
    reports.write_report_files(rows, path, folder)
    back = reports.read_reports_at(rows.select(path.alias("path")), folder, "status string, materials array<string>, dim_x double")
    return back.select(F.col("path").alias("report"), "status", F.array_join("materials", ",").alias("materials"), "dim_x")


@query("validation_summary", sql("", """
    SELECT count(*) AS processed, count(error_message) AS errors, 'Processed ' || count(*) || ' files. ' || count(error_message) || ' Error.' AS message FROM g""", g=_GLB))
def _(t):
    return A.validation_summary(inspector.model_reports(glb_rows(t)))


# one OBJ file per 5000 faces, written as text and read back
_PARTS = "SELECT face_id // 5000 AS part, face_id, pos, vert_id, obj_id FROM loops"


def obj_parts(t):
    """(path, vert key) tables of each part: its own vertices, numbered from 0. Corners are dealt by part once and numbered there."""
    key = (F.col("vert_id") * 10 + F.col("obj_id")).alias("key")
    number = F.dense_rank().over(Window.partitionBy("path").orderBy("key")).cast("long") - 1
    loops = t.loops(F.floor(F.col("l_orderkey") / 5000).cast("long")).select("path", "face_id", "pos", key).withColumn("vert_id", number)
    place = t.vertices().select(key, "x", "y", "z")
    ids = loops.groupBy("path", "key").agg(F.first("vert_id").alias("vert_id"))
    return ids.join(place, "key").select("path", "vert_id", "x", "y", "z"), loops.drop("key")


def read_obj_parts(t):
    folder = fresh_dir(t.spark, "obj")
    lines = models.obj_lines_of(*obj_parts(t))
    lines.repartition("path").sortWithinPartitions("path", "kind", "ord").select(F.col("path").alias("part"), "value").write.partitionBy("part").text(folder)
    read = scan.asset_lines(t.spark, folder, "*.txt")
    verts, loops = models.obj_tables(models.obj_counted(read))
    part = F.regexp_extract("path", "part=([0-9]+)", 1).cast("long").alias("part")
    return verts.select(part, "vert_id", "x", "y", "z"), loops.select(part, "face_id", "pos", "vert_id", "n")


@query("obj_ingest", sql("loops", """
    SELECT part, dense_rank() OVER (PARTITION BY part ORDER BY face_id) - 1 AS face_id, pos, n,
        dense_rank() OVER (PARTITION BY part ORDER BY vert_id * 10 + obj_id) - 1 AS vert_id FROM (SELECT face_id // 5000 AS part, * FROM loops)"""))
def _(t):
    return read_obj_parts(t)[1]


@query("obj_vertices", sql("loops vertices", f"""
    SELECT part, row_number() OVER (PARTITION BY part ORDER BY vert_id * 10 + obj_id) - 1 AS vert_id, {rs('x y z')}
    FROM (SELECT DISTINCT face_id // 5000 AS part, obj_id, vert_id FROM loops) JOIN vertices USING (obj_id, vert_id)"""))
def _(t):
    return rxyz(read_obj_parts(t)[0], "part", "vert_id")


@query("stl_ingest", sql("tris", f"""
    SELECT 'part' || (tri_id // 700) || '.stl' AS path, tri_id % 700 AS tri_id, {rs('ax ay az bx by_ bz cx cy cz')} FROM tris"""))
def _(t):
    files = models.stl_files_of(t.tris().withColumn("path", F.concat(F.lit("part"), F.floor(F.col("tri_id") / 700).cast("string"), F.lit(".stl"))))
    return rxyz(models.stl_triangles(files), "path", "tri_id", cols=models.CORNERS)


# -- reports ----------------------------------------------------------------

_MESHES = "SELECT obj_id % 10 AS obj_id, material FROM objects WHERE type = 'MESH'"
_REPORT = {
    "local_box": LOCAL, "corners": CORNERS, "box": f"SELECT obj_id, {BOX} FROM corners GROUP BY 1", "fam": _MESHES,
    "cnt": "SELECT obj_id, count(DISTINCT vert_id) AS vertices, count(DISTINCT face_id) AS faces FROM loops GROUP BY 1",
    "top": """SELECT obj_id, count(*) FILTER (WHERE n = 3) AS triangles, count(*) FILTER (WHERE n = 4) AS quads,
        count(*) FILTER (WHERE n NOT IN (3, 4)) AS ngons FROM loops WHERE pos = 0 GROUP BY 1""",
    "mat": "SELECT obj_id, array_to_string(list_sort(list(DISTINCT material)), ',') AS materials, count(*) AS mesh_count FROM fam GROUP BY 1",
}
_BOX_NAMES = " ".join(f"{n}_{c}" for c in "xyz" for n in ("center", "dim", "min", "max"))
_REPORT_SQL = f"""SELECT obj_id, vertices, faces, triangles, quads, ngons, coalesce(materials, '') AS materials, coalesce(mesh_count, 0) AS mesh_count,
    {_BOX_NAMES.replace(' ', ', ')} FROM cnt JOIN top USING (obj_id) JOIN box USING (obj_id) LEFT JOIN mat USING (obj_id)"""


@query("assemble_report", sql("loops vertices objects", _REPORT_SQL, **_REPORT))
def _(t):
    return inspector.scene_reports(t).withColumn("materials", F.array_join("materials", ","))


@query("write_reports", sql("loops vertices objects", "SELECT 'm' || obj_id || '.glb' AS filename, vertices, triangles, center_x, mesh_count, 'm' || obj_id AS stem FROM rep",
                            **_REPORT, rep=_REPORT_SQL))
def _(t):
    folder = fresh_dir(t.spark, "reports")
    docs = A.report_document(inspector.scene_reports(t), F.concat(F.lit("m"), F.col("obj_id").cast("string"), F.lit(".glb")))
    reports.write_reports(docs, folder)
    back = reports.read_reports(t.spark, folder, "filename string, geometry struct<vertices bigint, faces bigint>, topology struct<triangles bigint>, "
                                "bounding_box struct<center array<double>>, mesh_count bigint, stem string")
    return back.select("filename", "geometry.vertices", "topology.triangles", F.col("bounding_box.center")[0].alias("center_x"), "mesh_count", "stem")


@query("asset_scan_recursive", sql("assets", "SELECT DISTINCT CAST(asset_id % 40 AS VARCHAR) AS stem FROM assets"))
def _(t):
    folder = fresh_dir(t.spark, "found")
    reports.write_reports(t.assets().withColumn("stem", (F.col("asset_id") % 40).cast("string")), folder)
    found = scan.asset_scan(t.spark, folder, "json", recursive=True)
    return found.select(F.regexp_extract("path", "stem=([^/]*)/", 1).alias("stem")).distinct()


@query("render_metadata", sql("vertices objects cameras", f"""
    SELECT 'c' || cam_id AS id, 'm' || cam_id || '.glb' AS source_file, 512 AS res_x, 512 AS res_y,
        {', '.join(f'coalesce({n}_{c}, 0) AS {n}_{c}' for n in ('center', 'dim') for c in 'xyz')}, coalesce(lens, 50e0) AS focal_length,
        {r('k.x', 'pos_x', 4)}, {r('k.y', 'pos_y', 4)}, {r('k.z', 'pos_z', 4)}, 0e0 AS look_x, 0e0 AS look_y, 0e0 AS look_z
    FROM cameras k LEFT JOIN box USING (obj_id)""", local_box=LOCAL, corners=CORNERS, box=f"SELECT obj_id, {BOX} FROM corners GROUP BY 1"))
def _(t):
    box = M.world_bbox(M.world_corners(M.local_bounds(t.vertices(), "obj_id"), t.objects()), "obj_id")
    items = t.cameras().select(
        F.concat(F.lit("c"), F.col("cam_id").cast("string")).alias("id"), F.col("obj_id").cast("long").alias("obj_id"), "cam_id",
        F.concat(F.lit("/in/m"), F.col("cam_id").cast("string"), F.lit(".glb")).alias("input_path"),
    )
    return A.render_metadata(items, box, C.intrinsics(t.cameras()))


@query("modality_jobs", sql("assets", f"""
    SELECT asset_id AS id, modality, '/out/' || {STEM.format('path')} || '/render_' || modality AS target, 512 AS res_x, 512 AS res_y,
        CAST(CASE WHEN asset_id % 3 = 0 THEN 64 ELSE 128 END AS INT) AS samples FROM assets, (VALUES ('textured'), ('normal'), ('depth'), ('edge')) m(modality)"""))
def _(t):
    items = t.assets().select(
        F.col("asset_id").alias("id"), A.output_path("/out", F.col("path")).alias("output_path"), F.when(F.col("asset_id") % 3 == 0, 64).alias("render_samples")
    )
    return C.modality_jobs(items)


_PICKED = """SELECT obj_id, i AS idx, x, y, z FROM o JOIN range(5) t(i) ON CASE WHEN n <= 5 THEN ord = i ELSE ord = CAST(floor(i * (n / 5e0)) AS BIGINT) END"""
_AIMS = f"""SELECT obj_id, idx, {folded_xyz('r1', 'r2', whole=True)} FROM (
    SELECT d.*, f.*, row_number() OVER (PARTITION BY d.obj_id, idx ORDER BY rn) AS first FROM (SELECT obj_id, idx, {noise(42, repr('face'), 'obj_id', 'idx')} AS u,
        {noise(42, repr('r1'), 'obj_id', 'idx')} AS r1, {noise(42, repr('r2'), 'obj_id', 'idx')} AS r2 FROM picked) d
    JOIN cum f ON f.obj_id = d.obj_id AND (u <= hi OR rn = f.n)) WHERE first = 1"""


@query("camera_log", sql("tris", f"""
    SELECT obj_id, 'spline' AS mode, CAST(42 AS BIGINT) AS seed, 0.3e0 AS sdf_threshold, 150 AS frames, 640 AS res_x, 480 AS res_y, 30 AS fps,
        {r('least(max_x-min_x, max_y-min_y, max_z-min_z) / 2', 'max_sdf_value')}, n_points, {r('first_x', 'first_x')}, n_aims, {rs('aim_x aim_y aim_z')}
    FROM (SELECT obj_id, CAST(count(*) AS INT) AS n_points, arg_min(x, idx) AS first_x FROM picked GROUP BY 1)
    JOIN (SELECT obj_id, CAST(count(*) AS INT) AS n_aims, avg(x) AS aim_x, avg(y) AS aim_y, avg(z) AS aim_z FROM aims GROUP BY 1) USING (obj_id) JOIN b USING (obj_id)""",
    **_FLOW, picked=_PICKED, c=CROSS, areas=_AREAS, cum=_CUM, aims=_AIMS))
def _(t):
    tris = t.tris()
    points = candidates.control_points(candidates.camera_candidates(tris, 14.0, 0.3, 42))
    aims = P.area_weighted_sample(tris, points.select("obj_id", F.col("idx").alias("draw")), 42).withColumnRenamed("draw", "idx")
    top = P.estimated_max_sdf(P.tri_bounds(tris)).select("obj_id", rounded("max_sdf").alias("max_sdf_value"))
    log = A.camera_log(points, aims, top, "spline", 42, 0.3)
    return log.select(
        "obj_id", "mode", "seed", "sdf_threshold", "frames", "res_x", "res_y", "fps", "max_sdf_value", F.size("control_points").alias("n_points"),
        F.col("control_points")[0]["x"].alias("first_x"), F.size("aim_targets").alias("n_aims"), "aim_x", "aim_y", "aim_z",
    )


# -- streams ----------------------------------------------------------------


@query("stream_ingest", sql("assets", f"""
    SELECT asset_id, format, CASE WHEN error_message IS NULL THEN 'success' ELSE 'error' END AS status, error_message FROM ({ROUTED})"""))
def _(t):
    out, seen = fresh_dir(t.spark, "ingested"), fresh_dir(t.spark, "ingest-state")
    source = ingest.table_stream(t.spark, t.dir, "pages.parquet", t.read("pages").schema)

    def report(batch):
        status = F.when(F.col("error_message").isNull(), "success").otherwise("error").alias("status")
        return A.format_routing(Tables.assets_of(batch)).select("asset_id", "format", status, "error_message")

    ingest.run_ingest(source, report, out, seen).awaitTermination()
    return t.spark.read.parquet(out).drop("batch")


@query("stream_skip", sql("ledger", "SELECT DISTINCT item_id, step_key FROM ledger WHERE success"))
def _(t):
    out, seen = fresh_dir(t.spark, "firsts"), fresh_dir(t.spark, "skip-state")
    events = ingest.table_stream(t.spark, t.dir, "events.parquet", t.read("events").schema)
    ledger = events.select(F.col("user_id").alias("item_id"), F.col("event_type").alias("step_key"), (F.col("event_type") != "error").alias("success"), "ts")
    skip.run_to_table(skip.first_successes(ledger, "3650 days"), out, seen).awaitTermination()
    return t.spark.read.parquet(out).select("item_id", "step_key")
