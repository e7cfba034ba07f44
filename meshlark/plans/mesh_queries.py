"""Registered mesh queries with their SQL checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshlark.functions.vector import rounded
from meshlark.operators import mesh as M, winding
from meshlark.plans.common import registrar
from meshlark.plans.oracle_views import r, sql

QUERIES, ORACLES = {}, {}
query = registrar(QUERIES, ORACLES)


def rxyz(df, *keep, cols=("x", "y", "z"), places=6):
    return df.select(*keep, *[rounded(c, places).alias(c) for c in cols])


def rs(cols: str, places: int = 6) -> str:
    return ", ".join(r(c, c, places) for c in cols.split())


# shared CTE texts
LOCAL = "SELECT obj_id, " + ", ".join(f"{f}({c}) AS {f}_{c}" for f in ("min", "max") for c in "xyz") + " FROM vertices GROUP BY 1"
_X = "(CASE WHEN sa < 0 THEN min_x ELSE max_x END) * scale_x"
_Y = "(CASE WHEN sb < 0 THEN min_y ELSE max_y END)"
CORNERS = f"""SELECT obj_id, cos(rot_z) * ({_X}) - sin(rot_z) * {_Y} + loc_x AS x, sin(rot_z) * ({_X}) + cos(rot_z) * {_Y} + loc_y AS y,
    (CASE WHEN sc < 0 THEN min_z ELSE max_z END) + loc_z AS z FROM local_box JOIN objects USING (obj_id),
    (VALUES (-1),(1)) a(sa), (VALUES (-1),(1)) b(sb), (VALUES (-1),(1)) c(sc)"""
BOX = ", ".join(
    f"{r(f'(min({c}) + max({c})) / 2', f'center_{c}', 4)}, {r(f'max({c}) - min({c})', f'dim_{c}', 4)}, {r(f'min({c})', f'min_{c}', 4)}, {r(f'max({c})', f'max_{c}', 4)}"
    for c in "xyz"
)
WORLD = """SELECT obj_id, vert_id, cos(rot_z) * (x * scale_x) - sin(rot_z) * y + loc_x AS x,
    sin(rot_z) * (x * scale_x) + cos(rot_z) * y + loc_y AS y, z + loc_z AS z FROM vertices JOIN objects USING (obj_id)"""
BOUNDARY = "SELECT obj_id, v_lo, v_hi, min(face_id) AS face_id FROM face_edges GROUP BY 1, 2, 3 HAVING count(*) = 1"
BAD = """SELECT DISTINCT obj_id, face_id FROM (SELECT obj_id, face_id, row_number() OVER (PARTITION BY obj_id, vs ORDER BY face_id) AS k FROM
    (SELECT obj_id, face_id, list_sort(list(DISTINCT vert_id)) AS vs FROM loops GROUP BY 1, 2)) WHERE k > 1"""


def corners(t):
    return M.world_corners(M.local_bounds(t.vertices(), "obj_id"), t.objects())


# -- objects ----------------------------------------------------------------


@query("mesh_objects", sql("objects", "SELECT obj_id, material FROM objects WHERE type = 'MESH'"))
def _(t):
    return M.mesh_objects(t.objects()).select("obj_id", "material")


@query("new_objects", sql("objects", """SELECT obj_id, type FROM objects WHERE obj_id NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)"""))
def _(t):
    before = t.read("lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("obj_id")).distinct()
    return M.new_objects(t.objects(), before).select("obj_id", "type")


@query("material_names", sql("objects", "SELECT DISTINCT type, material FROM objects WHERE material IS NOT NULL"))
def _(t):
    return M.material_names(t.objects(), "type")


@query("scene_audit", sql("objects", """
    SELECT count(*) FILTER (WHERE users > 1) AS multi_user_fixed,
        count(*) FILTER (WHERE abs(scale_x - 1) > 0.001 OR abs(rot_z) > 0.001) AS transforms_applied,
        CAST(sum(n_modifiers) AS BIGINT) AS modifiers_applied, count(*) FILTER (WHERE scale_x < 0) AS normals_fixed,
        count(*) AS total_mesh_objects FROM objects WHERE type = 'MESH'"""))
def _(t):
    return M.scene_audit(t.objects())


@query("orphan_blocks", """
    SELECT kind, count(*) AS orphans FROM (
        SELECT 'mesh' AS kind, p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A')
        UNION ALL SELECT 'camera', c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'))
    GROUP BY 1""")
def _(t):
    block = lambda name, key, kind: t.read(name).select(F.lit(kind).alias("kind"), F.col(key).alias("block_id"))
    blocks = block("part", "p_partkey", "mesh").union(block("customer", "c_custkey", "camera"))
    use = lambda name, key, kind, cond: t.read(name).filter(cond).select(F.lit(kind).alias("kind"), F.col(key).alias("block_id"))
    uses = use("lineitem", "l_partkey", "mesh", "l_returnflag = 'A'").union(use("orders", "o_custkey", "camera", "o_orderstatus = 'F'"))
    return M.orphan_blocks(blocks, uses)


# -- counts and bounds ------------------------------------------------------


@query("geometry_counts", sql("loops", """
    SELECT obj_id, count(DISTINCT vert_id) AS vertices, count(DISTINCT face_id) AS faces FROM loops GROUP BY 1"""))
def _(t):
    return M.geometry_counts(t.mesh_vertex_ids(), t.faces())


@query("topology", sql("loops", """
    SELECT obj_id, count(*) FILTER (WHERE n = 3) AS triangles, count(*) FILTER (WHERE n = 4) AS quads,
        count(*) FILTER (WHERE n NOT IN (3, 4)) AS ngons FROM loops WHERE pos = 0 GROUP BY 1"""))
def _(t):
    return M.topology(t.faces(), "obj_id")


@query("world_bbox", sql("vertices objects", f"SELECT obj_id, {BOX} FROM corners GROUP BY 1", local_box=LOCAL, corners=CORNERS))
def _(t):
    return M.world_bbox(corners(t), "obj_id")


@query("scene_bounds", sql("vertices objects", f"SELECT {BOX} FROM corners", local_box=LOCAL, corners=CORNERS))
def _(t):
    box = M.scene_bounds(corners(t))
    return rxyz(box, cols=box.columns, places=4)


_SPHERE = """SELECT obj_id, cx, cy, cz, max(sqrt((x-cx)*(x-cx) + (y-cy)*(y-cy) + (z-cz)*(z-cz))) AS radius
    FROM corners JOIN (SELECT obj_id, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM corners GROUP BY 1) USING (obj_id) GROUP BY 1, 2, 3, 4"""


@query("bounding_sphere", sql("vertices objects", f"SELECT obj_id, {rs('cx cy cz radius')} FROM sphere", local_box=LOCAL, corners=CORNERS, sphere=_SPHERE))
def _(t):
    return rxyz(M.bounding_sphere(corners(t), "obj_id"), "obj_id", cols=("cx", "cy", "cz", "radius"))


_BOX_CORNER = ", ".join(
    r(f"(min_{c} + max_{c}) / 2 + ({s}) * 0.5 * ((max_{c} - min_{c}) * 1.01)", c)
    for c, s in (("x", "floor(k / 4) * 2 - 1"), ("y", "floor(k / 2) % 2 * 2 - 1"), ("z", "k % 2 * 2 - 1"))
)


@query("aabb_box", sql("vertices", f"SELECT obj_id, CAST(k AS INT) AS corner, {_BOX_CORNER} FROM local_box, range(8) t(k)", local_box=LOCAL))
def _(t):
    return rxyz(M.aabb_box(M.local_bounds(t.vertices(), "obj_id"), "obj_id"), "obj_id", "corner")


@query("aabb_box_faces", sql("loops", """
    SELECT obj_id, CAST(f AS INT) AS face_id, CAST(p AS INT) AS pos, CAST(q[p + 1] AS INT) AS corner FROM (SELECT DISTINCT obj_id FROM loops),
        (VALUES (0, [0,1,3,2]), (1, [2,3,7,6]), (2, [6,7,5,4]), (3, [4,5,1,0]), (4, [2,6,4,0]), (5, [7,3,1,5])) v(f, q), range(4) r(p)"""))
def _(t):
    return M.box_faces(t.mesh_vertex_ids().select("obj_id").distinct(), "obj_id")


# -- edges and faces --------------------------------------------------------


@query("face_edges", sql("face_edges", "SELECT obj_id, v_lo, v_hi, count(*) AS uses FROM face_edges GROUP BY 1, 2, 3"))
def _(t):
    return M.face_edges(t.loops()).groupBy("obj_id", "v_lo", "v_hi").agg(F.count("*").alias("uses"))


@query("boundary_edges", sql("face_edges", BOUNDARY))
def _(t):
    return M.boundary_edges(M.face_edges(t.loops()))


@query("single_sided_faces", sql("face_edges", """
    SELECT k.obj_id, k.face_id, pos, dense_rank() OVER (PARTITION BY k.obj_id ORDER BY vert_id) - 1 AS vert_id
    FROM loops k WHERE (obj_id, face_id) IN (SELECT obj_id, face_id FROM boundary)""", boundary=BOUNDARY))
def _(t):
    return M.single_sided_faces(t.loops()).select("obj_id", "face_id", "pos", "vert_id")


@query("delete_faces", sql("face_edges", """
    SELECT obj_id, count(*) FILTER (WHERE hit) AS deleted_faces, count(*) FILTER (WHERE NOT hit) AS result_faces FROM
        (SELECT obj_id, (obj_id, face_id) IN (SELECT obj_id, face_id FROM boundary) AS hit FROM loops WHERE pos = 0) GROUP BY 1""", boundary=BOUNDARY))
def _(t):
    loops = t.loops()
    return M.deletion_report(loops, M.delete_boundary_faces(loops))


@query("delete_matching_faces", sql("loops vertices", """
    SELECT obj_id, face_id, pos, vert_id FROM loops WHERE (obj_id, face_id) NOT IN (
        SELECT obj_id, face_id FROM loops JOIN vertices USING (obj_id, vert_id) GROUP BY 1, 2 HAVING bool_and(vert_id % 3 <> 0 OR x > 0))"""))
def _(t):
    verts = t.vertices()
    reference = verts.filter("vert_id % 3 <> 0 OR x > 0")
    return M.delete_matching_faces(t.loops(), verts, reference, 1e-9).select("obj_id", "face_id", "pos", "vert_id")


@query("drop_bad_faces", sql("loops", "SELECT obj_id, face_id, pos, vert_id FROM loops WHERE (obj_id, face_id) NOT IN (SELECT * FROM bad)", bad=BAD))
def _(t):
    return M.drop_bad_faces(t.loops()).select("obj_id", "face_id", "pos", "vert_id")


# even objects are the targets, odd ones are appended to the one before
@query("append_mesh", sql("loops", """
    SELECT o.obj_id - o.obj_id % 2 AS obj_id, face_id, pos, new_id + CASE WHEN o.obj_id % 2 = 1 THEN n_vertices ELSE 0 END AS vert_id,
        CASE WHEN o.obj_id % 2 = 1 THEN 'source' ELSE 'target' END AS part
    FROM numbered o LEFT JOIN (SELECT obj_id, count(DISTINCT vert_id) AS n_vertices FROM loops GROUP BY 1) s ON s.obj_id = o.obj_id - 1
    WHERE o.obj_id % 2 = 0 OR (o.obj_id, face_id) NOT IN (SELECT * FROM skip)""",
    numbered="SELECT *, dense_rank() OVER (PARTITION BY obj_id ORDER BY vert_id) - 1 AS new_id FROM loops",
    broken="SELECT obj_id, face_id FROM loops GROUP BY 1, 2 HAVING count(*) > count(DISTINCT vert_id)",
    skip="""SELECT * FROM broken UNION SELECT obj_id, face_id FROM (
        SELECT obj_id, face_id, row_number() OVER (PARTITION BY obj_id, vs ORDER BY face_id) AS k FROM
        (SELECT obj_id, face_id, list_sort(list(vert_id)) AS vs FROM loops WHERE (obj_id, face_id) NOT IN (SELECT * FROM broken) GROUP BY 1, 2)) WHERE k > 1"""))
def _(t):
    loops = M.renumber(t.loops(), M.compacted(t.mesh_vertex_ids()))
    even = F.col("obj_id") % 2 == 0
    sizes = t.mesh_vertex_ids().filter(even).groupBy("obj_id").agg(F.count("*").alias("n_vertices"))
    appended = loops.filter(~even).withColumn("obj_id", F.col("obj_id") - 1)
    return M.append_mesh(loops.filter(even), sizes, appended).select("obj_id", "face_id", "pos", "vert_id", "part")


_MERGED = "SELECT obj_id, vert_id, row_number() OVER (ORDER BY obj_id, vert_id) - 1 AS new_id FROM vertices"


@query("merge_meshes", sql("vertices objects", f"SELECT new_id AS vert_id, {rs('x y z')} FROM world JOIN merged USING (obj_id, vert_id)",
                           world=WORLD, merged=_MERGED))
def _(t):
    return rxyz(M.merge_vertices(t.vertices(), t.objects()), "vert_id")


@query("merge_mesh_loops", sql("loops vertices", "SELECT obj_id, face_id, pos, new_id AS vert_id FROM loops JOIN merged USING (obj_id, vert_id)", merged=_MERGED))
def _(t):
    return M.renumber(t.loops(), M.merged_ids(t.mesh_vertex_ids())).select("obj_id", "face_id", "pos", "vert_id")


# -- transforms -------------------------------------------------------------


@query("apply_transform", sql("vertices objects", f"""
    SELECT obj_id, vert_id, {r('cos(rot_z) * (x * scale_x) - sin(rot_z) * y', 'x')}, {r('sin(rot_z) * (x * scale_x) + cos(rot_z) * y', 'y')}, {r('z', 'z')}
    FROM vertices JOIN objects USING (obj_id)"""))
def _(t):
    return rxyz(M.place_vertices(t.vertices(), t.objects(), keep_location=True), "obj_id", "vert_id")


@query("flip_negative", sql("loops objects", """
    SELECT obj_id, face_id, CASE WHEN scale_x < 0 THEN n - 1 - pos ELSE pos END AS pos, vert_id FROM loops JOIN objects USING (obj_id)"""))
def _(t):
    return M.flip_negative(t.loops(), t.objects()).select("obj_id", "face_id", "pos", "vert_id")


def part_boxes(t):
    """(loops, vertices): a box a part, some of its faces turned round."""
    key, size = F.col("p_partkey"), F.col("p_size").cast("double")
    ends = {"min_x": key % 7, "max_x": key % 7 + size, "min_y": -size, "max_y": F.lit(1.0), "min_z": F.lit(2.0), "max_z": 2 + size / 4}
    bounds = t.read("part").select(key.alias("obj_id"), *[e.cast("double").alias(c) for c, e in ends.items()])
    face = F.col("face_id")
    turned = (F.col("obj_id") * 5 + face * face) % 3 == 0
    loops = M.box_faces(bounds, "obj_id").select(
        "obj_id", (F.col("obj_id") * 6 + face).alias("face_id"), F.when(turned, 3 - F.col("pos")).otherwise(F.col("pos")).alias("pos"),
        F.col("corner").alias("vert_id"), F.lit(4).alias("n"))
    return loops, M.aabb_box(bounds, "obj_id", padding=0.0).withColumnRenamed("corner", "vert_id")


_BOX_LOOPS = """SELECT p_partkey AS obj_id, p_partkey * 6 + f AS face_id, CAST(p AS INT) AS pos, CAST(q[p + 1] AS INT) AS vert_id,
        (p_partkey * 5 + f * f) % 3 = 0 AS turned FROM part,
        (VALUES (0, [0,1,3,2]), (1, [2,3,7,6]), (2, [6,7,5,4]), (3, [4,5,1,0]), (4, [2,6,4,0]), (5, [7,3,1,5])) v(f, q), range(4) r(p)"""


@query("outward_winding", sql("", "SELECT obj_id, face_id, pos, vert_id FROM box_loops", box_loops=_BOX_LOOPS))
def _(t):
    loops, vertices = part_boxes(t)
    return winding.outward_winding(loops, vertices).select("obj_id", "face_id", "pos", "vert_id")


@query("outward_turns", sql("", "SELECT DISTINCT obj_id, face_id, obj_id * 6 AS part, turned AS turn FROM box_loops", box_loops=_BOX_LOOPS))
def _(t):
    return winding.outward_turns(*part_boxes(t))


@query("center_at_origin", sql("vertices objects", f"""
    SELECT obj_id, vert_id, {r('x - cx', 'x')}, {r('y - cy', 'y')}, {r('z - cz', 'z')} FROM world
    JOIN (SELECT obj_id, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM corners GROUP BY 1) USING (obj_id)""", local_box=LOCAL, corners=CORNERS, world=WORLD))
def _(t):
    return rxyz(M.center_at_origin(t.vertices(), t.objects()), "obj_id", "vert_id")


# -- triangles --------------------------------------------------------------


@query("triangulate", sql("ring", """
    SELECT b.obj_id, b.face_id, b.pos - 1 AS tri, a.vert_id AS v0, b.a AS v1, b.b AS v2
    FROM ring b JOIN loops a ON a.face_id = b.face_id AND a.pos = 0 WHERE b.pos BETWEEN 1 AND b.n - 2"""))
def _(t):
    return M.triangulate(t.loops())


CROSS = """SELECT *, (by_-ay)*(cz-az) - (bz-az)*(cy-ay) AS ux, (bz-az)*(cx-ax) - (bx-ax)*(cz-az) AS uy, (bx-ax)*(cy-ay) - (by_-ay)*(cx-ax) AS uz FROM tris"""


@query("face_area", sql("tris", f"SELECT tri_id, obj_id, {r('0.5 * sqrt(ux*ux + uy*uy + uz*uz)', 'area', 8)} FROM c WHERE ux*ux + uy*uy + uz*uz > 0", c=CROSS))
def _(t):
    return rxyz(M.face_areas(t.tris()), "tri_id", "obj_id", cols=("area",), places=8)


@query("face_normals", sql("tris", f"""
    SELECT tri_id, obj_id, {r('ux / sqrt(ux*ux + uy*uy + uz*uz)', 'nx')}, {r('uy / sqrt(ux*ux + uy*uy + uz*uz)', 'ny')},
        {r('uz / sqrt(ux*ux + uy*uy + uz*uz)', 'nz')} FROM c""", c=CROSS))
def _(t):
    return rxyz(M.face_normals(t.tris()), "tri_id", "obj_id", cols=("nx", "ny", "nz"))
