"""Registered trajectory and camera queries with their SQL checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshlark.operators import camera as C, mesh as M, points as P, trajectory as T
from meshlark.plans.common import registrar
from meshlark.plans.mesh_queries import rs, rxyz
from meshlark.plans.oracle_views import r, sql

QUERIES, ORACLES = {}, {}
query = registrar(QUERIES, ORACLES)


def waypoints(t):
    """One path per vector: its triples in order."""
    return t.points().select(
        F.floor(F.col("pt_id") / 21).cast("long").alias("path_id"), (F.col("pt_id") % 21).cast("int").alias("idx"), "x", "y", "z"
    )


WAYPOINTS = "SELECT pt_id // 21 AS path_id, CAST(pt_id % 21 AS INT) AS idx, x, y, z FROM points"

# -- animation state --------------------------------------------------------

_ENDS = """SELECT obj_id, arg_min(x, frame) AS fx, arg_min(y, frame) AS fy, sqrt((arg_max(x, frame) - arg_min(x, frame))**2
    + (arg_max(y, frame) - arg_min(y, frame))**2) AS displacement FROM keyframes GROUP BY 1"""


@query("animated_filter", sql("keyframes", f"SELECT obj_id, {rs('displacement')}, displacement > 0.4 AS animated FROM ends", ends=_ENDS))
def _(t):
    state = T.animated(t.timed_positions(), 0.4, "at")
    return rxyz(state, "obj_id", "animated", cols=("displacement",))


@query("has_animation", sql("objects", "SELECT obj_id, type FROM objects WHERE obj_id IN (SELECT user_id FROM events)"))
def _(t):
    return T.has_animation(t.objects(), t.keyframes()).select("obj_id", "type")


def subjects(t):
    return t.objects().select("obj_id", F.concat(F.lit("scan_"), F.col("obj_id").cast("string"), F.lit(".glb")).alias("filename"))


_SUBJECTS = "SELECT obj_id, 'scan_' || obj_id || '.glb' AS filename, coalesce(fx, 0) AS fx, coalesce(fy, 0) AS fy, coalesce(displacement > 0.4, false) AS moving FROM objects LEFT JOIN ends USING (obj_id)"


@query("static_orbit_dataset", sql("keyframes objects", f"""
    SELECT obj_id, filename, modality, CAST(i + 1 AS INT) AS frame, {r('cos(2 * pi() * i / 360e0) * 3e0', 'x')}, {r('sin(2 * pi() * i / 360e0) * 3e0', 'y')}, 1.5e0 AS z,
        {r('0 - fx', 'shift_x')}, {r('0 - fy', 'shift_y')} FROM subj, range(360) t(i), (VALUES ('rgb'), ('depth')) m(modality) WHERE NOT moving""",
    ends=_ENDS, subj=_SUBJECTS))
def _(t):
    static, _ = T.split_animated(subjects(t), t.timed_positions(), 0.4, "at")
    jobs = T.static_orbit_jobs(static, places=6, radius=3.0, height=1.5, frame_count=360)
    return jobs.select("obj_id", "filename", "modality", "frame", "x", "y", "z", "shift_x", "shift_y")


@query("animated_skip_log", sql("keyframes objects", "SELECT obj_id, 'Skipping ' || filename || ': Subject is animated.' AS message FROM subj WHERE moving", ends=_ENDS, subj=_SUBJECTS))
def _(t):
    return T.split_animated(subjects(t), t.keyframes(), 0.4)[1]


# -- paths ------------------------------------------------------------------


@query("orbit", sql("points", f"""
    SELECT obj_id, CAST(i + 1 AS INT) AS frame, {r('cx + cos(2 * pi() * i / 360e0) * 5e0', 'x')}, {r('cy + sin(2 * pi() * i / 360e0) * 5e0', 'y')}, {r('cz + 2e0', 'z')}
    FROM (SELECT obj_id, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM points GROUP BY 1), range(360) t(i)"""))
def _(t):
    return rxyz(T.orbit(P.centroid(t.points(), "obj_id")), "obj_id", "frame")


@query("linear_path", sql("points", f"""
    SELECT path_id, frame, {rs('x y z')} FROM (
        SELECT s.path_id, frame, a.x + (b.x - a.x) * u AS x, a.y + (b.y - a.y) * u AS y, a.z + (b.z - a.z) * u AS z,
            row_number() OVER (PARTITION BY s.path_id, frame ORDER BY s.idx DESC) AS k
        FROM (SELECT *, (frame - f0) / greatest(f1 - f0, 1)::DOUBLE AS u FROM seg,
              unnest(range(f0, f1 + 1)) t(frame)) s JOIN wp a USING (path_id, idx) JOIN wp b ON b.path_id = s.path_id AND b.idx = s.idx + 1) WHERE k = 1""",
    wp=WAYPOINTS, seg="""SELECT path_id, idx, CAST(1 + floor(idx * (150e0 / (m - 1))) AS INT) AS f0, CAST(1 + floor((idx + 1) * (150e0 / (m - 1))) AS INT) AS f1
        FROM wp JOIN (SELECT path_id, count(*) AS m FROM wp GROUP BY 1) USING (path_id) WHERE idx < m - 1""").replace("SELECT path_id, frame,", "SELECT path_id, CAST(frame AS INT) AS frame,", 1))
def _(t):
    return rxyz(T.linear_path(waypoints(t)), "path_id", "frame")


@query("path_errors", """SELECT l_orderkey AS path_id, 'Path of fewer than two positions' AS message FROM lineitem GROUP BY 1 HAVING count(*) < 2""")
def _(t):
    return T.path_errors(t.read("lineitem").select(F.col("l_orderkey").alias("path_id")))


@query("curve_errors", """SELECT l_orderkey AS path_id, 'Curve of fewer than two control points' AS message FROM lineitem GROUP BY 1 HAVING count(*) < 2""")
def _(t):
    return T.curve_errors(t.read("lineitem").select(F.col("l_orderkey").alias("path_id")))


RES = 64
_SEGS = """SELECT a.path_id, a.idx, m, """ + ", ".join(
    f"coalesce(o.{c}, a.{c}) AS p0{c}, a.{c} AS p1{c}, b.{c} AS p2{c}, coalesce(d.{c}, b.{c}) AS p3{c}" for c in "xyz"
) + """ FROM wp a JOIN wp b ON b.path_id = a.path_id AND b.idx = a.idx + 1 LEFT JOIN wp o ON o.path_id = a.path_id AND o.idx = a.idx - 1
    LEFT JOIN wp d ON d.path_id = a.path_id AND d.idx = a.idx + 2 JOIN (SELECT path_id, count(*) AS m FROM wp GROUP BY 1) s ON s.path_id = a.path_id"""
_CURVE = f"""SELECT path_id, idx * {RES} + j AS k, """ + ", ".join(
    f"(1-u)*(1-u)*(1-u)*p1{c} + 3*(1-u)*(1-u)*u*(p1{c} + (p2{c}-p0{c})/6) + 3*(1-u)*u*u*(p2{c} - (p3{c}-p1{c})/6) + u*u*u*p2{c} AS {c}" for c in "xyz"
) + f" FROM (SELECT *, j / {RES}e0 AS u FROM segs, range({RES + 1}) t(j) WHERE j < {RES} OR idx = m - 2)"


@query("bezier_path", sql("points", f"SELECT path_id, k, {rs('x y z')} FROM curve", wp=WAYPOINTS, segs=_SEGS, curve=_CURVE))
def _(t):
    return rxyz(T.bezier_path(waypoints(t), RES).withColumn("k", F.col("k").cast("long")), "path_id", "k")


@query("follow_path", sql("points", f"""
    SELECT path_id, CAST(i + 1 AS INT) AS frame, """ + ", ".join(
        r(f"CASE WHEN until > s0 THEN {c} + (n{c} - {c}) * ((i / 149e0 * total - s0) / (until - s0)) ELSE {c} END", c) for c in "xyz") + """
    FROM pieces, range(150) t(i) WHERE (i / 149e0 * total >= s0 AND i / 149e0 * total < until AND i < 149) OR (i = 149 AND k = n - 2)""",
    wp=WAYPOINTS, segs=_SEGS, curve=_CURVE,
    stepped="""SELECT *, coalesce(sqrt((x-px)*(x-px) + (y-py)*(y-py) + (z-pz)*(z-pz)), 0) AS step FROM (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(z) OVER w AS pz
        FROM curve WINDOW w AS (PARTITION BY path_id ORDER BY k))""",
    summed="SELECT *, sum(step) OVER (PARTITION BY path_id ORDER BY k) AS s0, sum(step) OVER (PARTITION BY path_id) AS total, count(*) OVER (PARTITION BY path_id) AS n FROM stepped",
    pieces="SELECT *, lead(s0) OVER w AS until, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lead(z) OVER w AS nz FROM summed WINDOW w AS (PARTITION BY path_id ORDER BY k)"))
def _(t):
    return rxyz(T.follow_bezier(waypoints(t), RES), "path_id", "frame")


@query("frame_timeline", """
    SELECT user_id AS obj_id, CAST(f AS INT) AS frame, round((f - 1) / 30e0, 6) + 0.0 AS seconds FROM (
        SELECT user_id, CASE WHEN user_id % 4 = 0 THEN 150 ELSE count(*) END AS n FROM events GROUP BY 1), unnest(range(1, n + 1)) t(f)""")
def _(t):
    clips = t.keyframes().groupBy("obj_id").agg(F.max("frame").alias("n"))
    clips = clips.select("obj_id", F.when(F.col("obj_id") % 4 != 0, F.col("n")).alias("frame_count"))
    return rxyz(T.frame_timeline(clips), "obj_id", "frame", cols=("seconds",))


# -- cameras ----------------------------------------------------------------


@query("camera_intrinsics", sql("cameras", f"""
    SELECT cam_id, obj_id, coalesce(lens, 50e0) AS focal_length, coalesce(sensor_width, 36e0) AS sensor_width, {r('x', 'pos_x', 4)}, {r('y', 'pos_y', 4)}, {r('z', 'pos_z', 4)},
        {r('rx', 'rot_x', 4)}, {r('ry', 'rot_y', 4)}, {r('rz', 'rot_z', 4)}, 0.1e0 AS clip_start, 1000e0 AS clip_end, 512 AS res_x, 512 AS res_y FROM cameras"""))
def _(t):
    return C.intrinsics(t.cameras())


_AIM = """SELECT cam_id, obj_id, dx, dy, dz FROM (SELECT cam_id, obj_id, (tx-x)/l AS dx, (ty-y)/l AS dy, (tz-z)/l AS dz FROM (
    SELECT *, sqrt((tx-x)*(tx-x) + (ty-y)*(ty-y) + (tz-z)*(tz-z)) AS l FROM cameras
    JOIN (SELECT obj_id, avg(x) AS tx, avg(y) AS ty, avg(z) AS tz FROM points GROUP BY 1) USING (obj_id)))"""


@query("look_at", sql("cameras points", f"""
    SELECT cam_id, obj_id, {rs('dx dy dz')}, {r('atan2(sqrt(dx*dx + dy*dy), -dz)', 'pitch')}, {r('atan2(-dx, dy)', 'yaw')} FROM aim""", aim=_AIM))
def _(t):
    targets = P.centroid(t.points(), "obj_id").select("obj_id", *[F.col(f"c{c}").alias(f"t{c}") for c in "xyz"])
    return rxyz(T.look_at(t.cameras(), targets, spread=("cam_id",)), "cam_id", "obj_id", cols=("dx", "dy", "dz", "pitch", "yaw"))


# spheres of the point sets; cameras that look at an object without points get failure rows
_BOUNDS = "SELECT obj_id, " + ", ".join(f"{f}({c}) AS {f}_{c}" for f in ("min", "max") for c in "xyz") + " FROM points GROUP BY 1"
_SPHERES = """SELECT obj_id, (min_x+max_x)/2 AS cx, (min_y+max_y)/2 AS cy, (min_z+max_z)/2 AS cz,
    sqrt((max_x - (min_x+max_x)/2)**2 + (max_y - (min_y+max_y)/2)**2 + (max_z - (min_z+max_z)/2)**2) AS radius FROM b"""


def spheres(t):
    bounds = M.local_bounds(t.points(), "obj_id")
    return M.bounding_sphere(M.aabb_box(bounds, "obj_id", padding=0.0), "obj_id")


@query("frame_distance", sql("cameras points", f"""
    SELECT cam_id, obj_id, radius IS NOT NULL AS success, CASE WHEN radius IS NULL THEN 'no mesh objects to frame' END AS message, {rs('distance')},
        {r('cx + (x - cx) / l * distance', 'px')}, {r('cy + (y - cy) / l * distance', 'py')}, {r('cz + (z - cz) / l * distance', 'pz')} FROM (
        SELECT *, radius * 1.3e0 / tan(2 * atan(coalesce(sensor_width, 36e0) / (coalesce(lens, 50e0) * 2)) / 2) AS distance,
            sqrt((x-cx)*(x-cx) + (y-cy)*(y-cy) + (z-cz)*(z-cz)) AS l FROM cameras LEFT JOIN sp USING (obj_id))""", b=_BOUNDS, sp=_SPHERES))
def _(t):
    return rxyz(C.frame_objects(t.cameras(), spheres(t)), "cam_id", "obj_id", "success", "message", cols=("distance", "px", "py", "pz"))


# the default camera of every object, framed, with its axes
_EYE = {
    "b": _BOUNDS, "sp": _SPHERES,
    "e1": """SELECT *, radius * 1.4e0 / tan(2 * atan(36e0 / 100e0) / 2) AS dist,
        sqrt((0-cx)*(0-cx) + (-3-cy)*(-3-cy) + (1.5e0-cz)*(1.5e0-cz)) AS l FROM sp""",
    "e2": "SELECT *, cx + (0 - cx) / l * dist AS px, cy + (-3 - cy) / l * dist AS py, cz + (1.5e0 - cz) / l * dist AS pz FROM e1",
    "e3": "SELECT *, sqrt((cx-px)*(cx-px) + (cy-py)*(cy-py) + (cz-pz)*(cz-pz)) AS l2 FROM e2",
    "e4": "SELECT *, (cx-px)/l2 AS fx, (cy-py)/l2 AS fy, (cz-pz)/l2 AS fz FROM e3",
    "e5": "SELECT *, fy / sqrt(fx*fx + fy*fy) AS rx, -fx / sqrt(fx*fx + fy*fy) AS ry, 0e0 AS rz FROM e4",
    "eye": "SELECT obj_id, px, py, pz, fx, fy, fz, rx, ry, rz, ry*fz - rz*fy AS ux, rz*fx - rx*fz AS uy, rx*fy - ry*fx AS uz FROM e5",
}


def basis(t):
    sp = spheres(t)
    return C.view_basis(C.frame_objects(C.default_cameras(sp), sp, 1.4), sp)


_SEEN = """SELECT obj_id, pt_id, (x-px)*fx + (y-py)*fy + (z-pz)*fz AS depth, (x-px)*rx + (y-py)*ry + (z-pz)*rz AS a, (x-px)*ux + (y-py)*uy + (z-pz)*uz AS bb
    FROM points JOIN eye USING (obj_id)"""


@query("view_depth", sql("points", f"SELECT obj_id, pt_id, {rs('depth')}, {r('1 - least(greatest((depth - 0.1e0) / (10e0 - 0.1e0), 0), 1)', 'shade')} FROM seen", **_EYE, seen=_SEEN))
def _(t):
    return rxyz(C.view_depth(t.points(), basis(t), clip_end=10.0), "obj_id", "pt_id", cols=("depth", "shade"))


_RASTER = """SELECT obj_id, col, "row", min(depth) AS depth, arg_min(pt_id, (depth, pt_id)) AS pt_id FROM (
    SELECT obj_id, pt_id, depth, CAST(floor((a / depth * (50e0 / 18e0) + 1) / 2 * 512) AS INT) AS col,
        CAST(floor((1 - bb / depth * (50e0 / 18e0) ) / 2 * 512) AS INT) AS "row" FROM seen WHERE depth > 0.1)
    WHERE col BETWEEN 0 AND 511 AND "row" BETWEEN 0 AND 511 GROUP BY 1, 2, 3"""


@query("depth_raster", sql("points", f"""SELECT obj_id, col, "row", pt_id, {rs('depth')} FROM raster""", **_EYE, seen=_SEEN, raster=_RASTER))
def _(t):
    return rxyz(C.depth_raster(t.points(), basis(t), 512, 512), "obj_id", "col", "row", "pt_id", cols=("depth",))


@query("depth_raster_normalized", sql("points", f"""SELECT obj_id, col, "row", {r('(depth - lo) / (hi - lo)', 'value')} FROM raster
    JOIN (SELECT obj_id, min(depth) AS lo, max(depth) AS hi FROM raster GROUP BY 1) USING (obj_id)""", **_EYE, seen=_SEEN, raster=_RASTER))
def _(t):
    return rxyz(C.normalized_raster(C.depth_raster(t.points(), basis(t), 512, 512)), "obj_id", "col", "row", cols=("value",))


@query("contour_edges", sql("ring vertices", """
    SELECT obj_id, v_lo, v_hi, CASE WHEN count(*) = 1 THEN 'boundary' ELSE 'turn' END AS kind FROM (
        SELECT e.obj_id, face_id, least(a, b) AS v_lo, greatest(a, b) AS v_hi, facing FROM ring e JOIN facing USING (obj_id, face_id) WHERE a <> b)
    GROUP BY 1, 2, 3 HAVING count(*) = 1 OR min(facing) <> max(facing)""", **_EYE, facing="""
    SELECT t.obj_id, t.face_id, CAST((px-i.x)*((j.y-i.y)*(k.z-i.z) - (j.z-i.z)*(k.y-i.y)) + (py-i.y)*((j.z-i.z)*(k.x-i.x) - (j.x-i.x)*(k.z-i.z))
        + (pz-i.z)*((j.x-i.x)*(k.y-i.y) - (j.y-i.y)*(k.x-i.x)) >= 0 AS INT) AS facing
    FROM ring t JOIN ring s ON s.face_id = t.face_id AND s.pos = 0 JOIN eye ON eye.obj_id = t.obj_id
    JOIN vertices i ON i.obj_id = t.obj_id AND i.vert_id = s.a JOIN vertices j ON j.obj_id = t.obj_id AND j.vert_id = t.a
    JOIN vertices k ON k.obj_id = t.obj_id AND k.vert_id = t.b WHERE t.pos = 1"""))
def _(t):
    return C.contour_edges(t.loops(), t.vertices(), basis(t))
