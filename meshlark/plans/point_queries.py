"""Registered point-set queries with their SQL checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshlark.functions.vector import rounded
from meshlark.operators import columns, mesh as M, points as P, spatial as S
from meshlark.plans import candidates as C
from meshlark.plans.common import registrar
from meshlark.plans.mesh_queries import CROSS, rs, rxyz
from meshlark.plans.oracle_views import noise, r, sql

QUERIES, ORACLES = {}, {}
query = registrar(QUERIES, ORACLES)

SEED = 42
JITTER = 0.1
THIN = 0.08

# -- SQL pieces -------------------------------------------------------------

BOUNDS = "SELECT obj_id, " + ", ".join(f"{f}({c}) AS {f}_{c}" for f in ("min", "max") for c in "xyz") + " FROM points GROUP BY 1"
TRI_BOUNDS = """SELECT obj_id, """ + ", ".join(
    f"{f}({g}({a}, {b}, {c})) AS {f}_{n}" for f, g in (("min", "least"), ("max", "greatest"))
    for n, (a, b, c) in (("x", ("ax", "bx", "cx")), ("y", ("ay", "by_", "cy")), ("z", ("az", "bz", "cz")))
) + " FROM tris GROUP BY 1"
DIAG = "sqrt((max_x-min_x)*(max_x-min_x) + (max_y-min_y)*(max_y-min_y) + (max_z-min_z)*(max_z-min_z))"
JITTERED = "SELECT obj_id, pt_id, " + ", ".join(f"{c} + ({noise(SEED, repr(c), 'pt_id')} * 2.0 - 1.0) * 0.1 AS {c}" for c in "xyz") + " FROM points"


def _last(c: str) -> str:
    return f"CAST(floor((max_{c} - min_{c}) / spacing) AS BIGINT)"


def lattice(bounds: str, inclusive: bool) -> str:
    keep = "" if inclusive else "WHERE " + " AND ".join(f"{c} > min_{c} AND {c} < max_{c}" for c in "xyz")
    return f"""SELECT obj_id, (ix * ({_last('y')} + 1) + iy) * ({_last('z')} + 1) + iz AS pt_id, ix, iy, iz, x, y, z, spacing FROM (
        SELECT *, min_x + ix * spacing AS x, min_y + iy * spacing AS y, min_z + iz * spacing AS z FROM {bounds},
        unnest(range(0, {_last('x')} + 1)) a(ix), unnest(range(0, {_last('y')} + 1)) b(iy), unnest(range(0, {_last('z')} + 1)) c(iz)) {keep}"""


def counted(heights: str) -> str:
    """How many of a sorted list of heights lie more than 1e-4 above the last one counted."""
    return (f"coalesce(list_reduce(list_transform({heights}, lambda h: {{'l': h, 'n': 1}}), "
            "lambda a, b: CASE WHEN b.l - a.l > 1e-4 THEN {'l': b.l, 'n': a.n + 1} ELSE a END).n, 0)")


def hits_above(points: str, tris: str = "tris") -> str:
    """Surfaces straight above each point by brute force: hits more than 1e-4 above the last one counted."""
    return f"""SELECT obj_id, pt_id, CAST({counted("list(hz ORDER BY hz)")} AS BIGINT) AS hits FROM (
            SELECT obj_id, pt_id, z, az + (bz-az)*v + (cz-az)*w AS hz FROM (
                SELECT *, ((x-ax)*(cy-ay) - (y-ay)*(cx-ax)) / nullif((bx-ax)*(cy-ay) - (by_-ay)*(cx-ax), 0) AS v,
                    ((bx-ax)*(y-ay) - (by_-ay)*(x-ax)) / nullif((bx-ax)*(cy-ay) - (by_-ay)*(cx-ax), 0) AS w
                FROM {points} JOIN {tris} USING (obj_id)) WHERE v >= 0 AND w >= 0 AND v + w <= 1) WHERE hz > z GROUP BY 1, 2"""


def nearest(points: str, tris: str = "tris", by_plane: bool = False) -> dict[str, str]:
    """CTEs ending in ``sd``: every point of ``points`` with its nearest triangle by brute force.

    The sign of sdf is that of the parity of surfaces above, or, ``by_plane``, the side of the triangle's plane.
    """
    inside = "NOT s.side" if by_plane else "coalesce(hits, 0) % 2 = 1"
    return {
        "above": hits_above(points, tris),
        "pr": f"""SELECT q.obj_id, pt_id, x, y, z, tri_id, ax, ay, az, bx, by_, bz, cx, cy, cz, bx-ax AS abx, by_-ay AS aby, bz-az AS abz,
            cx-ax AS acx, cy-ay AS acy, cz-az AS acz FROM {points} q JOIN {tris} USING (obj_id)""",
        "p1": "SELECT *, " + ", ".join(
            " + ".join(f"ab{c} * ({c} - {v[c]})" for c in "xyz") + f" AS d{i}, " + " + ".join(f"ac{c} * ({c} - {v[c]})" for c in "xyz") + f" AS d{i + 1}"
            for v, i in ((dict(x="ax", y="ay", z="az"), 1), (dict(x="bx", y="by_", z="bz"), 3), (dict(x="cx", y="cy", z="cz"), 5))
        ) + " FROM pr",
        "p2": "SELECT *, d3*d6 - d5*d4 AS va, d5*d2 - d1*d6 AS vb, d1*d4 - d3*d2 AS vc FROM p1",
        "p3": """SELECT *,
            CASE WHEN d1 <= 0 AND d2 <= 0 THEN 0e0 WHEN d3 >= 0 AND d4 <= d3 THEN 1e0 WHEN vc <= 0 AND d1 >= 0 AND d3 <= 0 THEN coalesce(d1 / nullif(d1 - d3, 0), 0)
                WHEN d6 >= 0 AND d5 <= d6 THEN 0e0 WHEN vb <= 0 AND d2 >= 0 AND d6 <= 0 THEN 0e0
                WHEN va <= 0 AND d4 - d3 >= 0 AND d5 - d6 >= 0 THEN 1e0 - coalesce((d4 - d3) / nullif((d4 - d3) + (d5 - d6), 0), 0)
                ELSE coalesce(vb / nullif(va + vb + vc, 0), 0) END AS v,
            CASE WHEN d1 <= 0 AND d2 <= 0 THEN 0e0 WHEN d3 >= 0 AND d4 <= d3 THEN 0e0 WHEN vc <= 0 AND d1 >= 0 AND d3 <= 0 THEN 0e0
                WHEN d6 >= 0 AND d5 <= d6 THEN 1e0 WHEN vb <= 0 AND d2 >= 0 AND d6 <= 0 THEN coalesce(d2 / nullif(d2 - d6, 0), 0)
                WHEN va <= 0 AND d4 - d3 >= 0 AND d5 - d6 >= 0 THEN coalesce((d4 - d3) / nullif((d4 - d3) + (d5 - d6), 0), 0)
                ELSE coalesce(vc / nullif(va + vb + vc, 0), 0) END AS w FROM p2""",
        "p4": "SELECT *, ax + abx*v + acx*w AS sx, ay + aby*v + acy*w AS sy, az + abz*v + acz*w AS sz FROM p3",
        "p5": """SELECT obj_id, pt_id, x, y, z, tri_id, sx, sy, sz, (x-sx)*(x-sx) + (y-sy)*(y-sy) + (z-sz)*(z-sz) AS d2,
            (x-sx)*(aby*acz - abz*acy) + (y-sy)*(abz*acx - abx*acz) + (z-sz)*(abx*acy - aby*acx) > 0 AS side FROM p4""",
        "p6": "SELECT obj_id, pt_id, x, y, z, arg_min({'tri': tri_id, 'd2': d2, 'side': side}, (d2, tri_id)) AS s FROM p5 GROUP BY 1, 2, 3, 4, 5",
        "sd": f"""SELECT obj_id, pt_id, x, y, z, s.tri AS tri_id, sqrt(s.d2) AS dist, CASE WHEN {inside} THEN -sqrt(s.d2) ELSE sqrt(s.d2) END AS sdf
            FROM p6 LEFT JOIN above USING (obj_id, pt_id)""",
    }


def jittered(t):
    return P.perturb(t.points(), JITTER, SEED)


# -- lattices and jitter ----------------------------------------------------

_SCALED = "SELECT obj_id, " + ", ".join(f"{f}_{c} * 100 AS {f}_{c}" for f in ("min", "max") for c in "xyz") + " FROM raw"


def scaled_bounds(t):
    return M.local_bounds(t.points().withColumns({c: F.col(c) * 100 for c in "xyz"}), "obj_id")


@query("grid_scatter", sql("points", f"SELECT obj_id, pt_id, {rs('x y z')} FROM lat", raw=BOUNDS, b=_SCALED, s="""
    SELECT *, greatest(least(max_x-min_x, max_y-min_y, max_z-min_z) / 2.0 * (0.05e0 + 0.2e0 * 0.5e0), 1e0) AS spacing FROM b""", lat=lattice("s", True)))
def _(t):
    bounds = P.estimated_max_sdf(scaled_bounds(t))
    return rxyz(P.grid_scatter(bounds, F.col("max_sdf")), "obj_id", "pt_id")


def interior(divisions: float) -> dict[str, str]:
    """CTEs ending in ``pt``: the lattice points inside, by the crossings of each column (needs ``b``)."""
    span = lambda c, b: f"unnest(range(CAST(floor((least(a{c}, {b}, c{c}) - min_{c}) / spacing) AS BIGINT) - 1, CAST(floor((greatest(a{c}, {b}, c{c}) - min_{c}) / spacing) AS BIGINT) + 2)) r{c}(i{c})"
    return {
        "s": f"SELECT *, {DIAG} / {divisions!r}e0 AS spacing FROM b",
        "over": f"SELECT t.*, ix, iy, min_x + ix * spacing AS x, min_y + iy * spacing AS y FROM tris t JOIN s USING (obj_id), {span('x', 'bx')}, {span('y', 'by_')} "
                "WHERE min_x + ix * spacing > min_x AND min_x + ix * spacing < max_x AND min_y + iy * spacing > min_y AND min_y + iy * spacing < max_y",
        "hz": """SELECT obj_id, ix, iy, list(hz ORDER BY hz) AS hs FROM (SELECT *, az + (bz-az)*v + (cz-az)*w AS hz FROM (
            SELECT *, ((x-ax)*(cy-ay) - (y-ay)*(cx-ax)) / nullif((bx-ax)*(cy-ay) - (by_-ay)*(cx-ax), 0) AS v,
                ((bx-ax)*(y-ay) - (by_-ay)*(x-ax)) / nullif((bx-ax)*(cy-ay) - (by_-ay)*(cx-ax), 0) AS w FROM over)
            WHERE v >= 0 AND w >= 0 AND v + w <= 1) GROUP BY 1, 2, 3""",
        "between": f"""SELECT obj_id, ix, iy, coalesce(hs[i - 1], -1e300) AS lo, hs[i] AS hi FROM hz, unnest(range(1, len(hs) + 1)) r(i)
            WHERE {counted("hs[i:]")} % 2 = 1""",
        "pt": """SELECT obj_id, ix, iy, iz FROM between JOIN s USING (obj_id),
            unnest(range(CAST(floor((greatest(lo, min_z) - min_z) / spacing) AS BIGINT) - 1, CAST(floor((least(hi, max_z) - min_z) / spacing) AS BIGINT) + 2)) z(iz)
            WHERE min_z + iz * spacing >= lo AND min_z + iz * spacing < hi AND min_z + iz * spacing > min_z AND min_z + iz * spacing < max_z""",
    }


@query("grid_scatter_inside", sql("points tris", """
    SELECT obj_id, coalesce(n, 0) AS n_points, coalesce(n, 0) >= 2 AS success,
        CASE WHEN coalesce(n, 0) < 2 THEN 'Only ' || coalesce(n, 0) || ' points inside (need >= 2)' END AS message
    FROM b LEFT JOIN (SELECT obj_id, count(*) AS n FROM pt GROUP BY 1) USING (obj_id)""", b=TRI_BOUNDS, **interior(200)))
def _(t):
    bounds = P.tri_bounds(t.tris())
    return P.scatter_outcome(columns.volume_scatter_inside(t.tris(), bounds), bounds)


@query("volume_scatter_inside", sql("points tris", """
    SELECT obj_id, ix, count(*) AS n_points, CAST(sum(iy) AS BIGINT) AS sum_iy, CAST(sum(iz) AS BIGINT) AS sum_iz FROM pt GROUP BY 1, 2""", b=TRI_BOUNDS, **interior(200)))
def _(t):
    inside = columns.volume_scatter_inside(t.tris(), P.tri_bounds(t.tris()))
    return inside.groupBy("obj_id", "ix").agg(F.count("*").alias("n_points"), F.sum("iy").alias("sum_iy"), F.sum("iz").alias("sum_iz"))


@query("volume_scatter", sql("points", f"SELECT obj_id, pt_id, {rs('x y z')} FROM lat", b=BOUNDS, s=f"SELECT *, {DIAG} / 24e0 AS spacing FROM b", lat=lattice("s", False)))
def _(t):
    return rxyz(P.volume_scatter(M.local_bounds(t.points(), "obj_id"), 24.0), "obj_id", "pt_id")


@query("perturb", sql("points", f"SELECT obj_id, pt_id, {rs('x y z', 9)} FROM q", q=JITTERED))
def _(t):
    return rxyz(jittered(t), "obj_id", "pt_id", places=9)


# -- inside, nearest, distance ----------------------------------------------

_HITS = hits_above("q")


@query("ray_hits", sql("points tris", "SELECT obj_id, pt_id, coalesce(hits, 0) AS hits FROM q LEFT JOIN h USING (obj_id, pt_id)", q=JITTERED, h=_HITS))
def _(t):
    return S.ray_hits(jittered(t), t.tris())


@query("cull_raycast", sql("points tris", f"""
    SELECT obj_id, pt_id, {rs('x y z')} FROM q LEFT JOIN h USING (obj_id, pt_id) WHERE coalesce(hits, 0) % 2 = 0""", q=JITTERED, h=_HITS))
def _(t):
    return rxyz(S.cull_raycast(jittered(t), t.tris()), "obj_id", "pt_id")


@query("cull_normal", sql("points tris", f"SELECT obj_id, pt_id, {rs('x y z')} FROM sd WHERE sdf > 0", q=JITTERED, **nearest("q", by_plane=True)))
def _(t):
    return rxyz(S.cull_normal(jittered(t), t.tris()), "obj_id", "pt_id")


@query("sample_sdf", sql("points tris", f"SELECT obj_id, pt_id, tri_id, {rs('dist sdf', 8)} FROM sd", q=JITTERED, **nearest("q")))
def _(t):
    return rxyz(S.signed_distance(jittered(t), t.tris()), "obj_id", "pt_id", "tri_id", cols=("dist", "sdf"), places=8)


@query("cull_sdf", sql("points tris", f"SELECT obj_id, pt_id, {rs('sdf', 8)} FROM sd WHERE sdf >= 0", q=JITTERED, **nearest("q")))
def _(t):
    return rxyz(P.cull_sdf(S.signed_distance(jittered(t), t.tris())), "obj_id", "pt_id", cols=("sdf",), places=8)


_Q = {c: f"(abs({c} - (min_{c} + max_{c}) / 2) - ((max_{c} - min_{c}) / 2 - {DIAG} / 200e0 * 1.5e0))" for c in "xyz"}
_BOXSDF = (
    "sqrt(" + " + ".join(f"greatest({q}, 0e0) * greatest({q}, 0e0)" for q in _Q.values()) + f") + least(greatest({', '.join(_Q.values())}), 0e0)"
)


@query("sdf_difference", sql("points tris", f"""
    SELECT obj_id, pt_id, {r(f'greatest({_BOXSDF}, -sdf)', 'diff')} FROM sd JOIN b USING (obj_id)""", b=BOUNDS, q=JITTERED, **nearest("q")))
def _(t):
    measured = S.signed_distance(jittered(t), t.tris())
    return rxyz(P.sdf_difference(measured, M.local_bounds(t.points(), "obj_id")), "obj_id", "pt_id", cols=("diff",))


@query("max_sdf_estimate", sql("points", f"SELECT obj_id, {r('least(max_x-min_x, max_y-min_y, max_z-min_z) / 2', 'max_sdf')} FROM b", b=BOUNDS))
def _(t):
    return rxyz(P.estimated_max_sdf(M.local_bounds(t.points(), "obj_id")), "obj_id", cols=("max_sdf",))


# -- voxel fields -----------------------------------------------------------

VOXEL, RADIUS = 0.05, 0.075


def voxel_sql(points: str) -> str:
    span = lambda c: f"unnest(range(CAST(ceil(({c} - 0.125e0) / 0.05e0) AS BIGINT), CAST(floor(({c} + 0.125e0) / 0.05e0) AS BIGINT) + 1)) r{c}(i{c})"
    return f"""SELECT obj_id, ix, iy, iz, min(dist) - 0.075e0 AS sdf FROM (
        SELECT obj_id, ix, iy, iz, sqrt((x-ix*0.05e0)*(x-ix*0.05e0) + (y-iy*0.05e0)*(y-iy*0.05e0) + (z-iz*0.05e0)*(z-iz*0.05e0)) AS dist
        FROM {points}, {span('x')}, {span('y')}, {span('z')}) WHERE dist <= 0.125e0 GROUP BY 1, 2, 3, 4"""


ISO_SQL = """SELECT a.obj_id, axis, a.ix, a.iy, a.iz, CAST(CASE WHEN a.sdf < 0 THEN 1 ELSE -1 END AS INT) AS outward FROM vox a,
    (VALUES ('x', 1, 0, 0), ('y', 0, 1, 0), ('z', 0, 0, 1)) d(axis, dx, dy, dz)
    JOIN vox b ON b.obj_id = a.obj_id AND b.ix = a.ix + dx AND b.iy = a.iy + dy AND b.iz = a.iz + dz WHERE (a.sdf < 0) <> (b.sdf < 0)"""


@query("points_to_sdf", sql("points", f"SELECT obj_id, ix, iy, iz, {r('sdf', 'sdf')} FROM vox", vox=voxel_sql("points")))
def _(t):
    return rxyz(S.points_to_sdf(t.points(), RADIUS, VOXEL), "obj_id", "ix", "iy", "iz", cols=("sdf",))


@query("iso_surface_faces", sql("points", ISO_SQL, vox=voxel_sql("points")))
def _(t):
    return S.iso_surface_faces(S.points_to_sdf(t.points(), RADIUS, VOXEL))


_TRI_SPAN = ", ".join(
    f"unnest(range(CAST(ceil((least(a{c}, {b}, c{c}) - 0.1e0) / 0.1e0) AS BIGINT), CAST(floor((greatest(a{c}, {b}, c{c}) + 0.1e0) / 0.1e0) AS BIGINT) + 1)) r{c}(i{c})"
    for c, b in (("x", "bx"), ("y", "by_"), ("z", "bz"))
)


@query("mesh_to_sdf", sql("tris", f"SELECT obj_id, pt_id[1] AS ix, pt_id[2] AS iy, pt_id[3] AS iz, {r('sdf', 'sdf')} FROM sd WHERE dist <= 0.1e0",
    grid=f"SELECT DISTINCT obj_id, ix, iy, iz FROM tris, {_TRI_SPAN}",
    q="SELECT obj_id, [ix, iy, iz] AS pt_id, ix * 0.1e0 AS x, iy * 0.1e0 AS y, iz * 0.1e0 AS z FROM grid", **nearest("q")))
def _(t):
    return rxyz(S.mesh_to_sdf(t.tris(), 0.1, 0.1), "obj_id", "ix", "iy", "iz", cols=("sdf",))


@query("sample_sdf_field", sql("points", f"""
    SELECT obj_id, pt_id, CASE WHEN count(sdf) = 8 THEN round(sum(w * sdf), 6) + 0.0 END AS sdf FROM asked LEFT JOIN vox USING (obj_id, ix, iy, iz) GROUP BY 1, 2""",
    vox=voxel_sql("points"), q=JITTERED, asked="""
    SELECT obj_id, pt_id, CAST(floor(x / 0.05e0) AS BIGINT) + a AS ix, CAST(floor(y / 0.05e0) AS BIGINT) + b AS iy, CAST(floor(z / 0.05e0) AS BIGINT) + c AS iz,
        (CASE a WHEN 1 THEN x / 0.05e0 - floor(x / 0.05e0) ELSE 1 - (x / 0.05e0 - floor(x / 0.05e0)) END)
        * (CASE b WHEN 1 THEN y / 0.05e0 - floor(y / 0.05e0) ELSE 1 - (y / 0.05e0 - floor(y / 0.05e0)) END)
        * (CASE c WHEN 1 THEN z / 0.05e0 - floor(z / 0.05e0) ELSE 1 - (z / 0.05e0 - floor(z / 0.05e0)) END) AS w
    FROM q, range(2) ra(a), range(2) rb(b), range(2) rc(c)"""))
def _(t):
    return rxyz(S.sample_field(jittered(t), S.points_to_sdf(t.points(), RADIUS, VOXEL), VOXEL), "obj_id", "pt_id", cols=("sdf",))


# -- attributes -------------------------------------------------------------

# a cheap distance: from the origin, less a radius
_ATTR = "SELECT obj_id, pt_id, x, y, z, sqrt(x*x + y*y + z*z) - 0.15e0 AS sdf FROM points"
_NORM = """SELECT *, CASE WHEN top > 0 THEN least(greatest(sdf, 0e0), 1e9) / top ELSE 0e0 END AS norm FROM attr
    CROSS JOIN (SELECT max(least(greatest(sdf, 0e0), 1e9)) AS top FROM attr)"""
_WEIGHT = f"SELECT *, (1e0 - norm) * {noise(SEED, repr('weight'), 'pt_id')} AS weight FROM normed"
_ATTRS = {"attr": _ATTR, "normed": _NORM, "weighted": _WEIGHT}


def attributed(t):
    return t.points().withColumn("sdf", F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")) - 0.15)


def weighted(t):
    return P.random_weight(P.normalize_attr(attributed(t)), SEED)


@query("normalize_attr", sql("points", f"SELECT pt_id, {rs('sdf norm', 8)} FROM normed", **_ATTRS))
def _(t):
    return rxyz(P.normalize_attr(attributed(t)), "pt_id", cols=("sdf", "norm"), places=8)


@query("random_weight", sql("points", f"SELECT pt_id, {rs('weight', 8)} FROM weighted", **_ATTRS))
def _(t):
    return rxyz(weighted(t), "pt_id", cols=("weight",), places=8)


@query("color_ramp", sql("points", f"""SELECT pt_id, {r('greatest((weight - 0.5e0) / 0.5e0, 0e0)', 'r')},
    {r('CASE WHEN weight < 0.5e0 THEN weight / 0.5e0 ELSE 1e0 - (weight - 0.5e0) / 0.5e0 END', 'g')},
    {r('greatest(1e0 - weight / 0.5e0, 0e0)', 'b')}, 1e0 AS a FROM weighted""", **_ATTRS))
def _(t):
    c = P.color_ramp(weighted(t)).select("pt_id", "color.*")
    return rxyz(c, "pt_id", cols=("r", "g", "b", "a"))


@query("cull_weight", sql("points", f"SELECT obj_id, pt_id, {rs('weight', 8)} FROM weighted WHERE weight >= 0.3e0", **_ATTRS))
def _(t):
    return rxyz(P.cull_weight(weighted(t)), "obj_id", "pt_id", cols=("weight",), places=8)


@query("cull_weight_report", sql("points", """
    SELECT obj_id, count(*) AS input_count, count(*) FILTER (WHERE weight >= 0.3e0) AS output_count FROM weighted GROUP BY 1""", **_ATTRS))
def _(t):
    w = weighted(t)
    return P.cull_report(w, P.cull_weight(w))


# -- centroid, order, waypoints ---------------------------------------------

_CENTER = "SELECT obj_id, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM points GROUP BY 1"
_ORDERED = """SELECT *, row_number() OVER (PARTITION BY obj_id ORDER BY angle DESC, pt_id) - 1 AS ord, count(*) OVER (PARTITION BY obj_id) AS n
    FROM (SELECT obj_id, pt_id, x, y, z, atan2(y - cy, x - cx) AS angle FROM points JOIN center USING (obj_id))"""


@query("centroid", sql("points", f"SELECT obj_id, {rs('cx cy cz')} FROM center", center=_CENTER))
def _(t):
    return rxyz(P.centroid(t.points(), "obj_id"), "obj_id", cols=("cx", "cy", "cz"))


@query("order_by_angle", sql("points", f"SELECT obj_id, pt_id, ord, {rs('angle')} FROM o", center=_CENTER, o=_ORDERED))
def _(t):
    return rxyz(P.order_by_angle(t.points()), "obj_id", "pt_id", "ord", cols=("angle",))


@query("pick_waypoints", sql("points", f"""
    SELECT obj_id, i AS idx, pt_id, {rs('x y z')} FROM o, range(5) t(i) WHERE CASE WHEN n <= 5 THEN ord = i ELSE ord = CAST(floor(i * (n / 5e0)) AS BIGINT) END""",
    center=_CENTER, o=_ORDERED))
def _(t):
    return rxyz(P.pick_waypoints(P.order_by_angle(t.points()), 5), "obj_id", "idx", "pt_id")


# -- sampling ---------------------------------------------------------------

_AREAS = "SELECT *, 0.5e0 * sqrt(ux*ux + uy*uy + uz*uz) AS area FROM c WHERE ux*ux + uy*uy + uz*uz > 0"


def folded_xyz(r1: str, r2: str, whole: bool = False) -> str:
    """The point of folded draws on a triangle, rounded unless ``whole``."""
    f1, f2 = (f"(CASE WHEN {r1} + {r2} > 1.0 THEN 1.0 - {x} ELSE {x} END)" for x in (r1, r2))
    sides = {c: f"a{c} + {f1} * ({b} - a{c}) + {f2} * (c{c} - a{c})" for c, b in (("x", "bx"), ("y", "by_"), ("z", "bz"))}
    return ", ".join(f"{e} AS {c}" if whole else r(e, c) for c, e in sides.items())


_CUM = """SELECT *, row_number() OVER w AS rn, sum(area) OVER (PARTITION BY obj_id ORDER BY tri_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    / sum(area) OVER (PARTITION BY obj_id) AS hi, count(*) OVER (PARTITION BY obj_id) AS n FROM areas WINDOW w AS (PARTITION BY obj_id ORDER BY tri_id)"""


@query("area_weighted_sample", sql("points tris", f"""
    SELECT obj_id, draw, tri_id, {folded_xyz('r1', 'r2')} FROM (
        SELECT d.*, f.*, row_number() OVER (PARTITION BY d.obj_id, draw ORDER BY rn) AS first FROM draws d
        JOIN cum f ON f.obj_id = d.obj_id AND (u <= hi OR rn = n)) WHERE first = 1""",
    c=CROSS, areas=_AREAS, cum=_CUM, draws=f"""SELECT obj_id, pt_id AS draw, {noise(SEED, repr('face'), 'obj_id', 'pt_id')} AS u,
        {noise(SEED, repr('r1'), 'obj_id', 'pt_id')} AS r1, {noise(SEED, repr('r2'), 'obj_id', 'pt_id')} AS r2 FROM points"""))
def _(t):
    draws = t.points().select("obj_id", F.col("pt_id").alias("draw"))
    return rxyz(P.area_weighted_sample(t.tris(), draws, SEED), "obj_id", "draw", "tri_id")


def scatter_sql(counted: str) -> str:
    return f"""SELECT obj_id, tri_id, k, {folded_xyz('r1', 'r2')} FROM (
        SELECT *, {noise(SEED, repr('r1'), 'tri_id', 'k')} AS r1, {noise(SEED, repr('r2'), 'tri_id', 'k')} AS r2
        FROM (SELECT *, unnest(range(0, n)) AS k FROM {counted}))"""


@query("face_scatter", sql("tris", scatter_sql("counted"), c=CROSS, areas=_AREAS,
    counted="SELECT *, greatest(1, CAST(ceil(area / (pi() * 0.075e0 * 0.075e0 * 0.7e0)) AS BIGINT)) AS n FROM areas"))
def _(t):
    return rxyz(P.face_scatter(t.tris(), RADIUS, 0.7, SEED), "obj_id", "tri_id", "k")


_FAN = """SELECT b.obj_id, b.face_id, b.pos - 1 AS tri, p.x AS ax, p.y AS ay, p.z AS az, q.x AS bx, q.y AS by_, q.z AS bz, s.x AS cx, s.y AS cy, s.z AS cz
    FROM ring b JOIN loops a ON a.face_id = b.face_id AND a.pos = 0 JOIN vertices p ON p.obj_id = b.obj_id AND p.vert_id = a.vert_id
    JOIN vertices q ON q.obj_id = b.obj_id AND q.vert_id = b.a JOIN vertices s ON s.obj_id = b.obj_id AND s.vert_id = b.b
    WHERE b.pos BETWEEN 1 AND b.n - 2"""


@query("polygon_scatter", sql("ring vertices", f"""
    SELECT obj_id, face_id, k, {folded_xyz('r1', 'r2')} FROM (
        SELECT *, {noise(SEED, repr('r1'), 'face_id', 'k')} AS r1, {noise(SEED, repr('r2'), 'face_id', 'k')} AS r2 FROM picked JOIN fan USING (obj_id, face_id, tri))""",
    fan=_FAN, tris="SELECT * FROM fan", c=CROSS,
    sized="SELECT obj_id, face_id, sum(sqrt(ux*ux + uy*uy + uz*uz) * 0.5e0) AS area, count(*) AS n_tris FROM c GROUP BY 1, 2",
    picked=f"""SELECT obj_id, face_id, k, CAST(floor({noise(SEED, repr('tri'), 'face_id', 'k')} * n_tris) AS INT) AS tri FROM (
        SELECT *, unnest(range(0, greatest(1, CAST(ceil(area / (pi() * 0.2e0 * 0.2e0 * 0.7e0)) AS BIGINT)))) AS k FROM sized WHERE area > 0)"""))
def _(t):
    v = t.vertices()
    fans = M.triangulate(t.loops())
    for name, (x, y, z) in (("v0", ("ax", "ay", "az")), ("v1", ("bx", "by_", "bz")), ("v2", ("cx", "cy", "cz"))):
        fans = fans.join(v.select("obj_id", F.col("vert_id").alias(name), F.col("x").alias(x), F.col("y").alias(y), F.col("z").alias(z)), ["obj_id", name])
    return rxyz(P.polygon_scatter(fans, 0.2, 0.7, SEED), "obj_id", "face_id", "k")


_COUNTED = f"""SELECT *, CAST(floor(area * 40e0) AS BIGINT) + CASE WHEN {noise(SEED, repr('n'), 'tri_id')} < area * 40e0 - floor(area * 40e0) THEN 1 ELSE 0 END AS n FROM areas"""


@query("density_scatter", sql("tris", scatter_sql("counted"), c=CROSS, areas=_AREAS, counted=_COUNTED))
def _(t):
    return rxyz(P.density_scatter(t.tris(), 40.0, SEED), "obj_id", "tri_id", "k")


@query("density_iso_faces", sql("tris", ISO_SQL, c=CROSS, areas=_AREAS, counted=_COUNTED,
    sown=scatter_sql("counted").replace("round(", "(").replace(", 6) + 0.0", ")"), vox=voxel_sql("sown")))
def _(t):
    return S.iso_surface_faces(S.points_to_sdf(P.density_scatter(t.tris(), 40.0, SEED), RADIUS, VOXEL))


# -- neighbours -------------------------------------------------------------


def knn_sql(points: str) -> str:
    return f"""SELECT a.obj_id, a.pt_id, row_number() OVER (PARTITION BY a.pt_id ORDER BY d2, nb_id) AS rank, nb_id, d2, nx, ny, nz FROM (
        SELECT a.obj_id, a.pt_id, b.pt_id AS nb_id, b.x AS nx, b.y AS ny, b.z AS nz,
            (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) AS d2
        FROM {points} a JOIN {points} b ON a.obj_id = b.obj_id AND a.pt_id <> b.pt_id) a QUALIFY rank <= 8"""


def relax_sql(points: str) -> str:
    return f"""SELECT p.obj_id, p.pt_id, """ + ", ".join(f"p.{c} + (m{c} - p.{c}) * 0.3e0 AS {c}" for c in "xyz") + f""" FROM {points} p
        JOIN (SELECT pt_id, avg(nx) AS mx, avg(ny) AS my, avg(nz) AS mz FROM ({knn_sql(points)}) GROUP BY 1) USING (pt_id)"""


@query("knn", sql("points", f"SELECT obj_id, pt_id, CAST(rank AS INT) AS rank, nb_id, {r('d2', 'd2', 9)} FROM ({knn_sql('points')})"))
def _(t):
    return rxyz(S.knn(t.points(), 8), "obj_id", "pt_id", "rank", "nb_id", cols=("d2",), places=9)


@query("lloyd_relax", sql("points", f"SELECT obj_id, pt_id, {rs('x y z')} FROM one", one=relax_sql("points")))
def _(t):
    return rxyz(S.lloyd_relax(t.points(), 1), "obj_id", "pt_id")


@query("lloyd_relax_all", sql("points", f"SELECT obj_id, pt_id, {rs('x y z')} FROM r4",
    r1=relax_sql("points"), r2=relax_sql("r1"), r3=relax_sql("r2"), r4=relax_sql("r3")).replace(" AS (SELECT p.obj_id", " AS MATERIALIZED (SELECT p.obj_id"))
def _(t):
    return rxyz(S.lloyd_relax(t.points(), 4), "obj_id", "pt_id")


@query("min_distance_thin", sql("points", f"""
    SELECT obj_id, k.pt_id AS pt_id, {r('k.x', 'x')}, {r('k.y', 'y')}, {r('k.z', 'z')} FROM (SELECT obj_id, unnest(kept) AS k FROM passed)""", passed=f"""
    SELECT obj_id, list_reduce(list([{{'pt_id': pt_id, 'x': x, 'y': y, 'z': z}}] ORDER BY {noise(SEED, 'pt_id')}, pt_id), lambda kept, q:
        CASE WHEN len(list_filter(kept, lambda k: (q[1].x-k.x)*(q[1].x-k.x) + (q[1].y-k.y)*(q[1].y-k.y) + (q[1].z-k.z)*(q[1].z-k.z)
            < {THIN * THIN!r}e0)) = 0 THEN list_concat(kept, q) ELSE kept END) AS kept FROM points GROUP BY obj_id"""))
def _(t):
    return rxyz(S.min_distance_thin(t.points(), THIN, SEED), "obj_id", "pt_id")


@query("repair_surface")
def _(t):
    return C.repair_surface(t.tris(), RADIUS, VOXEL, seed=SEED)


# -- the whole flow ---------------------------------------------------------

_FLOW = {
    "b": TRI_BOUNDS, "s": f"SELECT *, {DIAG} / 14e0 AS spacing FROM b", "lat": lattice("s", False),
    "q": "SELECT obj_id, pt_id, " + ", ".join(f"{c} + ({noise(SEED, repr(c), 'obj_id', 'pt_id')} * 2.0 - 1.0) * (spacing * 0.4e0) AS {c}" for c in "xyz") + " FROM lat",
    **nearest("q"),
    "outside": "SELECT *, max(least(greatest(sdf, 0e0), 1e9)) OVER (PARTITION BY obj_id) AS top FROM sd WHERE sdf >= 0",
    "wt": f"SELECT *, (1e0 - CASE WHEN top > 0 THEN least(greatest(sdf, 0e0), 1e9) / top ELSE 0e0 END) * {noise(SEED, repr('weight'), 'obj_id', 'pt_id')} AS weight FROM outside",
    "kept": "SELECT * FROM wt WHERE weight >= 0.3e0",
    "mid": "SELECT obj_id, avg(x) AS cx, avg(y) AS cy FROM kept GROUP BY 1",
    "o": """SELECT *, row_number() OVER (PARTITION BY obj_id ORDER BY angle DESC, pt_id) - 1 AS ord, count(*) OVER (PARTITION BY obj_id) AS n
        FROM (SELECT kept.*, atan2(y - cy, x - cx) AS angle FROM kept JOIN mid USING (obj_id))""",
}


@query("camera_candidates", sql("tris", f"""
    SELECT obj_id, pt_id, ord, i AS idx, {rs('x y z sdf weight')} FROM o
    LEFT JOIN range(5) t(i) ON CASE WHEN n <= 5 THEN ord = i ELSE ord = CAST(floor(i * (n / 5e0)) AS BIGINT) END""", **_FLOW))
def _(t):
    flow = C.camera_candidates(t.tris(), 14.0, 0.3, SEED)
    return rxyz(flow, "obj_id", "pt_id", "ord", "idx", cols=("x", "y", "z", "sdf", "weight"))
