"""The views of ``sources.tables`` as DuckDB SQL, for the side-by-side checks."""

from __future__ import annotations

_LINE_ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate"

VIEWS: dict[str, str] = {
    "points": """SELECT vec_id*21+k AS pt_id, label AS obj_id, CAST(embedding[3*k+1] AS DOUBLE) AS x,
        CAST(embedding[3*k+2] AS DOUBLE) AS y, CAST(embedding[3*k+3] AS DOUBLE) AS z FROM embeddings, range(21) t(k)""",
    "tris": """SELECT CAST(floor(a.pt_id/3.0) AS BIGINT) AS tri_id, a.obj_id, a.x AS ax, a.y AS ay, a.z AS az,
        b.x AS bx, b.y AS by_, b.z AS bz, c.x AS cx, c.y AS cy, c.z AS cz
        FROM points a JOIN points b ON b.pt_id = a.pt_id+1 JOIN points c ON c.pt_id = a.pt_id+2 WHERE a.pt_id % 3 = 0""",
    "loops": f"""SELECT l_orderkey % 10 AS obj_id, l_orderkey AS face_id, l_suppkey AS vert_id,
        CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LINE_ORDER}) - 1 AS INT) AS pos,
        CAST(count(*) OVER (PARTITION BY l_orderkey) AS INT) AS n FROM lineitem""",
    "ring": """SELECT obj_id, face_id, vert_id AS a, pos, n,
        coalesce(lead(vert_id) OVER (PARTITION BY face_id ORDER BY pos), first_value(vert_id) OVER (PARTITION BY face_id ORDER BY pos)) AS b
        FROM loops WHERE n >= 3""",
    "face_edges": "SELECT obj_id, face_id, least(a,b) AS v_lo, greatest(a,b) AS v_hi FROM ring WHERE a <> b",
    "vertices": """SELECT obj_id, vert_id, x, y, z FROM (SELECT DISTINCT obj_id, vert_id FROM loops) v
        JOIN (SELECT pt_id, x, y, z FROM points) p ON p.pt_id = (v.vert_id * 10 + v.obj_id) % (SELECT count(*) * 21 FROM embeddings)""",
    "objects": """SELECT p_partkey AS obj_id, CASE WHEN p_partkey % 10 = 0 THEN 'CAMERA' ELSE 'MESH' END AS type, p_brand AS material,
        CAST(CASE WHEN p_size % 7 = 0 THEN -1 ELSE 1 END AS DOUBLE) AS scale_x, CAST(p_size % 3 AS DOUBLE) AS rot_z,
        CAST(CASE WHEN p_partkey % 5 = 0 THEN 2 ELSE p_partkey % 2 END AS INT) AS users, CAST(p_size % 4 AS INT) AS n_modifiers,
        CAST(p_size AS DOUBLE) / 8.0 AS loc_x, CAST(p_partkey % 16 AS DOUBLE) / -4.0 AS loc_y, CAST(1.0 AS DOUBLE) AS loc_z FROM part""",
    "nodes": """SELECT p_partkey AS node_id, CASE WHEN p_partkey = 0 THEN NULL ELSE CAST(floor((p_partkey - 1) / 4.0) AS BIGINT) END AS parent_id,
        p_name AS name, CAST(p_size AS DOUBLE) / 10.0 AS tx FROM part""",
    "ledger": """SELECT event_id AS seq, user_id AS item_id, event_type AS step_key, (event_type <> 'error') AS success,
        value AS duration_s, ts FROM events""",
    "step_runs": f"""SELECT l_orderkey AS run_id,
        CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LINE_ORDER}, l_discount, l_tax) AS INT) AS idx,
        'step_' || (l_partkey % 7) AS step_key, l_tax > 0.015 AS success, l_discount > 0.045 AS continue_on_error, l_quantity AS duration_s,
        CASE WHEN l_tax > 0.015 THEN NULL WHEN l_suppkey % 4 = 0 THEN 'missing requirements: [''mesh'']'
             WHEN l_suppkey % 4 = 1 THEN 'division by zero' WHEN l_suppkey % 4 = 2 THEN 'invalid CompletedState'
             ELSE 'validation failed' END AS message,
        CASE WHEN NOT (l_tax > 0.015) AND l_suppkey % 4 = 1 THEN 'ZeroDivisionError' END AS error_type FROM lineitem""",
    "steps": """SELECT l_orderkey AS chain, 's' || l_partkey || '_' || l_suppkey AS step, l_orderkey % 1000 AS grp, l_orderkey % 2 = 0 AS parallel,
        ['k' || (l_partkey % 17), 'k' || (l_suppkey % 13)] AS reads, ['k' || (l_linenumber % 11), 'w' || (l_partkey % 400)] AS writes FROM lineitem""",
    "keyframes": """SELECT user_id AS obj_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS frame,
        value / 100.0 AS x, CAST(event_id % 100 AS DOUBLE) / 100.0 AS y, CAST(0.0 AS DOUBLE) AS z FROM events""",
    "assets": """SELECT page_id AS asset_id, '/data/d' || (page_id % 8) || '/m' || regexp_extract(url, '/([0-9]+)', 1)
        || (['.glb','.gltf','.obj','.fbx','.stl','.blend','.GLB','.txt',''])[page_id % 9 + 1] AS path,
        CAST(length(html) AS BIGINT) AS length, page_id % 13 <> 0 AS present FROM pages""",
    "cameras": """SELECT c_custkey AS cam_id, CAST(c_custkey % 12 AS INT) AS obj_id,
        CASE WHEN c_custkey % 4 <> 0 THEN CAST(c_nationkey AS DOUBLE) + 20.0 END AS lens,
        CASE WHEN c_custkey % 3 <> 0 THEN CAST(36.0 AS DOUBLE) END AS sensor_width,
        c_acctbal / 700.0 AS x, CAST(c_nationkey AS DOUBLE) / 7.0 AS y, CAST(c_custkey % 17 AS DOUBLE) / 3.0 AS z,
        CAST(c_nationkey AS DOUBLE) / 9.0 AS rx, CAST(0.0 AS DOUBLE) AS ry, CAST(c_custkey % 7 AS DOUBLE) / 11.0 AS rz FROM customer""",
    "work_items": """SELECT 'm' || o_orderkey AS id, o_orderkey, o_custkey,
        MAP {'status': o_orderstatus, 'priority': o_orderpriority, 'k' || (o_orderkey % 5): CAST(o_custkey AS VARCHAR)} AS attributes,
        '/in/m' || o_orderkey || '.glb' AS input_file,
        CASE WHEN o_orderkey % 3 = 0 THEN 'c' || o_custkey END AS parent_id FROM orders""",
}

_NEEDS = {
    "tris": ["points"], "ring": ["loops"], "face_edges": ["ring"], "vertices": ["loops", "points"],
}


def _ordered(names: list[str]) -> list[str]:
    out: list[str] = []

    def visit(name: str) -> None:
        for need in _NEEDS.get(name, []):
            visit(need)
        if name not in out:
            out.append(name)

    for name in names:
        visit(name)
    return out


def sql(views: str, body: str, **ctes: str) -> str:
    """``body`` with the named views (space separated) and extra CTEs in front."""
    parts = [f"{v} AS ({VIEWS[v]})" for v in _ordered(views.split())]
    parts += [f"{name} AS ({text})" for name, text in ctes.items()]
    return ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + body


def noise(seed: int, *parts: str) -> str:
    """Uniform [0, 1) draw, equal to ``functions.noise.uniform``."""
    key = " || ':' || ".join([f"'{seed}'", *[f"CAST({p} AS VARCHAR)" for p in parts]])
    return f"(('0x' || substr(md5({key}),1,8))::BIGINT / 4294967296.0)"


def r(expr: str, name: str, places: int = 6) -> str:
    return f"round({expr}, {places}) + 0.0 AS {name}"
