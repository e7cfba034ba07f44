"""Registered queries over work items, run ledgers and dependency tables, with their SQL checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshlark.functions.worker import ship
from meshlark.operators import ledger as L, trees, user_code
from meshlark.plans.common import registrar
from meshlark.plans.oracle_views import sql

ship(__name__)
QUERIES, ORACLES = {}, {}
query = registrar(QUERIES, ORACLES)


# -- fan-out and fan-in -----------------------------------------------------

MODALITIES = ["textured", "normal", "depth", "edge"]


def _child(tag, val, parent=None):
    return F.struct(
        F.concat("id", F.lit("_"), tag).alias("id"),
        (F.lit(None) if parent is None else parent).cast("string").alias("parent_id"),
        val.cast("long").alias("val"),
    )


@query("fan_out", sql("work_items", """
    SELECT id || '_' || tag AS id, CASE WHEN tag = 'edge' THEN 'fixed' ELSE id END AS parent_id, o_custkey AS val
    FROM work_items, (VALUES ('textured'),('normal'),('depth'),('edge')) m(tag)"""))
def _(t):
    items = t.work_items().withColumn("cust", F.coalesce(*[F.col("attributes")[f"k{i}"] for i in range(5)]))
    kids = F.array(*[_child(F.lit(m), F.col("cust"), F.lit("fixed") if m == "edge" else None) for m in MODALITIES])
    return L.fan_out(items, kids)


def _numbered_children(size):
    """``size`` children per item, numbered from 0."""
    steps = F.when(size > 0, F.sequence(F.lit(0).cast("long"), size - 1)).otherwise(F.array().cast("array<long>"))
    return F.transform(steps, lambda i: _child(i.cast("string"), i * 10))


def _plain_items(t):
    return t.read("orders").select(
        F.concat(F.lit("m"), F.col("o_orderkey").cast("string")).alias("id"), F.lit(None).cast("string").alias("parent_id"),
        F.col("o_custkey").alias("val"), F.col("o_orderkey").alias("k"),
    )


@query("fan_out_or_keep", """
    SELECT 'some' AS batch, 'm' || o_orderkey || '_' || j AS id, 'm' || o_orderkey AS parent_id, j*10 AS val
    FROM orders, range(3) r(j) WHERE j < o_orderkey % 4
    UNION ALL SELECT 'none', 'm' || o_orderkey, NULL, o_custkey FROM orders""")
def _(t):
    items = _plain_items(t)
    some = L.fan_out_or_keep(items, _numbered_children(F.col("k") % 4))
    none = L.fan_out_or_keep(items, _numbered_children(F.col("k") * 0))
    batch = lambda df, name: df.select(F.lit(name).alias("batch"), "id", "parent_id", "val")
    return batch(some, "some").unionByName(batch(none, "none"))


def _views(item_id, key):
    """As many views of an item as its key modulo 3, numbered from 0."""
    for k in range(key % 3):
        yield f"{item_id}_view{k}", "first" if k == 0 and key % 5 == 0 else None, 10 * k


@query("fan_out_user", """
    SELECT 'm' || o_orderkey || '_view' || k AS id, CASE WHEN k = 0 AND o_orderkey % 5 = 0 THEN 'first' ELSE 'm' || o_orderkey END AS parent_id,
        10 * k AS val FROM orders, range(3) r(k) WHERE k < o_orderkey % 3""")
def _(t):
    return user_code.fan_out_user(_plain_items(t), _views, "id string, parent_id string, val long", "id", "k")


def _newest(rows):
    """One row of a root's rows: the count and the three newest paths."""
    import pyarrow as pa

    newest = sorted((p for paths in rows.column("newest").to_pylist() for p in paths), reverse=True)[:3]
    return pa.table({"root_id": rows.column("root_id").slice(0, 1), "n_items": [sum(rows.column("n_items").to_pylist())], "newest": [newest]})


@query("fan_in_user", """
    SELECT o_custkey AS root_id, count(*) AS n_items, array_to_string(list(entry ORDER BY entry DESC)[1:3], ',') AS newest
    FROM (SELECT o_custkey, o_orderdate::DATE || '/m' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS entry FROM orders) GROUP BY 1""")
def _(t):
    at = F.concat(F.col("o_orderdate").cast("date").cast("string"), F.lit("/m"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0"))
    items = t.read("orders").select(F.col("o_custkey").alias("root_id"), F.lit(1).cast("long").alias("n_items"), F.array(at).alias("newest"))
    return user_code.fan_in_user(items, "root_id", _newest).withColumn("newest", F.array_join("newest", ","))


@query("fan_in", """
    SELECT o_custkey AS root_id, count(*) AS n_items, round(sum(o_totalprice), 2) AS total,
        min('/out/m' || o_orderkey) AS first_path, max('/out/m' || o_orderkey) AS last_path FROM orders GROUP BY 1""")
def _(t):
    items = t.read("orders").select(
        F.col("o_custkey").alias("root_id"), "o_totalprice", F.concat(F.lit("/out/m"), F.col("o_orderkey").cast("string")).alias("path")
    )
    return L.fan_in(
        items, "root_id", F.count("*").alias("n_items"), F.round(F.sum("o_totalprice"), 2).alias("total"),
        F.min("path").alias("first_path"), F.max("path").alias("last_path"),
    )


@query("fan_in_members", """
    SELECT o_custkey AS root_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS ord,
        '/out/m' || o_orderkey AS path FROM orders""")
def _(t):
    items = t.read("orders").select(
        F.col("o_custkey").alias("root_id"), "o_orderdate", "o_orderkey",
        F.concat(F.lit("/out/m"), F.col("o_orderkey").cast("string")).alias("path"),
    )
    return L.fan_in_members(items, "root_id", ["o_orderdate", "o_orderkey"], "path", [F.col("o_orderdate")])


@query("merge_attributes", """
    SELECT 'm' || o_orderkey AS id, CASE WHEN l.n > 0 THEN 'done' ELSE o_orderstatus END AS status, o_orderpriority AS priority,
        CAST(l.n AS VARCHAR) AS total, CASE WHEN l.n > 0 THEN 3 ELSE 2 END + 1 AS n_keys
    FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey""")
def _(t):
    collected = t.read("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n")).select(
        F.concat(F.lit("m"), F.col("l_orderkey").cast("string")).alias("id"),
        F.create_map(F.lit("status"), F.lit("done"), F.lit("total"), F.col("n").cast("string")).alias("attributes"),
    )
    a = F.col("attributes")
    return L.merge_attributes(t.work_items(), collected).select(
        "id", a["status"].alias("status"), a["priority"].alias("priority"), a["total"].alias("total"), F.size(a).alias("n_keys")
    )


# -- latest state, skipping, retrying ---------------------------------------

_LATEST = """SELECT item_id, step_key, arg_max(seq, (ts, seq)) AS seq, arg_max(success, (ts, seq)) AS success FROM ledger GROUP BY 1, 2"""


@query("ledger_latest", sql("ledger", "SELECT l.item_id, l.step_key, l.seq, l.success, g.duration_s FROM latest l JOIN ledger g USING (seq)",
                            latest=_LATEST))
def _(t):
    return L.ledger_latest(t.ledger()).drop("ts")


def _requests(t):
    seen = t.ledger().select("item_id", "step_key").distinct()
    fresh = seen.select("item_id", F.lit("publish").alias("step_key")).distinct()
    return seen.unionByName(fresh).withColumn("idempotent", F.col("step_key") != "click")


@query("idempotent_skip", sql("ledger", """
    SELECT r.item_id, r.step_key, CASE WHEN l.success AND r.idempotent THEN 'skip' ELSE 'run' END AS action,
        CASE WHEN l.success AND r.idempotent THEN l.seq END AS prev_seq
    FROM requests r LEFT JOIN latest l USING (item_id, step_key)
    UNION ALL SELECT item_id, step_key, 'forced', NULL FROM requests""", latest=_LATEST, requests="""
    SELECT item_id, step_key, step_key <> 'click' AS idempotent FROM
        (SELECT item_id, step_key FROM ledger UNION SELECT item_id, 'publish' FROM ledger)"""))
def _(t):
    requests, ledger = _requests(t), t.ledger()
    row = lambda df, action, seq: df.select("item_id", "step_key", F.lit(action).alias("action"), seq.cast("long").alias("prev_seq"))
    return (
        row(L.idempotent_pending(requests, ledger), "run", F.lit(None))
        .unionByName(row(L.idempotent_replayed(requests, ledger), "skip", F.col("seq")))
        .unionByName(row(L.idempotent_pending(requests, ledger, force=True), "forced", F.lit(None)))
    )


_ATTEMPTS = """SELECT item_id, step_key, success,
    row_number() OVER (PARTITION BY item_id, step_key ORDER BY seq) AS attempt FROM tries"""
# what one attempt of an (item, step) came to: the reading decides, so a step both fails and succeeds
_TRIES = "SELECT item_id, step_key, seq, duration_s > 20 AS success FROM ledger"


@query("retry_outcome", sql("ledger", """
    SELECT item_id, step_key, bool_or(success) AS success, coalesce(min(attempt) FILTER (WHERE success), max(attempt)) AS attempt
    FROM attempts WHERE attempt <= 3 GROUP BY 1, 2""", tries=_TRIES, attempts=_ATTEMPTS))
def _(t):
    return L.retry_outcome(t.ledger().withColumn("success", F.col("duration_s") > 20), 3)


# -- contracts --------------------------------------------------------------

# fixed example contracts over the keys of the work items
STEP_REQUIRES = {
    "ingest": [], "count": ["status", "k0"], "report": ["priority", "k1", "k2"], "publish": ["status", "signature"],
}
_REQ_SQL = """(VALUES ('ingest', []::VARCHAR[]), ('count', ['status','k0']), ('report', ['priority','k1','k2']),
    ('publish', ['status','signature'])) s(step, keys)"""
_MISSING = "list_filter(keys, lambda k: NOT list_contains(map_keys(attributes), k))"
_QUOTED = "'[' || array_to_string(list_transform({}, lambda k: '''' || k || ''''), ', ') || ']'"


@query("requirements_check", sql("work_items", f"""
    SELECT id, step, len({_MISSING}) = 0 AS success,
        CASE WHEN len({_MISSING}) > 0 THEN 'missing requirements: ' || {_QUOTED.format(_MISSING)} END AS message
    FROM work_items, {_REQ_SQL}"""))
def _(t):
    return L.requirements_check(t.work_items(), STEP_REQUIRES)


@query("readiness_report", sql("work_items", f"""
    SELECT id, step, CASE WHEN len({_MISSING}) = 0 THEN 'READY' ELSE 'BLOCKED (missing: ' || {_QUOTED.format(_MISSING)} || ')' END AS status
    FROM work_items, {_REQ_SQL}"""))
def _(t):
    return L.readiness_report(t.work_items(), STEP_REQUIRES)


@query("provides_validation", sql("work_items", f"""
    SELECT id, status AND ok AS success, CASE WHEN NOT status THEN 'failed' WHEN NOT ok THEN
        'validation failed: provides keys ' || {_QUOTED.format("keys")} || ' not all present in context' END AS message
    FROM (SELECT id, attributes['status'] <> 'P' AS status, ['status', 'k' || (o_custkey % 5)] AS keys,
          list_contains(map_keys(attributes), 'k' || (o_custkey % 5)) AS ok FROM work_items)"""))
def _(t):
    cust = F.coalesce(*[F.col("attributes")[f"k{i}"] for i in range(5)]).cast("long")
    runs = t.work_items().select("id", "attributes", (F.col("attributes")["status"] != "P").alias("success"), cust.alias("cust"))
    runs = runs.withColumn("message", F.when(~F.col("success"), "failed"))
    provides = F.array(F.lit("status"), F.concat(F.lit("k"), (F.col("cust") % 5).cast("string")))
    return L.provides_validation(runs, provides, F.col("attributes")).select("id", "success", "message")


@query("external_inputs", sql("steps", """
    SELECT chain, key, 'output' AS role FROM writes
    UNION ALL SELECT chain, key, 'input' FROM (SELECT * FROM reads EXCEPT SELECT * FROM writes) WHERE chain % 50 <> 0
    UNION ALL SELECT DISTINCT chain, 'k0', 'input' FROM steps WHERE chain % 50 = 0""",
    writes="SELECT DISTINCT chain, unnest(writes) AS key FROM steps", reads="SELECT DISTINCT chain, unnest(reads) AS key FROM steps"))
def _(t):
    declared = t.steps().filter(F.col("chain") % 50 == 0).select("chain").distinct().withColumn("key", F.lit("k0"))
    return L.external_inputs(t.steps(), declared)


@query("write_conflicts", sql("steps", """
    SELECT grp, key, min(step) AS first_step, max(step) AS last_step FROM (SELECT grp, step, unnest(writes) AS key FROM steps WHERE parallel)
    GROUP BY 1, 2 HAVING count(DISTINCT step) > 1"""))
def _(t):
    return L.write_conflicts(t.steps())


# -- outcomes ---------------------------------------------------------------

_RAN = """SELECT * FROM (SELECT *, min(CASE WHEN NOT success AND NOT continue_on_error THEN idx END) OVER (PARTITION BY run_id) AS cut
    FROM step_runs) WHERE cut IS NULL OR idx <= cut"""


@query("exit_code", sql("step_runs", """
    SELECT step_key, CASE WHEN success THEN 0 WHEN message LIKE '%missing requirements%' THEN 1 WHEN coalesce(error_type, '') <> '' THEN 2
        WHEN message LIKE '%invalid CompletedState%' THEN 3 ELSE 4 END AS exit_code, count(*) AS n FROM step_runs GROUP BY 1, 2"""))
def _(t):
    code = L.exit_code(F.col("success"), F.col("message"), F.col("error_type"))
    return t.step_runs().groupBy("step_key", code.alias("exit_code")).agg(F.count("*").alias("n"))


@query("first_failure_cut", sql("step_runs", "SELECT run_id, idx, step_key, success FROM ran", ran=_RAN))
def _(t):
    return L.first_failure_cut(t.step_runs()).select("run_id", "idx", "step_key", "success")


@query("fail_fast_batch", sql("step_runs", """
    SELECT run_id, idx, step_key, success FROM runs
    WHERE (idx, run_id) <= (SELECT min((idx, run_id)) FROM runs WHERE NOT success AND NOT continue_on_error)
        OR NOT EXISTS (SELECT 1 FROM runs WHERE NOT success AND NOT continue_on_error)""",
    runs="SELECT run_id, idx, step_key, duration_s < 49.5 OR step_key <> 'step_3' OR run_id % 97 > 0 AS success, continue_on_error FROM step_runs"))
def _(t):
    rare = (F.col("duration_s") < 49.5) | (F.col("step_key") != "step_3") | (F.col("run_id") % 97 > 0)
    return L.fail_fast_batch(t.step_runs().withColumn("success", rare)).select("run_id", "idx", "step_key", "success")


@query("run_rollup", sql("step_runs", """
    SELECT run_id, count(*) AS steps_run, sum(duration_s) AS duration_s, bool_and(cut IS NULL) AS success,
        max(CASE WHEN idx = cut THEN step_key END) AS failed_step FROM ran GROUP BY run_id
    UNION ALL SELECT NULL, count(*), sum(duration_s), bool_and(cut IS NULL), NULL FROM ran""", ran=_RAN))
def _(t):
    return L.run_rollup(L.first_failure_cut(t.step_runs()))


@query("group_failures", sql("step_runs", """
    SELECT run_id, bool_and(success) AS success, count(*) FILTER (WHERE NOT success) AS n_failed, count(*) AS n_members,
        CASE WHEN NOT bool_and(success) THEN 'parallel step(s) failed' END AS message FROM step_runs GROUP BY 1"""))
def _(t):
    return L.group_failures(t.step_runs())


@query("group_failure_details", sql("step_runs", "SELECT run_id, idx, step_key, message, error_type FROM step_runs WHERE NOT success"))
def _(t):
    return L.group_failure_details(t.step_runs())


@query("step_label", sql("step_runs", """
    SELECT run_id, idx, printf('%03d', row_number() OVER (ORDER BY idx, run_id)) || '_' || step_key AS label FROM step_runs"""))
def _(t):
    return L.step_labels(t.step_runs())


# -- ids, signatures, serial form -------------------------------------------


@query("short_signature", """
    SELECT o_orderkey, substr(sha1('{"cust":' || o_custkey || ',"key":"m' || o_orderkey || '","priority":"' || o_orderpriority
        || '","status":"' || o_orderstatus || '"}'), 1, 12) AS signature FROM orders""")
def _(t):
    rows = t.read("orders").select(
        "o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("cust"),
        F.col("o_orderpriority").alias("priority"), F.concat(F.lit("m"), F.col("o_orderkey").cast("string")).alias("key"),
    )
    return rows.select("o_orderkey", L.short_signature(["status", "cust", "priority", "key"]).alias("signature"))


@query("duplicate_reports", sql("loops", """
    SELECT signature, count(*) AS n_items, min(face_id) AS first_item FROM (
        SELECT face_id, substr(sha1('{"hi":' || max(vert_id) || ',"lo":' || min(vert_id) || ',"n":' || count(*) || '}'), 1, 12) AS signature
        FROM loops GROUP BY face_id) GROUP BY 1 HAVING count(*) > 1"""))
def _(t):
    reports = t.read("lineitem").groupBy(F.col("l_orderkey").alias("face_id")).agg(
        F.count("*").alias("n"), F.min("l_suppkey").alias("lo"), F.max("l_suppkey").alias("hi")
    )
    return L.duplicate_reports(reports, "face_id", ["n", "lo", "hi"])


@query("serialisable_check", """
    SELECT event_id, body FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN substr(props, 1, 4) ELSE props END AS body FROM events)
    WHERE NOT json_valid(body)""")
def _(t):
    body = F.when(F.col("event_id") % 5 == 0, F.substring("props", 1, 4)).otherwise(F.col("props"))
    return L.not_serialisable(t.read("events").select("event_id", body.alias("body")), "body")


@query("item_id", "SELECT o_orderkey, 'm_' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8) AS item_id FROM orders")
def _(t):
    return t.read("orders").select("o_orderkey", L.item_id(F.col("o_orderkey"), "m").alias("item_id"))


@query("workitem_json", sql("work_items", """
    SELECT id, attributes['status'] AS status, attributes['priority'] AS priority, input_file, '/out/' || id || '/report.json' AS output_file,
        parent_id, 'orders' AS origin, 3 AS n_keys FROM work_items"""))
def _(t):
    back = L.item_from_json(L.item_to_json(t.work_items()))
    return back.select(
        "id", F.col("attributes")["status"].alias("status"), F.col("attributes")["priority"].alias("priority"),
        F.col("input_files")[0].alias("input_file"), F.col("output_files")[0].alias("output_file"), "parent_id",
        F.col("meta")["origin"].alias("origin"), F.size("attributes").alias("n_keys"),
    )


# -- trees ------------------------------------------------------------------

_WALK = """SELECT node_id, node_id AS root, CAST(0 AS BIGINT) AS depth, name AS path, CAST(node_id AS VARCHAR) AS chain, tx FROM nodes WHERE parent_id IS NULL
    UNION ALL SELECT n.node_id, w.root, w.depth + 1, w.path || '.' || n.name, w.chain || '>' || n.node_id, w.tx + n.tx
    FROM nodes n JOIN walk w ON n.parent_id = w.node_id"""


@query("step_path", sql("nodes", "SELECT node_id, root, depth, path FROM walk", walk=_WALK))
def _(t):
    return trees.root_path(t.nodes())


@query("lineage", sql("nodes", "SELECT node_id, root, depth, chain FROM walk", walk=_WALK))
def _(t):
    return trees.lineage(t.nodes(), "node_id", "parent_id")


@query("world_transform", sql("nodes", "SELECT node_id, root, depth, round(tx, 6) + 0.0 AS tx FROM walk", walk=_WALK))
def _(t):
    return trees.world_offset(t.nodes()).withColumn("tx", F.round("tx", 6) + 0.0)


@query("world_matrix", sql("nodes", """
    SELECT node_id, root, depth, round(cos(a), 6) + 0.0 AS m00, round(sin(a), 6) + 0.0 AS m10, round(x, 6) + 0.0 AS m03, round(y, 6) + 0.0 AS m13, round(z, 6) + 0.0 AS m23 FROM turned""",
    turned="""
    SELECT node_id, node_id AS root, 0::BIGINT AS depth, tx / 4e0 AS a, tx AS x, 1e0 AS y, CAST(node_id % 5 AS DOUBLE) AS z FROM nodes WHERE parent_id IS NULL
    UNION ALL
    SELECT n.node_id, w.root, w.depth + 1, w.a + n.tx / 4e0, w.x + cos(w.a) * n.tx - sin(w.a) * 1e0, w.y + sin(w.a) * n.tx + cos(w.a) * 1e0, w.z + n.node_id % 5
    FROM nodes n JOIN turned w ON n.parent_id = w.node_id"""))
def _(t):
    turn, zero, one = F.col("tx") / 4, F.lit(0.0), F.lit(1.0)
    local = F.array(F.cos(turn), -F.sin(turn), zero, F.col("tx"), F.sin(turn), F.cos(turn), zero, one,
                    zero, zero, one, (F.col("node_id") % 5).cast("double"), zero, zero, zero, one)
    m = F.col("matrix")
    at = {"m00": 0, "m10": 4, "m03": 3, "m13": 7, "m23": 11}
    return trees.world_matrix(t.nodes().withColumn("matrix", local)).select(
        "node_id", "root", "depth", *[(F.round(m[k], 6) + 0.0).alias(n) for n, k in at.items()])


_EDGES = """SELECT CAST(floor((p_partkey - 1) / 4.0) AS BIGINT) AS src, p_partkey AS dst FROM part WHERE p_partkey > 0
    UNION SELECT CAST(floor(p_partkey / 7.0) AS BIGINT), p_partkey FROM part WHERE p_partkey > 0
    UNION SELECT p_partkey, p_partkey - 1 FROM part WHERE p_partkey % 400 = 399
    UNION SELECT p_partkey - 1, p_partkey FROM part WHERE p_partkey % 400 = 399"""


@query("dependency_levels", sql("", """
    SELECT node, CASE WHEN max(d) < 60 THEN max(d) END AS level FROM reach GROUP BY node""", edges=_EDGES, reach="""
    SELECT src AS node, 0 AS d FROM (SELECT src FROM edges UNION SELECT dst FROM edges)
    UNION SELECT e.dst, r.d + 1 FROM reach r JOIN edges e ON e.src = r.node WHERE r.d < 60"""))
def _(t):
    key = F.col("p_partkey")
    part = t.read("part").select("p_partkey")
    edge = lambda src, dst, keep: part.filter(keep).select(src.cast("long").alias("src"), dst.cast("long").alias("dst"))
    loop = key % 400 == 399
    edges = (
        edge(F.floor((key - 1) / 4.0), key, key > 0)
        .union(edge(F.floor(key / 7.0), key, key > 0))
        .union(edge(key, key - 1, loop))
        .union(edge(key - 1, key, loop))
    )
    return trees.dependency_levels(edges)
