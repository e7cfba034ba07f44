"""Relational stand-ins for scenes, meshes, points and run logs, built over the given tables.

Each method plans one view; nothing is read until an action runs. Views that
need no shuffle (points, tris, objects, nodes, assets, cameras) are pure
projections of one scan, so column pruning and filters reach the parquet files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from meshlark.functions.skew import rank_within
from meshlark.session import spread

TRIPLES = 21  # xyz triples taken from one vector
# fixed file extensions given to the asset rows in turn
ASSET_EXTENSIONS = [".glb", ".gltf", ".obj", ".fbx", ".stl", ".blend", ".GLB", ".txt", ""]


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir.rstrip("/")
        self._tables: dict[str, DataFrame] = {}

    def read(self, name: str) -> DataFrame:
        """The table; its footers are read once."""
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        return self._tables[name]

    # -- point sets and triangles ------------------------------------------

    def points(self) -> DataFrame:
        """points(pt_id, obj_id, x, y, z)"""
        return (
            self.read("embeddings")
            .select("vec_id", "label", "embedding", F.explode(F.sequence(F.lit(0), F.lit(TRIPLES - 1))).alias("k"))
            .select(
                (F.col("vec_id") * TRIPLES + F.col("k")).alias("pt_id"),
                F.col("label").alias("obj_id"),
                *[F.element_at("embedding", F.col("k") * 3 + (i + 1)).cast("double").alias(c) for i, c in enumerate("xyz")],
            )
        )

    def tris(self) -> DataFrame:
        """tris(tri_id, obj_id, ax..cz): three consecutive points of one vector, so no join is needed."""
        corner = lambda v, i: F.element_at("embedding", F.col("k") * 9 + (3 * v + i + 1)).cast("double")
        names = [["ax", "ay", "az"], ["bx", "by_", "bz"], ["cx", "cy", "cz"]]
        return (
            self.read("embeddings")
            .select("vec_id", "label", "embedding", F.explode(F.sequence(F.lit(0), F.lit(TRIPLES // 3 - 1))).alias("k"))
            .select(
                (F.col("vec_id") * (TRIPLES // 3) + F.col("k")).alias("tri_id"),
                F.col("label").alias("obj_id"),
                *[corner(v, i).alias(names[v][i]) for v in range(3) for i in range(3)],
            )
        )

    # -- meshes ------------------------------------------------------------

    def loops(self, part: Column | None = None) -> DataFrame:
        """loops(obj_id, face_id, vert_id, pos, n): polygon corners in ring order.

        ``part``, made of l_orderkey, is added as ``path``; rows are dealt by it, so that what works within parts does not move them again.
        """
        order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]
        li, keys = self.read("lineitem").select("l_orderkey", *order), ["l_orderkey"]
        if part is not None:
            li, keys = spread(li.withColumn("path", part), "path"), ["path", "l_orderkey"]
        return rank_within(li, keys, order, "rn", size="cnt").select(
            *keys[:-1],
            (F.col("l_orderkey") % 10).alias("obj_id"),
            F.col("l_orderkey").alias("face_id"),
            F.col("l_suppkey").alias("vert_id"),
            (F.col("rn") - 1).cast("int").alias("pos"),
            F.col("cnt").cast("int").alias("n"),
        )

    def faces(self) -> DataFrame:
        """faces(obj_id, face_id, n): loop counts without the ring order, a map-side combined count."""
        return (
            self.read("lineitem")
            .groupBy(F.col("l_orderkey").alias("face_id"))
            .agg(F.count("*").alias("n"))
            .select((F.col("face_id") % 10).alias("obj_id"), "face_id", "n")
        )

    def mesh_vertex_ids(self) -> DataFrame:
        """(obj_id, vert_id) used by any loop; ring order is not needed for it."""
        return self.read("lineitem").select((F.col("l_orderkey") % 10).alias("obj_id"), F.col("l_suppkey").alias("vert_id")).distinct()

    def vertices(self) -> DataFrame:
        """vertices(obj_id, vert_id, x, y, z)"""
        n_points = self.read("embeddings").agg(F.count("*") * TRIPLES).scalar()
        ids = self.mesh_vertex_ids().withColumn("pt_id", (F.col("vert_id") * 10 + F.col("obj_id")) % n_points)
        pts = self.points().select("pt_id", "x", "y", "z")
        return ids.join(pts, "pt_id").select("obj_id", "vert_id", "x", "y", "z")

    def objects(self) -> DataFrame:
        """objects(obj_id, type, material, scale_x, rot_z, users, n_modifiers, loc_x, loc_y, loc_z)"""
        key, size = F.col("p_partkey"), F.col("p_size")
        return self.read("part").select(
            key.alias("obj_id"),
            F.when(key % 10 == 0, "CAMERA").otherwise("MESH").alias("type"),
            F.col("p_brand").alias("material"),
            F.when(size % 7 == 0, -1.0).otherwise(1.0).alias("scale_x"),
            (size % 3).cast("double").alias("rot_z"),
            F.when(key % 5 == 0, 2).otherwise(key % 2).cast("int").alias("users"),
            (size % 4).cast("int").alias("n_modifiers"),
            (size.cast("double") / 8.0).alias("loc_x"),
            ((key % 16).cast("double") / -4.0).alias("loc_y"),
            F.lit(1.0).alias("loc_z"),
        )

    def nodes(self) -> DataFrame:
        """nodes(node_id, parent_id, name, tx): a four-way tree."""
        key = F.col("p_partkey")
        return self.read("part").select(
            key.alias("node_id"),
            F.when(key > 0, F.floor((key - 1) / 4.0).cast("long")).alias("parent_id"),
            F.col("p_name").alias("name"),
            (F.col("p_size").cast("double") / 10.0).alias("tx"),
        )

    # -- runs, animation, files, cameras -----------------------------------

    def ledger(self) -> DataFrame:
        """ledger(seq, item_id, step_key, success, duration_s, ts)"""
        return self.read("events").select(
            F.col("event_id").alias("seq"),
            F.col("user_id").alias("item_id"),
            F.col("event_type").alias("step_key"),
            (F.col("event_type") != "error").alias("success"),
            F.col("value").alias("duration_s"),
            "ts",
        )

    def step_runs(self) -> DataFrame:
        """step_runs(run_id, idx, step_key, success, continue_on_error, duration_s, message, error_type): one row per step of a run.

        Every order is a run and every line of it a step; tax, discount
        and supplier stand for outcome, tolerance and kind of failure.
        """
        order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]
        order += ["l_discount", "l_tax"]
        li = self.read("lineitem").select("l_orderkey", *order)
        ok = F.col("l_tax") > 0.015
        kind = F.col("l_suppkey") % 4
        return rank_within(li, ["l_orderkey"], order, "rn").select(
            F.col("l_orderkey").alias("run_id"),
            F.col("rn").cast("int").alias("idx"),
            F.concat(F.lit("step_"), (F.col("l_partkey") % 7).cast("string")).alias("step_key"),
            ok.alias("success"),
            (F.col("l_discount") > 0.045).alias("continue_on_error"),
            F.col("l_quantity").alias("duration_s"),
            F.when(ok, None)
            .when(kind == 0, "missing requirements: ['mesh']")
            .when(kind == 1, "division by zero")
            .when(kind == 2, "invalid CompletedState")
            .otherwise("validation failed")
            .alias("message"),
            F.when(~ok & (kind == 1), "ZeroDivisionError").alias("error_type"),
        )

    def steps(self) -> DataFrame:
        """steps(chain, step, grp, parallel, reads, writes): contracts of the steps of many processing chains."""
        key = lambda c, m: F.concat(F.lit("k"), (F.col(c) % m).cast("string"))
        return self.read("lineitem").select(
            F.col("l_orderkey").alias("chain"),
            F.concat(F.lit("s"), F.col("l_partkey").cast("string"), F.lit("_"), F.col("l_suppkey").cast("string")).alias("step"),
            (F.col("l_orderkey") % 1000).alias("grp"),
            (F.col("l_orderkey") % 2 == 0).alias("parallel"),
            F.array(key("l_partkey", 17), key("l_suppkey", 13)).alias("reads"),
            F.array(key("l_linenumber", 11), F.concat(F.lit("w"), (F.col("l_partkey") % 400).cast("string"))).alias("writes"),
        )

    def keyframes(self) -> DataFrame:
        """keyframes(obj_id, frame, x, y, z)"""
        ev = self.read("events").select("user_id", "ts", "event_id", "value")
        return rank_within(ev, ["user_id"], ["ts", "event_id"], "rn", pieces=[F.col("ts").cast("date")]).select(
            F.col("user_id").alias("obj_id"),
            F.col("rn").cast("int").alias("frame"),
            (F.col("value") / 100.0).alias("x"),
            ((F.col("event_id") % 100).cast("double") / 100.0).alias("y"),
            F.lit(0.0).alias("z"),
        )

    def timed_positions(self) -> DataFrame:
        """(obj_id, at, x, y, z): the positions of ``keyframes`` by time, not numbered, so without a rank over all of an object's events."""
        return self.read("events").select(
            F.col("user_id").alias("obj_id"), F.struct("ts", "event_id").alias("at"), (F.col("value") / 100.0).alias("x"),
            ((F.col("event_id") % 100).cast("double") / 100.0).alias("y"), F.lit(0.0).alias("z"))

    def assets(self) -> DataFrame:
        return self.assets_of(self.read("pages"))

    @staticmethod
    def assets_of(pages: DataFrame) -> DataFrame:
        """assets(asset_id, path, length, present): files of mixed type under eight folders."""
        ext = F.element_at(F.array(*[F.lit(e) for e in ASSET_EXTENSIONS]), (F.col("page_id") % len(ASSET_EXTENSIONS) + 1).cast("int"))
        return pages.select(
            F.col("page_id").alias("asset_id"),
            F.concat(
                F.lit("/data/d"), (F.col("page_id") % 8).cast("string"), F.lit("/m"),
                F.regexp_extract("url", "/([0-9]+)", 1), ext,
            ).alias("path"),
            F.length("html").cast("long").alias("length"),
            (F.col("page_id") % 13 != 0).alias("present"),
        )

    def cameras(self) -> DataFrame:
        """cameras(cam_id, obj_id, lens, sensor_width, x, y, z, rx, ry, rz): some settings left out."""
        k = F.col("c_custkey")
        return self.read("customer").select(
            k.alias("cam_id"),
            (k % 12).cast("int").alias("obj_id"),
            F.when(k % 4 != 0, F.col("c_nationkey").cast("double") + 20.0).alias("lens"),
            F.when(k % 3 != 0, 36.0).alias("sensor_width"),
            (F.col("c_acctbal") / 700.0).alias("x"),
            (F.col("c_nationkey").cast("double") / 7.0).alias("y"),
            ((k % 17).cast("double") / 3.0).alias("z"),
            (F.col("c_nationkey").cast("double") / 9.0).alias("rx"),
            F.lit(0.0).alias("ry"),
            ((k % 7).cast("double") / 11.0).alias("rz"),
        )

    def work_items(self) -> DataFrame:
        """work_items(id, attributes, input_files, output_files, parent_id, meta)"""
        k = F.col("o_orderkey")
        stem = F.concat(F.lit("m"), k.cast("string"))
        return self.read("orders").select(
            stem.alias("id"),
            F.create_map(
                F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.col("o_orderpriority"),
                F.concat(F.lit("k"), (k % 5).cast("string")), F.col("o_custkey").cast("string"),
            ).alias("attributes"),
            F.array(F.concat(F.lit("/in/"), stem, F.lit(".glb"))).alias("input_files"),
            F.array(F.concat(F.lit("/out/"), stem, F.lit("/report.json"))).alias("output_files"),
            F.when(k % 3 == 0, F.concat(F.lit("c"), F.col("o_custkey").cast("string"))).alias("parent_id"),
            F.create_map(F.lit("origin"), F.lit("orders")).alias("meta"),
        )
