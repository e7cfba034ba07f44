"""Mesh analytics over loops(obj_id, face_id, vert_id, pos, n), vertices and objects tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from meshlark.functions import vector as V
from meshlark.functions.skew import piece_of, rank_within, running
from meshlark.functions.vector import rounded

UNIT_TOLERANCE = 0.001  # scale or rotation further than this from identity counts
# corner signs of a box and its six quads as corner numbers, wound outward
BOX_SIGNS = [(-1, -1, -1), (-1, -1, 1), (-1, 1, -1), (-1, 1, 1), (1, -1, -1), (1, -1, 1), (1, 1, -1), (1, 1, 1)]
BOX_QUADS = [(0, 1, 3, 2), (2, 3, 7, 6), (6, 7, 5, 4), (4, 5, 1, 0), (2, 6, 4, 0), (7, 3, 1, 5)]


# -- objects ----------------------------------------------------------------


def mesh_objects(objects: DataFrame, skip_prefix: str | None = None, name: str = "name") -> DataFrame:
    """Objects of type MESH, optionally without those whose name has a prefix."""
    kept = objects.filter(F.col("type") == "MESH")
    return kept.filter(~F.startswith(F.col(name), F.lit(skip_prefix))) if skip_prefix else kept


def new_objects(after: DataFrame, before: DataFrame, key: str = "obj_id") -> DataFrame:
    """Objects there after an import that were not there before."""
    return after.join(before.select(key), key, "left_anti")


def material_names(objects: DataFrame, *by: str) -> DataFrame:
    """Distinct material names, one per row."""
    return objects.filter(F.col("material").isNotNull()).select(*by, "material").distinct()


def scene_audit(objects: DataFrame) -> DataFrame:
    """What a normalisation pass would touch, in one combined aggregate."""
    off = (F.abs(F.col("scale_x") - 1.0) > UNIT_TOLERANCE) | (F.abs("rot_z") > UNIT_TOLERANCE)
    return mesh_objects(objects).agg(
        F.count_if(F.col("users") > 1).alias("multi_user_fixed"),
        F.count_if(off).alias("transforms_applied"),
        F.coalesce(F.sum("n_modifiers"), F.lit(0)).cast("long").alias("modifiers_applied"),
        F.count_if(F.col("scale_x") < 0).alias("normals_fixed"),
        F.count("*").alias("total_mesh_objects"),
    )


def orphan_blocks(blocks: DataFrame, references: DataFrame) -> DataFrame:
    """Data blocks (kind, block_id) without a user, counted by kind."""
    return blocks.join(references, ["kind", "block_id"], "left_anti").groupBy("kind").agg(F.count("*").alias("orphans"))


# -- counts and topology ----------------------------------------------------


def geometry_counts(vertex_ids: DataFrame, faces: DataFrame, key: str = "obj_id") -> DataFrame:
    verts = vertex_ids.groupBy(key).agg(F.count("*").alias("vertices"))
    return verts.join(faces.groupBy(key).agg(F.count("*").alias("faces")), key, "full").select(
        key, F.coalesce("vertices", F.lit(0)).alias("vertices"), F.coalesce("faces", F.lit(0)).alias("faces")
    )


def topology(faces: DataFrame, *by: str) -> DataFrame:
    """Faces by corner count: 3, 4, anything else."""
    n = F.col("n")
    return faces.groupBy(*by).agg(
        F.count_if(n == 3).alias("triangles"), F.count_if(n == 4).alias("quads"), F.count_if(~n.isin(3, 4)).alias("ngons")
    )


# -- bounds -----------------------------------------------------------------


def local_bounds(vertices: DataFrame, *by: str) -> DataFrame:
    return vertices.groupBy(*by).agg(
        *[f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in "xyz"]
    )


def placed(x: Column, y: Column, z: Column) -> V.Vec:
    """Object space to world space for an object row: scale x, turn about z, move."""
    sx = x * F.col("scale_x")
    c, s = F.cos("rot_z"), F.sin("rot_z")
    return c * sx - s * y + F.col("loc_x"), s * sx + c * y + F.col("loc_y"), z + F.col("loc_z")


def world_corners(bounds: DataFrame, objects: DataFrame) -> DataFrame:
    """The eight box corners of every object in world space, one per row (objects only, never vertices)."""
    pick = lambda c, sign: F.when(sign < 0, F.col(f"min_{c}")).otherwise(F.col(f"max_{c}"))
    signs = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip("abc", t)]) for t in BOX_SIGNS])
    x, y, z = placed(pick("x", F.col("s.a")), pick("y", F.col("s.b")), pick("z", F.col("s.c")))
    return (
        bounds.join(objects, "obj_id")
        .withColumn("s", F.explode(signs))
        .select("obj_id", x.alias("x"), y.alias("y"), z.alias("z"))
    )


def world_bbox(corners: DataFrame, *by: str, places: int | None = 4) -> DataFrame:
    """Centre, dimensions, min and max of corner rows; without ``by`` an empty scene gives zeros."""
    box = local_bounds(corners, *by)
    fix = (lambda c: rounded(c, places)) if places is not None else (lambda c: c)
    cols = []
    for c in "xyz":
        lo, hi = F.coalesce(f"min_{c}", F.lit(0.0)), F.coalesce(f"max_{c}", F.lit(0.0))
        cols += [
            fix((lo + hi) / 2).alias(f"center_{c}"), fix(hi - lo).alias(f"dim_{c}"),
            fix(lo).alias(f"min_{c}"), fix(hi).alias(f"max_{c}"),
        ]
    return box.select(*by, *cols)


def scene_bounds(corners: DataFrame) -> DataFrame:
    return world_bbox(corners, places=None)


def bounding_sphere(corners: DataFrame, *by: str) -> DataFrame:
    """Centre (mean of the corners) and radius (farthest corner)."""
    mid = corners.groupBy(*by).agg(*[F.avg(c).alias(f"c{c}") for c in "xyz"])
    d = V.sub(V.vec("x", "y", "z"), V.vec("cx", "cy", "cz"))
    if by:
        joined = corners.join(mid, list(by))
    else:
        joined = corners.withColumn("_mid", mid.select(F.struct("cx", "cy", "cz")).scalar()).select("*", "_mid.*").drop("_mid")
    return joined.groupBy(*by, "cx", "cy", "cz").agg(F.max(V.length(d)).alias("radius"))


def aabb_box(bounds: DataFrame, *by: str, padding: float = 0.01) -> DataFrame:
    """Corners of the padded box of each bounds row, numbered 0-7."""
    signs = F.array(*[F.struct(*[F.lit(float(v)).alias(n) for n, v in zip("abc", t)]) for t in BOX_SIGNS])
    at = lambda c, s: (
        (F.col(f"min_{c}") + F.col(f"max_{c}")) / 2
        + F.col(s) * 0.5 * ((F.col(f"max_{c}") - F.col(f"min_{c}")) * (1.0 + padding))
    )
    return bounds.select("*", F.posexplode(signs).alias("corner", "s")).select(
        *by, "corner", at("x", "s.a").alias("x"), at("y", "s.b").alias("y"), at("z", "s.c").alias("z")
    )


def box_faces(bounds: DataFrame, *by: str) -> DataFrame:
    """The six quads of each box as loops over the corner numbers."""
    quads = F.array(*[F.array(*[F.lit(v) for v in q]) for q in BOX_QUADS])
    return bounds.select(*by, F.posexplode(quads).alias("face_id", "q")).select(
        *by, "face_id", F.posexplode("q").alias("pos", "corner")
    )


# -- rings, edges, boundaries -----------------------------------------------


def rings(loops: DataFrame) -> DataFrame:
    """Each corner with its successor ``b`` round the face and the face's first corner ``v0``.

    The successor is the next corner there is, whatever gaps the positions have. One shuffle on the face, or none
    where the loops have that partitioning already; a face's corners are one face of a mesh file.
    """
    w = Window.partitionBy("face_id").orderBy("pos")
    first = F.first("vert_id").over(w)
    return loops.filter("n >= 3").select("*", F.coalesce(F.lead("vert_id").over(w), first).alias("b"), first.alias("v0"))


def face_edges(loops: DataFrame) -> DataFrame:
    """Undirected ring edges of faces with at least three corners."""
    return rings(loops).filter(F.col("vert_id") != F.col("b")).select(
        "obj_id", "face_id", F.least("vert_id", "b").alias("v_lo"), F.greatest("vert_id", "b").alias("v_hi")
    )


def boundary_edges(edges: DataFrame) -> DataFrame:
    """Edges used once, with the face that uses them; no join back is needed."""
    return (
        edges.groupBy("obj_id", "v_lo", "v_hi")
        .agg(F.count("*").alias("uses"), F.min("face_id").alias("face_id"))
        .filter("uses = 1")
        .drop("uses")
    )


def boundary_faces(loops: DataFrame) -> DataFrame:
    return boundary_edges(face_edges(loops)).select("obj_id", "face_id").distinct()


def compacted(vertex_ids: DataFrame) -> DataFrame:
    """New vertex ids 0.. per object, in id order."""
    return rank_within(vertex_ids, ["obj_id"], ["vert_id"], "rn", pieces=[piece_of("vert_id")]).withColumn("new_id", F.col("rn") - 1).drop("rn")


def renumber(loops: DataFrame, mapping: DataFrame) -> DataFrame:
    """Replace ``vert_id`` by its ``new_id``."""
    m = mapping.select("obj_id", "vert_id", "new_id")
    return loops.join(m, ["obj_id", "vert_id"]).drop("vert_id").withColumnRenamed("new_id", "vert_id")


def single_sided_faces(loops: DataFrame) -> DataFrame:
    """Loops of the faces with a boundary edge, over compacted vertex ids; none gives no rows."""
    kept = loops.join(boundary_faces(loops), ["obj_id", "face_id"], "left_semi")
    return renumber(kept, compacted(kept.select("obj_id", "vert_id").distinct()))


def delete_boundary_faces(loops: DataFrame) -> DataFrame:
    """One pass: loops of the faces without a boundary edge."""
    return loops.join(boundary_faces(loops), ["obj_id", "face_id"], "left_anti")


def delete_matching_faces(loops: DataFrame, vertices: DataFrame, reference: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """Drop faces all of whose corners lie within ``tolerance`` of a reference vertex.

    Cells are as wide as the tolerance, and a reference vertex stands in its own and the 26 around it: what is near
    enough shares a cell, and the distance decides.
    """
    cell = lambda c: F.floor(F.col(c) / tolerance).cast("long")
    ref = reference.select(*[F.col(c).alias(f"r{c}") for c in "xyz"]).distinct()
    for c in "xyz":
        ref = ref.withColumn(f"c{c}", F.explode(F.sequence(cell(f"r{c}") - 1, cell(f"r{c}") + 1)))
    placed = vertices.select("obj_id", "vert_id", *"xyz", *[cell(c).alias(f"c{c}") for c in "xyz"])
    apart = sum(((F.col(c) - F.col(f"r{c}")) * (F.col(c) - F.col(f"r{c}")) for c in "xyz"), F.lit(0.0))
    on_ref = placed.join(ref, ["cx", "cy", "cz"]).filter(apart <= tolerance * tolerance).select("obj_id", "vert_id").distinct()
    hits = loops.join(on_ref.select("obj_id", "vert_id"), ["obj_id", "vert_id"], "left_semi")
    gone = hits.groupBy("obj_id", "face_id").agg(F.count("*").alias("hits"), F.max("n").alias("n")).filter("hits = n")
    return loops.join(gone, ["obj_id", "face_id"], "left_anti")


def deletion_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Faces deleted and remaining per object; a face is counted by its first corner."""
    count = lambda df, name: df.filter("pos = 0").groupBy("obj_id").agg(F.count("*").alias(name))
    left = F.coalesce("remaining", F.lit(0))
    return count(before, "_all").join(count(after, "remaining"), "obj_id", "left").select(
        "obj_id", (F.col("_all") - left).alias("deleted_faces"), left.alias("result_faces")
    )


# -- cleaning and combining -------------------------------------------------


def bad_faces(loops: DataFrame, invalid: bool = False) -> DataFrame:
    """Faces to skip: a later face over the vertex set of an earlier one, or (``invalid``) a repeated vertex.

    Sets are compared by size, range and two 64-bit xor digests built by
    combined aggregates, so no face is gathered in one place.
    """
    v = F.col("vert_id")
    corners = loops.groupBy("obj_id", "face_id", "vert_id").agg(F.count("*").alias("times"))
    sets = corners.groupBy("obj_id", "face_id").agg(
        F.count("*").alias("k"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.max("times").alias("times"),
        F.bit_xor(F.xxhash64(v)).alias("h1"), F.bit_xor(F.xxhash64(v, F.lit("second"))).alias("h2"),
    )
    if invalid:
        broken = sets.filter("times > 1").select("obj_id", "face_id")
        sets = sets.filter("times = 1")
    key = ["obj_id", "k", "lo", "hi", "h1", "h2"]
    first = sets.groupBy(*key).agg(F.min("face_id").alias("first_face"))
    later = sets.join(first, key).filter("face_id > first_face").select("obj_id", "face_id")
    return later.unionByName(broken) if invalid else later


def drop_bad_faces(loops: DataFrame, invalid: bool = False) -> DataFrame:
    return loops.join(bad_faces(loops, invalid), ["obj_id", "face_id"], "left_anti")


def append_mesh(target: DataFrame, n_target: DataFrame, source: DataFrame) -> DataFrame:
    """Append the source's loops to the target's of the same object, past its ``n_vertices``; bad source faces are skipped."""
    offsets = n_target.select("obj_id", F.col("n_vertices").alias("_offset"))
    clean = drop_bad_faces(source, invalid=True)
    moved = clean.join(offsets, ["obj_id"], "left").withColumn(
        "vert_id", F.col("vert_id") + F.coalesce("_offset", F.lit(0))
    )
    return target.withColumn("part", F.lit("target")).unionByName(moved.drop("_offset").withColumn("part", F.lit("source")))


def vertex_offsets(vertex_ids: DataFrame) -> DataFrame:
    """First vertex number of every object in one merged mesh, in object order (object rows only)."""
    sizes = vertex_ids.groupBy("obj_id").agg(F.count("*").alias("n_vertices"))
    return running(sizes, [], ["obj_id"], {"_end": F.col("n_vertices")}, pieces=[piece_of("obj_id")]).select(
        "obj_id", (F.col("_end") - F.col("n_vertices")).alias("offset")
    )


def merged_ids(vertex_ids: DataFrame) -> DataFrame:
    """(obj_id, vert_id, new_id) of the merged mesh."""
    local = compacted(vertex_ids)
    return local.join(vertex_offsets(vertex_ids), ["obj_id"]).select(
        "obj_id", "vert_id", (F.col("new_id") + F.col("offset")).alias("new_id")
    )


def merge_vertices(vertices: DataFrame, objects: DataFrame) -> DataFrame:
    """World-space vertices of the merged mesh."""
    ids = merged_ids(vertices.select("obj_id", "vert_id"))
    return place_vertices(vertices, objects).join(ids, ["obj_id", "vert_id"]).select(F.col("new_id").alias("vert_id"), "x", "y", "z")


# -- transforms -------------------------------------------------------------


def place_vertices(vertices: DataFrame, objects: DataFrame, keep_location: bool = False) -> DataFrame:
    """World-space vertices; ``keep_location`` bakes scale and rotation only."""
    moved = objects.select("obj_id", "scale_x", "rot_z", *[(F.lit(0.0) if keep_location else F.col(c)).alias(c) for c in ("loc_x", "loc_y", "loc_z")])
    x, y, z = placed(*V.vec("x", "y", "z"))
    return vertices.join(moved, ["obj_id"]).select("obj_id", "vert_id", x.alias("x"), y.alias("y"), z.alias("z"))


def flip_negative(loops: DataFrame, objects: DataFrame) -> DataFrame:
    """Reverse the ring of faces whose object has a negative product of its scales (those of the axes it has)."""
    product = reduce(lambda a, b: a * b, [F.col(f"scale_{c}") for c in "xyz" if f"scale_{c}" in objects.columns])
    mirrored = objects.select("obj_id", (product < 0).alias("_neg"))
    return loops.join(mirrored, ["obj_id"]).withColumn(
        "pos", F.when(F.col("_neg"), F.col("n") - 1 - F.col("pos")).otherwise(F.col("pos"))
    ).drop("_neg")


def center_at_origin(vertices: DataFrame, objects: DataFrame, zero_rotation: bool = False) -> DataFrame:
    """Subtract the mean of the object's eight world corners from its world vertices."""
    if zero_rotation:
        objects = objects.withColumn("rot_z", F.lit(0.0))
    mid = world_corners(local_bounds(vertices, "obj_id"), objects).groupBy("obj_id").agg(*[F.avg(c).alias(f"c{c}") for c in "xyz"])
    world = place_vertices(vertices, objects)
    return world.join(mid, ["obj_id"]).select(
        "obj_id", "vert_id", *[(F.col(c) - F.col(f"c{c}")).alias(c) for c in "xyz"]
    )


# -- triangles --------------------------------------------------------------


def triangulate(loops: DataFrame) -> DataFrame:
    """Fan of vertex ids: (v0, v_i, v_i+1) for the inner corners of each ring."""
    return rings(loops).filter("pos BETWEEN 1 AND n - 2").select(
        "obj_id", "face_id", (F.col("pos") - 1).alias("tri"), F.col("v0"), F.col("vert_id").alias("v1"), F.col("b").alias("v2")
    )


def _corners() -> tuple[V.Vec, V.Vec, V.Vec]:
    return V.vec("ax", "ay", "az"), V.vec("bx", "by_", "bz"), V.vec("cx", "cy", "cz")


def tri_cross() -> V.Vec:
    a, b, c = _corners()
    return V.cross(V.sub(b, a), V.sub(c, a))


def face_areas(tris: DataFrame) -> DataFrame:
    """Triangle areas; zero-area ones are dropped."""
    return tris.withColumn("area", V.length(tri_cross()) * 0.5).filter("area > 0")


def face_normals(tris: DataFrame) -> DataFrame:
    """Unit normals; zero for a degenerate triangle."""
    n = tri_cross()
    size = V.length(n)
    unit = [F.when(size > 0, c / size).otherwise(0.0) for c in n]
    return tris.select("*", *[u.alias(f"n{c}") for u, c in zip(unit, "xyz")])
