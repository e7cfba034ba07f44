"""Camera tables: settings, framing, depth of points, pixel grids, contour edges, render jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from meshlark.functions import vector as V

from meshlark.functions.vector import rounded
from meshlark.operators.mesh import rings

# fixed defaults
FOCAL, SENSOR, CLIP_START, CLIP_END = 50.0, 36.0, 0.1, 1000.0
START = (0.0, -3.0, 1.5)
FALLBACK_DIRECTION = (0.0, -1.0, 0.5)
NO_MESH = "no mesh objects to frame"
MODALITIES = {"textured": "render_textured", "normal": "render_normal", "depth": "render_depth", "edge": "render_edge"}
RESOLUTION, SAMPLES = 512, 128


def intrinsics(cameras: DataFrame, width: int = RESOLUTION, height: int = RESOLUTION) -> DataFrame:
    """Settings with defaults; position and rotation to 4 places."""
    return cameras.select(
        "cam_id", "obj_id",
        F.coalesce("lens", F.lit(FOCAL)).alias("focal_length"), F.coalesce("sensor_width", F.lit(SENSOR)).alias("sensor_width"),
        *[rounded(c, 4).alias(f"pos_{c}") for c in "xyz"], *[rounded(f"r{c}", 4).alias(f"rot_{c}") for c in "xyz"],
        F.lit(CLIP_START).alias("clip_start"), F.lit(CLIP_END).alias("clip_end"),
        F.lit(width).alias("res_x"), F.lit(height).alias("res_y"),
    )


def frame_objects(cameras: DataFrame, spheres: DataFrame, margin: float = 1.3) -> DataFrame:
    """Move each camera along its line from the sphere's centre until the sphere fits.

    cameras(cam_id, obj_id, lens, sensor_width, x, y, z), spheres(obj_id, cx, cy,
    cz, radius). A camera whose object has no mesh becomes a failure row.
    """
    lens, sensor = F.coalesce("lens", F.lit(FOCAL)), F.coalesce("sensor_width", F.lit(SENSOR))
    tan_half = F.tan(F.lit(2.0) * F.atan(sensor / (lens * 2.0)) / 2.0)
    joined = cameras.join(spheres, ["obj_id"], "left")
    off = {f"o{c}": F.col(c) - F.col(f"c{c}") for c in "xyz"}
    size = V.length(V.vec("ox", "oy", "oz"))
    fallback = sum(v * v for v in FALLBACK_DIRECTION) ** 0.5
    unit = {f"d{c}": F.when(F.col("size") < 0.001, FALLBACK_DIRECTION[i] / fallback).otherwise(F.col(f"o{c}") / F.nullif("size", F.lit(0.0))) for i, c in enumerate("xyz")}
    known = F.col("radius").isNotNull()
    return (
        joined.withColumns(off).withColumn("size", size).withColumns(unit)
        .withColumn("distance", F.col("radius") * margin / tan_half)
        .select(
            "cam_id", "obj_id", known.alias("success"), F.when(~known, NO_MESH).alias("message"), "distance",
            *[(F.col(f"c{c}") + F.col(f"d{c}") * F.col("distance")).alias(f"p{c}") for c in "xyz"],
        )
    )


def default_cameras(spheres: DataFrame) -> DataFrame:
    """One camera per object with the default lens at the default start."""
    return spheres.select(
        F.col("obj_id").alias("cam_id"), "obj_id", F.lit(FOCAL).alias("lens"), F.lit(SENSOR).alias("sensor_width"),
        *[F.lit(v).alias(c) for v, c in zip(START, "xyz")],
    )


def view_basis(framed: DataFrame, spheres: DataFrame) -> DataFrame:
    """(obj_id, px.., f*, r*, u*): position, forward, right and up of a camera looking at the sphere's centre."""
    joined = framed.select("obj_id", "px", "py", "pz").join(spheres.select("obj_id", "cx", "cy", "cz"), "obj_id")
    ahead = {f"a{c}": F.col(f"c{c}") - F.col(f"p{c}") for c in "xyz"}
    f = {f"f{c}": F.col(f"a{c}") / F.col("_l") for c in "xyz"}
    based = joined.withColumns(ahead).withColumn("_l", V.length(V.vec("ax", "ay", "az"))).withColumns(f)
    based = based.withColumn("_h", F.sqrt(F.col("fx") * F.col("fx") + F.col("fy") * F.col("fy")))
    based = based.withColumns({"rx": F.col("fy") / F.col("_h"), "ry": -F.col("fx") / F.col("_h"), "rz": F.lit(0.0)})
    up = V.cross(V.vec("rx", "ry", "rz"), V.vec("fx", "fy", "fz"))
    return based.withColumns(dict(zip(("ux", "uy", "uz"), up))).select("obj_id", *[f"{n}{c}" for n in "pfru" for c in "xyz"])


def _from_eye() -> V.Vec:
    return V.sub(V.vec("x", "y", "z"), V.vec("px", "py", "pz"))


def depth_shade(depth: Column, clip_start: float = CLIP_START, clip_end: float = CLIP_END, near_white: bool = True) -> Column:
    """Linear between the clip distances, clamped; near is 1 unless ``near_white`` is off."""
    t = F.least(F.greatest((depth - clip_start) / (clip_end - clip_start), F.lit(0.0)), F.lit(1.0))
    return 1.0 - t if near_white else t


def view_depth(points: DataFrame, basis: DataFrame, clip_end: float = CLIP_END, near_white: bool = True) -> DataFrame:
    """Distance of each point along its camera's view axis, and its grey value."""
    joined = points.join(basis, ["obj_id"])
    return joined.withColumn("depth", V.dot(_from_eye(), V.vec("fx", "fy", "fz"))).select(
        *points.columns, "depth", depth_shade(F.col("depth"), CLIP_START, clip_end, near_white).alias("shade")
    )


def depth_raster(points: DataFrame, basis: DataFrame, width: int, height: int, lens: float = FOCAL, sensor: float = SENSOR) -> DataFrame:
    """(obj_id, col, row, depth, pt_id): the nearest point in each pixel of each object's camera."""
    joined = points.join(basis, ["obj_id"])
    k = lens / (sensor / 2.0)
    d = _from_eye()
    seen = (
        joined.withColumns({"depth": V.dot(d, V.vec("fx", "fy", "fz")), "a": V.dot(d, V.vec("rx", "ry", "rz")), "b": V.dot(d, V.vec("ux", "uy", "uz"))})
        .select("obj_id", "pt_id", "depth", "a", "b")
        .filter(F.col("depth") > CLIP_START)
        .withColumn("col", F.floor((F.col("a") / F.col("depth") * k + 1.0) / 2.0 * width).cast("int"))
        .withColumn("row", F.floor((1.0 - F.col("b") / F.col("depth") * k * (width / height)) / 2.0 * height).cast("int"))
    )
    inside = (F.col("col") >= 0) & (F.col("col") < width) & (F.col("row") >= 0) & (F.col("row") < height)
    return seen.filter(inside).groupBy("obj_id", "col", "row").agg(F.min(F.struct("depth", "pt_id")).alias("s")).select("obj_id", "col", "row", "s.*")


def normalized_raster(raster: DataFrame) -> DataFrame:
    """Depth to 0..1 between each picture's nearest and farthest pixel."""
    ends = raster.groupBy("obj_id").agg(F.min("depth").alias("_lo"), F.max("depth").alias("_hi"))
    span = F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
    return raster.join(ends, ["obj_id"]).withColumn(
        "value", F.coalesce((F.col("depth") - F.col("_lo")) / span, F.lit(0.0))
    ).drop("_lo", "_hi")


def contour_edges(loops: DataFrame, vertices: DataFrame, basis: DataFrame) -> DataFrame:
    """Edges used by one face, or whose faces look different ways from the camera."""
    ring = rings(loops)
    corner = lambda name, p: vertices.select("obj_id", F.col("vert_id").alias(name), *[F.col(c).alias(f"{p}{c}") for c in "xyz"])
    # the face's side is read off its first two fan edges: corners 0, 1 and 2
    second = ring.filter("pos = 1").select("obj_id", "face_id", "v0", F.col("vert_id").alias("v1"), F.col("b").alias("v2"))
    faces = second.join(corner("v0", "i"), ["obj_id", "v0"]).join(corner("v1", "j"), ["obj_id", "v1"]).join(corner("v2", "k"), ["obj_id", "v2"])
    faces = faces.join(basis.select("obj_id", "px", "py", "pz"), ["obj_id"])
    i, j, k = V.vec("ix", "iy", "iz"), V.vec("jx", "jy", "jz"), V.vec("kx", "ky", "kz")
    toward = V.dot(V.sub(V.vec("px", "py", "pz"), i), V.cross(V.sub(j, i), V.sub(k, i))) >= 0
    facing = faces.select("obj_id", "face_id", toward.cast("int").alias("facing"))
    edges = ring.filter(F.col("vert_id") != F.col("b")).select(
        "obj_id", "face_id", "pos", F.least("vert_id", "b").alias("v_lo"), F.greatest("vert_id", "b").alias("v_hi")
    )
    sided = edges.join(facing, ["obj_id", "face_id"])
    return (
        sided.groupBy("obj_id", "v_lo", "v_hi")
        .agg(F.count("*").alias("uses"), F.min("facing").alias("lo"), F.max("facing").alias("hi"))
        .filter("uses = 1 OR lo <> hi")
        .select("obj_id", "v_lo", "v_hi", F.when(F.col("uses") == 1, "boundary").otherwise("turn").alias("kind"))
    )


def modality_jobs(items: DataFrame, resolution: int = RESOLUTION, default_samples: int = SAMPLES) -> DataFrame:
    """Four render jobs per item; an item's own ``render_samples`` is handed down."""
    kinds = F.array(*[F.struct(F.lit(m).alias("modality"), F.lit(f).alias("file")) for m, f in MODALITIES.items()])
    return items.select("*", F.inline(kinds)).select(
        "id", "modality", F.concat_ws("/", "output_path", "file").alias("target"), F.lit(resolution).alias("res_x"), F.lit(resolution).alias("res_y"),
        F.coalesce("render_samples", F.lit(default_samples)).alias("samples"),
    )
