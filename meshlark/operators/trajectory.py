"""Keyframes, orbits, paths and timelines as tables of (path or object, frame) rows."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame, functions as F

from meshlark.functions import vector as V
from meshlark.functions.vector import rounded
from meshlark.operators import arcs

TOO_FEW_POSITIONS = "Path of fewer than two positions"
TOO_FEW_CONTROL_POINTS = "Curve of fewer than two control points"
SKIP_TEXT = ("Skipping ", ": Subject is animated.")


# -- animation state --------------------------------------------------------


def displacement(keyframes: DataFrame, order: str = "frame") -> DataFrame:
    """Distance between each object's first and last key by ``order``; 0 for a single frame."""
    ends = keyframes.groupBy("obj_id").agg(
        *[f(c, order).alias(f"{n}_{c}") for c in "xyz" for n, f in (("first", F.min_by), ("last", F.max_by))]
    )
    d = tuple(F.col(f"last_{c}") - F.col(f"first_{c}") for c in "xyz")
    return ends.select("obj_id", V.length(d).alias("displacement"), *[f"first_{c}" for c in "xyz"])


def animated(keyframes: DataFrame, threshold: float = 0.01, order: str = "frame") -> DataFrame:
    """Strictly more than ``threshold`` apart; a closed loop counts as static."""
    return displacement(keyframes, order).withColumn("animated", F.col("displacement") > threshold)


def has_animation(objects: DataFrame, keyframes: DataFrame) -> DataFrame:
    return objects.join(keyframes.select("obj_id").distinct(), "obj_id", "left_semi")


def split_animated(subjects: DataFrame, keyframes: DataFrame, threshold: float = 0.01, by: str = "frame") -> tuple[DataFrame, DataFrame]:
    """(static subjects with their start position, skip-log rows) of subjects (obj_id, filename)."""
    state = subjects.join(animated(keyframes, threshold, by), "obj_id", "left")
    moving = F.coalesce("animated", F.lit(False))
    start = [F.coalesce(f"first_{c}", F.lit(0.0)).alias(f"start_{c}") for c in "xyz"]
    log = F.concat(F.lit(SKIP_TEXT[0]), F.col("filename"), F.lit(SKIP_TEXT[1]))
    return state.filter(~moving).select("obj_id", "filename", *start), state.filter(moving).select("obj_id", log.alias("message"))


# -- generated paths --------------------------------------------------------


def orbit(centers: DataFrame, radius: float = 5.0, height: float = 2.0, frame_count: int = 360, frame_start: int = 1) -> DataFrame:
    """A full turn round (cx, cy, cz): one row per frame, the first not repeated at the end."""
    i = F.col("i")
    angle = F.lit(2.0 * pi) * i / F.lit(float(frame_count))
    keep = [c for c in centers.columns if c not in ("cx", "cy", "cz")]
    return centers.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(frame_count - 1)))).select(
        *keep, (i + frame_start).alias("frame"),
        (F.col("cx") + F.cos(angle) * radius).alias("x"),
        (F.col("cy") + F.sin(angle) * radius).alias("y"),
        (F.col("cz") + height).alias("z"),
    )


def static_orbit_jobs(
    static: DataFrame, modalities: tuple[str, ...] = ("rgb", "depth"), places: int | None = None, **orbit_args
) -> DataFrame:
    """Orbit frames round the origin for subjects moved there (``shift`` = minus their start), per modality.

    All subjects share the one orbit, so its frames are made, and rounded to ``places``, once, as are the subjects' shifts.
    """
    told = lambda c: c if places is None else rounded(c, places)
    moved = static.select("obj_id", "filename", *[told(F.lit(0.0) - F.col(f"start_{c}")).alias(f"shift_{c}") for c in "xyz"])
    origin = static.sparkSession.range(1).select(*[F.lit(0.0).alias(f"c{c}") for c in "xyz"])
    frames = orbit(origin, **orbit_args).select("frame", *[told(F.col(c)).alias(c) for c in "xyz"])
    frames = frames.withColumn("modality", F.explode(F.array(*[F.lit(m) for m in modalities])))
    held = frames.agg(F.collect_list(F.struct("frame", "x", "y", "z", "modality")).alias("jobs"))  # frames times modalities
    return moved.crossJoin(held).select("obj_id", "filename", *[f"shift_{c}" for c in "xyz"], F.inline("jobs"))


def _sized(waypoints: DataFrame) -> DataFrame:
    sizes = waypoints.groupBy("path_id").agg(F.count("*").alias("m"))
    return waypoints.join(sizes, ["path_id"])


def path_errors(waypoints: DataFrame, message: str = TOO_FEW_POSITIONS) -> DataFrame:
    """Paths with fewer than two points."""
    return waypoints.groupBy("path_id").agg(F.count("*").alias("m")).filter("m < 2").select("path_id", F.lit(message).alias("message"))


def curve_errors(control_points: DataFrame) -> DataFrame:
    """(path_id, message) of the curves that ``bezier_path`` has no segment for: those of one point."""
    return path_errors(control_points, TOO_FEW_CONTROL_POINTS)


def linear_path(waypoints: DataFrame, frame_count: int = 150, frame_start: int = 1) -> DataFrame:
    """Keys along straight segments; frames are shared evenly and the last is one past the scene's end.

    A frame on the border of two segments belongs to the later one, so each
    segment but the last leaves its end frame out and nothing is deduplicated.
    """
    here = _sized(waypoints.select("path_id", "idx", "x", "y", "z"))
    there = waypoints.select("path_id", (F.col("idx") - 1).alias("idx"), *[F.col(c).alias(f"n{c}") for c in "xyz"])
    seg = here.join(there, ["path_id", "idx"])
    per = F.lit(float(frame_count)) / (F.col("m") - 1)
    start = F.lit(frame_start) + F.floor(F.col("idx") * per).cast("int")
    end = F.lit(frame_start) + F.floor((F.col("idx") + 1) * per).cast("int")
    last = F.col("idx") == F.col("m") - 2
    frames = F.when(last, F.sequence("f0", "f1")).when(F.col("f1") > F.col("f0"), F.sequence(F.col("f0"), F.col("f1") - 1))
    t = (F.col("frame") - F.col("f0")) / F.greatest(F.col("f1") - F.col("f0"), F.lit(1))
    return (
        seg.withColumns({"f0": start, "f1": end})
        .withColumn("frame", F.explode(frames))
        .select("path_id", "frame", *[V.lerp(F.col(c), F.col(f"n{c}"), t).alias(c) for c in "xyz"])
    )


def segments(control_points: DataFrame) -> DataFrame:
    """(path_id, seg, p0x..p3z): the ends of each segment and their outer neighbours, null beyond the path's ends.

    Every point names the segments it takes part in, so they meet in one combined aggregate and a
    path of any length is spread by segment.
    """
    roles = F.array(*[F.struct(F.lit(shift).alias("shift"), F.lit(role).alias("role")) for shift, role in ((1, 0), (0, 1), (-1, 2), (-2, 3))])
    named = control_points.select("path_id", "idx", "x", "y", "z", F.inline(roles)).withColumn("seg", F.col("idx") + F.col("shift"))
    at = lambda role, c: F.max(F.when(F.col("role") == role, F.col(c)))
    return (
        named.groupBy("path_id", "seg")
        .agg(*[at(r, c).alias(f"p{r}{c}") for r in range(4) for c in "xyz"])
        .filter("p1x IS NOT NULL AND p2x IS NOT NULL")
    )


def bezier_path(control_points: DataFrame, resolution: int = 64) -> DataFrame:
    """(path_id, k, x, y, z): the smooth cubic through the control points, ``resolution`` samples per segment plus the end.

    Handles are a sixth of the chord between a point's neighbours.
    """
    final = F.col("p3x").isNull()  # the last segment also gives the path's end
    steps = F.when(final, F.sequence(F.lit(0), F.lit(resolution))).otherwise(F.sequence(F.lit(0), F.lit(resolution - 1)))
    t = F.col("j") / F.lit(float(resolution))
    u = 1.0 - t
    coords = {}
    for c in "xyz":
        p0, p1, p2, p3 = F.coalesce(f"p0{c}", f"p1{c}"), F.col(f"p1{c}"), F.col(f"p2{c}"), F.coalesce(f"p3{c}", f"p2{c}")
        h1, h2 = p1 + (p2 - p0) / 6.0, p2 - (p3 - p1) / 6.0
        coords[c] = u * u * u * p1 + 3.0 * u * u * t * h1 + 3.0 * u * t * t * h2 + t * t * t * p2
    return segments(control_points).withColumn("j", F.explode(steps)).select(
        "path_id", (F.col("seg") * resolution + F.col("j")).alias("k"), *[e.alias(c) for c, e in coords.items()]
    )


STRETCH = 64  # steps of a curve that move as one row


def follow_path(curve: DataFrame, frame_count: int = 150, frame_start: int = 1) -> DataFrame:
    """Positions at even arc-length steps along curve(path_id, k, x, y, z), one per frame.

    The curve moves once, into stretches that share their border points.
    """
    number = F.floor(F.col("k") / STRETCH).cast("long")
    homes = F.when(F.col("k") % STRETCH == 0, F.array(number - 1, number)).otherwise(F.array(number))
    placed = curve.select("path_id", F.struct(F.col("k").cast("long").alias("k"), "x", "y", "z").alias("p"), F.explode(homes).alias("seg"))
    stretches = placed.groupBy("path_id", "seg").agg(F.array_sort(F.collect_list("p")).alias("points"))
    return arcs.even_frames(stretches, arcs.listed, frame_count, frame_start)


def follow_bezier(control_points: DataFrame, resolution: int = 64, frame_count: int = 150, frame_start: int = 1) -> DataFrame:
    """``follow_path`` of ``bezier_path``: a segment moves with its four control points and is sampled where it is."""
    return arcs.even_frames(segments(control_points), arcs.cubic(resolution), frame_count, frame_start)


def frame_timeline(clips: DataFrame, fps: int = 30, frame_start: int = 1, default_end: int = 150) -> DataFrame:
    """One row per frame with its time; a clip's own ``frame_count`` counts if it is truthy."""
    n = F.col("frame_count")
    end = F.when(n.isNotNull() & (n > 0), n + (frame_start - 1)).otherwise(F.lit(default_end)).cast("int")
    keep = [c for c in clips.columns if c != "frame_count"]
    return clips.withColumn("frame", F.explode(F.sequence(F.lit(frame_start), end))).select(
        *keep, "frame", ((F.col("frame") - frame_start) / F.lit(float(fps))).alias("seconds")
    )


def aim_angles(dx: Column, dy: Column, dz: Column) -> tuple[Column, Column]:
    """(pitch, yaw) turning -Z to the direction: about X first, then Z."""
    return F.atan2(F.sqrt(dx * dx + dy * dy), -dz), F.atan2(-dx, dy)


def look_at(eyes: DataFrame, targets: DataFrame, by: str = "obj_id", spread: tuple[str, ...] = ("frame",)) -> DataFrame:
    """Adds the unit direction and angles from each eye to its group's target (tx, ty, tz)."""
    joined = eyes.join(targets.select(by, "tx", "ty", "tz"), [by])
    d = tuple(F.col(f"t{c}") - F.col(c) for c in "xyz")
    size = F.nullif(V.length(d), F.lit(0.0))
    unit = joined.withColumns({f"d{c}": F.coalesce(e / size, F.lit(0.0)) for c, e in zip("xyz", d)})
    pitch, yaw = aim_angles(F.col("dx"), F.col("dy"), F.col("dz"))
    return unit.withColumns({"pitch": pitch, "yaw": yaw}).drop("tx", "ty", "tz")
