"""Camera candidates and paths: the procedural-camera flow as a chain of transforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from meshlark.operators import points as P, spatial as S
from meshlark.session import cut

SPLINE_POINTS = 5
POINT_WAYPOINTS = 3


def scored_candidates(tris: DataFrame, divisions: float = 200.0, seed: int | None = 0) -> DataFrame:
    """Jittered lattice points outside each object's surface with distance, normalised distance and weight.

    The distance is found once, saved with the points and used for both the
    cull and the weight.
    """
    bounds = P.tri_bounds(tris)
    lattice = P.volume_scatter(bounds, divisions)
    key = ["obj_id", "pt_id"]
    jittered = P.perturb(lattice, F.col("spacing") * 0.4, seed, key)
    measured = cut(S.signed_distance(jittered, tris), "sdf")
    outside = P.cull_sdf(measured)
    return P.normalize_attr(outside, by=["obj_id"]).transform(P.random_weight, seed, key)


def camera_candidates(tris: DataFrame, divisions: float = 200.0, threshold: float = 0.3, seed: int | None = 0) -> DataFrame:
    """Candidates kept by weight, in angular order, with the waypoint number of those picked."""
    kept = P.cull_weight(scored_candidates(tris, divisions, seed), threshold)
    ordered = cut(P.order_by_angle(kept), "ordered")
    picks = P.pick_waypoints(ordered, SPLINE_POINTS).select("obj_id", "pt_id", "idx")
    return ordered.join(picks, ["obj_id", "pt_id"], "left")


def control_points(candidates: DataFrame) -> DataFrame:
    """(obj_id, idx, x, y, z) of the picked waypoints."""
    return candidates.filter(F.col("idx").isNotNull()).select("obj_id", "idx", "x", "y", "z")


def repair_surface(tris: DataFrame, radius: float, voxel: float, overlap: float = 0.045, iterations: int = 4, seed: int = 0) -> DataFrame:
    """Scatter over faces, even out, blow up to spheres and take the surface: a closed stand-in for open faces."""
    pts = P.face_scatter(tris, radius, overlap, seed)
    numbered = pts.select("obj_id", scatter_id(F.col("tri_id"), F.col("k")).alias("pt_id"), "x", "y", "z")
    return S.iso_surface_faces(S.points_to_sdf(S.lloyd_relax(numbered, iterations), radius, voxel))


def scatter_id(tri: Column, k: Column) -> Column:
    """Unique id of the k-th point of a triangle: triangle number and k joined as a wide decimal."""
    return tri.cast("decimal(19,0)") * F.lit(10**12).cast("decimal(13,0)") + k.cast("decimal(19,0)")
