"""Point sets: lattices, seeded jitter, weights, ordering, sampling on surfaces."""

from __future__ import annotations

from collections.abc import Sequence
from math import pi

from pyspark.sql import Column, DataFrame, functions as F

from meshlark.functions import vector as V
from meshlark.functions.noise import signed, uniform
from meshlark.functions.skew import piece_of, rank_within, running
from meshlark.operators.mesh import face_areas, local_bounds, tri_cross

MAX_DISTANCE = 1e9  # distances are clamped to [0, this] before they are normalised
RAMP = [(0.0, (0.0, 0.0, 1.0)), (0.5, (0.0, 1.0, 0.0)), (1.0, (1.0, 0.0, 0.0))]  # fixed colour stops: weight, rgb


# -- lattices ---------------------------------------------------------------


def _diagonal() -> Column:
    return V.length(tuple(F.col(f"max_{c}") - F.col(f"min_{c}") for c in "xyz"))


def lattice_number() -> Column:
    """The number of lattice point (ix, iy, iz) of a bounds row with ``spacing``."""
    last = lambda c: F.floor((F.col(f"max_{c}") - F.col(f"min_{c}")) / F.col("spacing")).cast("long")
    return (F.col("ix") * (last("y") + 1) + F.col("iy")) * (last("z") + 1) + F.col("iz")


def spaced_bounds(bounds: DataFrame, divisions: float) -> DataFrame:
    """Adds ``spacing``: each box's diagonal over ``divisions``."""
    return bounds.withColumn("spacing", _diagonal() / divisions)


def _lattice(bounds: DataFrame, inclusive: bool) -> DataFrame:
    """(obj_id, pt_id, ix, iy, iz, x, y, z, spacing) of each bounds row, which carries ``spacing``.

    The x planes are dealt out before they are filled, so one large box is
    filled by many tasks.
    """
    last = lambda c: F.floor((F.col(f"max_{c}") - F.col(f"min_{c}")) / F.col("spacing")).cast("long")
    planes = bounds.withColumn("ix", F.explode(F.sequence(F.lit(0).cast("long"), last("x")))).repartition("obj_id", "ix")
    filled = planes.withColumn("iy", F.explode(F.sequence(F.lit(0).cast("long"), last("y")))).withColumn(
        "iz", F.explode(F.sequence(F.lit(0).cast("long"), last("z")))
    )
    at = {c: F.col(f"min_{c}") + F.col(f"i{c}") * F.col("spacing") for c in "xyz"}
    pts = filled.withColumns(at)
    if not inclusive:
        for c in "xyz":
            pts = pts.filter((F.col(c) > F.col(f"min_{c}")) & (F.col(c) < F.col(f"max_{c}")))
    return pts.select("obj_id", lattice_number().alias("pt_id"), "ix", "iy", "iz", "x", "y", "z", "spacing")


def scatter_spacing(max_sdf: Column, threshold: float = 0.5) -> Column:
    return F.greatest(max_sdf * (0.05 + 0.2 * threshold), F.lit(1.0))


def grid_scatter(bounds: DataFrame, max_sdf: Column, threshold: float = 0.5) -> DataFrame:
    """Lattice from the box minimum, both ends included; spacing from the largest distance expected."""
    return _lattice(bounds.withColumn("spacing", scatter_spacing(max_sdf, threshold)), inclusive=True)


def volume_scatter(bounds: DataFrame, divisions: float = 200.0) -> DataFrame:
    """Lattice strictly inside each box, spaced by its diagonal over ``divisions``."""
    return _lattice(spaced_bounds(bounds, divisions), inclusive=False)


def scatter_outcome(points: DataFrame, bounds: DataFrame) -> DataFrame:
    """Per object: points kept and, below two, the failure text."""
    counts = points.groupBy("obj_id").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return bounds.select("obj_id").join(counts, "obj_id", "left").select(
        "obj_id", n.alias("n_points"), (n >= 2).alias("success"),
        F.when(n < 2, F.concat(F.lit("Only "), n.cast("string"), F.lit(" points inside (need >= 2)"))).alias("message"),
    )


def perturb(points: DataFrame, radius: Column | float, seed: int | None = 0, key: Sequence[str] = ("pt_id",)) -> DataFrame:
    """Move each point by a seeded offset, uniform in [-radius, radius) per axis."""
    return points.withColumns({c: F.col(c) + signed(seed, F.lit(c), *key) * radius for c in "xyz"})


# -- distance attributes ----------------------------------------------------


def box_sdf(inset: Column | float = 0.0) -> Column:
    """Signed distance to the row's box (min_x..max_z) shrunk by ``inset``; negative inside."""
    q = [
        F.abs(F.col(c) - (F.col(f"min_{c}") + F.col(f"max_{c}")) / 2) - ((F.col(f"max_{c}") - F.col(f"min_{c}")) / 2 - inset)
        for c in "xyz"
    ]
    zero = F.lit(0.0)
    out = V.length(tuple(F.greatest(e, zero) for e in q))
    return out + F.least(F.greatest(*q), zero)


def sdf_difference(points: DataFrame, bounds: DataFrame, divisions: float = 200.0) -> DataFrame:
    """Box minus geometry: adds ``diff`` = max(box, -sdf), the box drawn in by 1.5 voxels."""
    boxed = points.join(bounds, ["obj_id"])
    inset = _diagonal() / divisions * 1.5
    return boxed.withColumn("diff", F.greatest(box_sdf(inset), -F.col("sdf"))).select(*points.columns, "diff")


def estimated_max_sdf(bounds: DataFrame) -> DataFrame:
    side = F.least(*[F.col(f"max_{c}") - F.col(f"min_{c}") for c in "xyz"])
    return bounds.withColumn("max_sdf", side / 2.0)


def cull_sdf(points: DataFrame, keep: str = "outside") -> DataFrame:
    return points.filter(F.col("sdf") < 0 if keep == "inside" else F.col("sdf") >= 0)


def normalize_attr(points: DataFrame, attr: str = "sdf", out: str = "norm", by: Sequence[str] = (), spread: Sequence[str] = ("pt_id",)) -> DataFrame:
    """Clamp to [0, 1e9] and divide by the largest; 0 where that is 0. One combined maximum, no window."""
    clamped = F.least(F.greatest(F.col(attr), F.lit(0.0)), F.lit(MAX_DISTANCE))
    top = points.groupBy(*by).agg(F.max(clamped).alias("_top"))
    joined = points.join(top, list(by)) if by else points.withColumn("_top", top.scalar())
    return joined.withColumn(out, F.when(F.col("_top") > 0, clamped / F.col("_top")).otherwise(0.0)).drop("_top")


def random_weight(points: DataFrame, seed: int | None = 0, key: Sequence[str] = ("pt_id",), norm: str = "norm") -> DataFrame:
    return points.withColumn("weight", (1.0 - F.col(norm)) * uniform(seed, F.lit("weight"), *key))


def color_ramp(points: DataFrame, attr: str = "weight") -> DataFrame:
    """Linear colour between the fixed stops, alpha 1."""
    t = F.least(F.greatest(F.col(attr), F.lit(0.0)), F.lit(1.0))
    (p0, c0), (p1, c1), (p2, c2) = RAMP

    def channel(i: int) -> Column:
        low = c0[i] + (c1[i] - c0[i]) * ((t - p0) / (p1 - p0))
        high = c1[i] + (c2[i] - c1[i]) * ((t - p1) / (p2 - p1))
        return F.when(t < p1, low).otherwise(high)

    return points.withColumn("color", F.struct(*[channel(i).alias(n) for i, n in enumerate("rgb")], F.lit(1.0).alias("a")))


def cull_weight(points: DataFrame, threshold: float = 0.3) -> DataFrame:
    return points.filter(F.col("weight") >= threshold)


def cull_report(before: DataFrame, after: DataFrame, by: str = "obj_id") -> DataFrame:
    count = lambda df, name: df.groupBy(by).agg(F.count("*").alias(name))
    return count(before, "input_count").join(count(after, "output_count"), by, "left").select(
        by, "input_count", F.coalesce("output_count", F.lit(0)).alias("output_count")
    )


# -- centroid, order, waypoints ---------------------------------------------


def centroid(points: DataFrame, *by: str) -> DataFrame:
    """Mean position; without groups an empty set gives the origin."""
    return points.groupBy(*by).agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(f"c{c}") for c in "xyz"])


def order_by_angle(
    points: DataFrame, key: Sequence[str] = ("pt_id",), center: tuple[float, float] | None = None, clockwise: bool = True
) -> DataFrame:
    """Adds angle, ord (from 0) and n: order round z about the centroid or ``center``, ties by key."""
    if center is None:
        mids = centroid(points, "obj_id").select("obj_id", "cx", "cy")
        joined = points.join(mids, ["obj_id"])
    else:
        joined = points.withColumns({"cx": F.lit(center[0]), "cy": F.lit(center[1])})
    angled = joined.withColumn("angle", F.atan2(F.col("y") - F.col("cy"), F.col("x") - F.col("cx"))).drop("cx", "cy")
    first = F.col("angle").desc() if clockwise else F.col("angle").asc()
    sector = F.floor((-F.col("angle") if clockwise else F.col("angle")) * 4096)
    ranked = rank_within(angled, ["obj_id"], [first, *[F.col(k) for k in key]], "rn", size="n", pieces=[sector])
    return ranked.withColumn("ord", F.col("rn") - 1).drop("rn")


def pick_waypoints(ordered: DataFrame, count: int = 5) -> DataFrame:
    """Rows number int(i * n / count); all when there are no more than ``count``. A row decides for itself."""
    n, at = F.col("n"), F.col("ord")
    step = n / F.lit(float(count))
    index = F.when(n <= count, at)
    for i in range(count):
        index = index.when(at == F.floor(F.lit(float(i)) * step), F.lit(i).cast("long"))
    return ordered.withColumn("idx", index).filter(F.col("idx").isNotNull())


# -- sampling on surfaces ---------------------------------------------------


def _folded(r1: Column, r2: Column) -> tuple[Column, Column]:
    """Barycentric draws folded into the triangle."""
    over = r1 + r2 > 1.0
    return F.when(over, 1.0 - r1).otherwise(r1), F.when(over, 1.0 - r2).otherwise(r2)


def _on_triangle(r1: Column, r2: Column) -> dict[str, Column]:
    corner = {"x": ("ax", "bx", "cx"), "y": ("ay", "by_", "cy"), "z": ("az", "bz", "cz")}
    return {
        c: F.col(a) + r1 * (F.col(b) - F.col(a)) + r2 * (F.col(d) - F.col(a)) for c, (a, b, d) in corner.items()
    }


def area_weighted_sample(tris: DataFrame, draws: DataFrame, seed: int = 0) -> DataFrame:
    """One surface point for each draw (obj_id, draw): face chance by area, uniform within the face.

    Faces get the interval of the unit line their area share covers; the line
    is cut into as many buckets as the object has faces, and a draw meets only
    the faces of its bucket. That is about two face rows per bucket in all,
    whatever the areas. An object without faces gives the origin.
    """
    faces = running(face_areas(tris), ["obj_id"], ["tri_id"], {"hi": F.col("area"), "rn": F.lit(1).cast("long")}, {"hi": "total", "rn": "n"}, [piece_of("tri_id")])
    bucket = lambda c: F.least(F.floor(c * F.col("n")).cast("long"), F.col("n") - 1)
    last = F.col("rn") == F.col("n")
    spans = (
        faces.withColumn("lo", (F.col("hi") - F.col("area")) / F.col("total"))
        .withColumn("hi", F.when(last, 1.0).otherwise(F.col("hi") / F.col("total")))
        .withColumn("_b", F.explode(F.sequence(bucket(F.greatest("lo", F.lit(0.0))), bucket(F.col("hi")))))
    )
    sizes = faces.groupBy("obj_id").agg(F.max("n").alias("n"))
    drawn = draws.select("obj_id", "draw").join(sizes, ["obj_id"], "left").withColumn(
        "u", uniform(seed, F.lit("face"), "obj_id", "draw")
    )
    asked = drawn.withColumn("_b", bucket(F.col("u"))).drop("n")
    hit = spans.drop("n", "total", "area").join(asked.filter("_b IS NOT NULL"), ["obj_id", "_b"])
    first = F.col("rn") == 1
    chosen = hit.filter(((F.col("lo") < F.col("u")) | first & (F.col("u") <= 0)) & (F.col("u") <= F.col("hi")))
    # neighbouring intervals may overlap by rounding: the first face wins
    one = chosen.groupBy("obj_id", "draw").agg(F.min(F.struct("rn", "tri_id", "ax", "ay", "az", "bx", "by_", "bz", "cx", "cy", "cz")).alias("f"))
    r1, r2 = _folded(uniform(seed, F.lit("r1"), "obj_id", "draw"), uniform(seed, F.lit("r2"), "obj_id", "draw"))
    placed = one.select("obj_id", "draw", "f.*").withColumns(_on_triangle(r1, r2)).select("obj_id", "draw", "tri_id", "x", "y", "z")
    bare = asked.filter("_b IS NULL").select(
        "obj_id", "draw", F.lit(None).cast("long").alias("tri_id"), *[F.lit(0.0).alias(c) for c in "xyz"]
    )
    return placed.unionByName(bare)


def _scatter(counted: DataFrame, seed: int) -> DataFrame:
    """``n`` seeded points on each triangle."""
    each = counted.filter("n > 0").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    r1, r2 = _folded(uniform(seed, F.lit("r1"), "tri_id", "k"), uniform(seed, F.lit("r2"), "tri_id", "k"))
    return each.withColumns(_on_triangle(r1, r2)).select("obj_id", "tri_id", "k", "x", "y", "z")


def face_scatter(tris: DataFrame, radius: float, overlap: float = 0.7, seed: int = 0) -> DataFrame:
    """At least one point per face and enough for discs of ``radius`` to cover it."""
    disc = pi * radius * radius * overlap
    return _scatter(face_areas(tris).withColumn("n", F.greatest(F.lit(1).cast("long"), F.ceil(F.col("area") / disc).cast("long"))), seed)


def polygon_scatter(fans: DataFrame, radius: float, overlap: float = 0.7, seed: int = 0) -> DataFrame:
    """``face_scatter`` for polygons given as fan triangles (face_id, tri, corners).

    The count follows the whole face's area; each point then picks one of the
    face's fan triangles at random.
    """
    disc = pi * radius * radius * overlap
    fans = fans.withColumn("_a", V.length(tri_cross()) * 0.5)
    sized = fans.groupBy("obj_id", "face_id").agg(F.sum("_a").alias("area"), F.count("*").alias("n_tris")).filter("area > 0")
    n = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("area") / disc).cast("long"))
    points = sized.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    pick = F.floor(uniform(seed, F.lit("tri"), "face_id", "k") * F.col("n_tris"))
    picked = points.select("obj_id", "face_id", "k", pick.cast("long").alias("tri"))
    r1, r2 = _folded(uniform(seed, F.lit("r1"), "face_id", "k"), uniform(seed, F.lit("r2"), "face_id", "k"))
    corners = fans.withColumn("tri", F.col("tri").cast("long")).drop("_a")
    return (
        picked.join(corners, ["obj_id", "face_id", "tri"])
        .withColumns(_on_triangle(r1, r2))
        .select("obj_id", "face_id", "k", "x", "y", "z")
    )


def density_scatter(tris: DataFrame, density: float = 0.010, seed: int = 0) -> DataFrame:
    """Points at a fixed mean number per unit area; the fraction is a seeded coin."""
    want = F.col("area") * density
    coin = F.when(uniform(seed, F.lit("n"), "tri_id") < want - F.floor(want), 1).otherwise(0)
    return _scatter(face_areas(tris).withColumn("n", (F.floor(want) + coin).cast("long")), seed)


def tri_bounds(tris: DataFrame) -> DataFrame:
    """Box of each object's triangles."""
    corners = F.array(*[F.struct(*[F.col(n).alias(c) for n, c in zip(t, "xyz")]) for t in (("ax", "ay", "az"), ("bx", "by_", "bz"), ("cx", "cy", "cz"))])
    return local_bounds(tris.select("obj_id", F.inline(corners)), "obj_id")
