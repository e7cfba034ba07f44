"""Consistent outward winding: which faces to turn so that neighbours agree and every part encloses a positive volume."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from meshlark.operators.mesh import rings
from meshlark.session import cut, moved

FACE = ["obj_id", "face_id"]


def face_links(loops: DataFrame) -> DataFrame:
    """(obj_id, face_id, other, odd): faces on both sides of an edge that two faces share, in both orders.

    ``odd`` is 1 where both run along the edge in the same direction, so that one of them must turn. Edges of
    one face, or of three and more, link nothing.
    """
    sides = rings(loops).filter(F.col("vert_id") != F.col("b")).select(
        *FACE, F.least("vert_id", "b").alias("v_lo"), F.greatest("vert_id", "b").alias("v_hi"), (F.col("vert_id") < F.col("b")).cast("int").alias("up"))
    pairs = sides.groupBy("obj_id", "v_lo", "v_hi").agg(
        F.min("face_id").alias("a"), F.max("face_id").alias("b"), F.sum("up").alias("ups"), F.count(F.lit(1)).alias("n")).filter("n = 2 AND a <> b")
    odd = (F.col("ups") != 1).cast("int")
    both = F.inline(F.array(F.struct(F.col("a").alias("face_id"), F.col("b").alias("other")), F.struct(F.col("b").alias("face_id"), F.col("a").alias("other"))))
    return pairs.select("obj_id", odd.alias("odd"), both).select(*FACE, "other", "odd").distinct()


def oriented_parts(faces: DataFrame, links: DataFrame) -> DataFrame:
    """(obj_id, face_id, part, odd): the smallest face of each connected part, and whether a face must turn to agree with it.

    Each round a face takes the smallest label of itself and its neighbours, with the turns on the way, then that
    label's own label; rounds are as many as the logarithm of the longest way. Where no choice satisfies all links
    (a one-sided surface) the turns are those of some way; ``winding_conflicts`` lists the links left.
    """
    links = cut(links, "links")
    state = cut(faces.select(*FACE, F.col("face_id").alias("part"), F.lit(0).alias("odd")).distinct(), "parts")
    while True:
        there = state.select("obj_id", F.col("face_id").alias("other"), "part", F.col("odd").alias("_odd"))
        near = links.join(moved(there), ["obj_id", "other"]).groupBy(*FACE).agg(
            F.min(F.struct("part", F.col("odd").bitwiseXOR(F.col("_odd")).alias("odd"))).alias("near"))
        taken = state.join(moved(near), FACE, "left").select(*FACE, F.col("part").alias("_was"), F.least(F.struct("part", "odd"), "near").alias("t"))
        home = state.select("obj_id", F.col("face_id").alias("_at"), F.col("part").alias("_part"), F.col("odd").alias("_odd"))
        jumped = taken.withColumn("_at", F.col("t.part")).join(moved(home), ["obj_id", "_at"])
        state = cut(jumped.select(*FACE, F.col("_part").alias("part"), F.col("t.odd").bitwiseXOR(F.col("_odd")).alias("odd"), "_was"), "parts")
        if state.filter("part <> _was").isEmpty():
            return state.drop("_was")


def outward_turns(loops: DataFrame, vertices: DataFrame) -> DataFrame:
    """(obj_id, face_id, part, turn): whether a face must be reversed.

    First all faces of a part are made to agree, then the part's signed volume, summed over fans seen from the
    mean of its corners, decides for the part as a whole. A closed part ends with its normals outwards; an open one
    with those pointing away from its middle; a part without volume keeps its smallest face as it is.
    """
    state = oriented_parts(loops, face_links(loops))
    place = vertices.select("obj_id", "vert_id", "x", "y", "z")
    corners = cut(loops.select(*FACE, "pos", "n", "vert_id").join(moved(place), ["obj_id", "vert_id"]).join(moved(state), FACE), "corners")
    middle = corners.groupBy("obj_id", "part").agg(*[F.avg(c).alias(f"m{c}") for c in "xyz"])
    at = {c: F.col(c) - F.col(f"m{c}") for c in "xyz"}
    seen = corners.join(moved(middle), ["obj_id", "part"]).select(*FACE, "part", "odd", "pos", "n", *[at[c].alias(c) for c in "xyz"])
    after = seen.select(*FACE, F.pmod(F.col("pos") - 1, F.col("n")).cast(loops.schema["pos"].dataType).alias("pos"), *[F.col(c).alias(f"n{c}") for c in "xyz"])
    first = seen.filter("pos = 0").select(*FACE, *[F.col(c).alias(f"f{c}") for c in "xyz"])
    fan = seen.filter("pos BETWEEN 1 AND n - 2").join(moved(after), [*FACE, "pos"]).join(moved(first), FACE)
    triple = (F.col("fx") * (F.col("y") * F.col("nz") - F.col("z") * F.col("ny")) + F.col("fy") * (F.col("z") * F.col("nx") - F.col("x") * F.col("nz"))
              + F.col("fz") * (F.col("x") * F.col("ny") - F.col("y") * F.col("nx")))
    volume = fan.groupBy("obj_id", "part").agg(F.sum(F.when(F.col("odd") == 1, -triple).otherwise(triple)).alias("volume"))
    return state.join(moved(volume), ["obj_id", "part"], "left").select(
        *FACE, "part", F.col("odd").bitwiseXOR((F.coalesce("volume", F.lit(0.0)) < 0).cast("int")).cast("boolean").alias("turn"))


def outward_winding(loops: DataFrame, vertices: DataFrame) -> DataFrame:
    """``loops`` with the rings of ``outward_turns`` reversed."""
    turns = outward_turns(loops, vertices).select(*FACE, "turn")
    return loops.join(moved(turns), FACE).withColumn("pos", F.when(F.col("turn"), F.col("n") - 1 - F.col("pos")).otherwise(F.col("pos"))).drop("turn")


def winding_conflicts(loops: DataFrame) -> DataFrame:
    """(obj_id, v_lo, v_hi, faces): edges along which faces still run in the same direction, or more than two meet."""
    sides = rings(loops).filter(F.col("vert_id") != F.col("b")).select(
        "obj_id", F.least("vert_id", "b").alias("v_lo"), F.greatest("vert_id", "b").alias("v_hi"), (F.col("vert_id") < F.col("b")).cast("int").alias("up"))
    met = sides.groupBy("obj_id", "v_lo", "v_hi").agg(F.count(F.lit(1)).alias("faces"), F.sum("up").alias("ups"))
    return met.filter("faces > 2 OR (faces = 2 AND ups <> 1)").drop("ups")
