"""Lattices inside meshes: each lattice column meets the surface once, and what lies between is emitted as intervals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from meshlark.functions.worker import ship
from meshlark.operators.points import lattice_number, spaced_bounds
from meshlark.operators.spatial import SAME_SURFACE, distinct_tris
from meshlark.session import cut, spread

ship(__name__)
COLUMN = ["obj_id", "ix", "iy"]


def _steps(lo: Column, hi: Column, least: str, last: Column) -> Column:
    """Lattice numbers whose place may lie between ``lo`` and ``hi``: one more on each side, clipped to the box."""
    number = lambda c, off: F.floor((c - F.col(least)) / F.col("spacing")).cast("long") + off
    return F.explode(F.filter(F.sequence(number(lo, -1), number(hi, 1)), lambda i: (i >= 0) & (i <= last)))


def crossings(bounds: DataFrame, tris: DataFrame) -> DataFrame:
    """(obj_id, ix, iy, hz): where the vertical lines through the lattice of ``bounds`` (with ``spacing``) meet the object's triangles.

    Triangles name the columns they lie over, so the work is that of the crossings. Those that stand upright have none.
    """
    last = lambda c: F.floor((F.col(f"max_{c}") - F.col(f"min_{c}")) / F.col("spacing")).cast("long")
    at = lambda c: F.col(f"min_{c}") + F.col(f"i{c}") * F.col("spacing")
    met = spread(distinct_tris(tris), "obj_id", "tri_id").join(bounds, "obj_id")
    over = met.withColumn("ix", _steps(F.least("ax", "bx", "cx_"), F.greatest("ax", "bx", "cx_"), "min_x", last("x"))).withColumn(
        "iy", _steps(F.least("ay", "by_", "cy_"), F.greatest("ay", "by_", "cy_"), "min_y", last("y"))).withColumns({c: at(c) for c in "xy"})
    ux, uy, wx, wy = F.col("bx") - F.col("ax"), F.col("by_") - F.col("ay"), F.col("cx_") - F.col("ax"), F.col("cy_") - F.col("ay")
    px, py = F.col("x") - F.col("ax"), F.col("y") - F.col("ay")
    det = F.nullif(ux * wy - uy * wx, F.lit(0.0))
    hit = over.withColumn("v", (px * wy - py * wx) / det).withColumn("w", (ux * py - uy * px) / det).filter("v >= 0 AND w >= 0 AND v + w <= 1")
    return hit.select(*COLUMN, (F.col("az") + (F.col("bz") - F.col("az")) * F.col("v") + (F.col("cz_") - F.col("az")) * F.col("w")).alias("hz"))


def _odd(h: np.ndarray, first: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(odd, following) of heights that fall within each column, of which ``first`` is the place of a row's uppermost one.

    ``following`` is the lowest crossing more than SAME_SURFACE above, -1 where there is none: one that is no further
    up is not counted, the first one above a place always is. So the count from a crossing on is one more than that
    from its following one. The first ``len(known)`` rows have their answer already.
    """
    n = len(h)
    at = np.arange(n) - 1
    open_ = np.arange(n)
    while len(open_):
        open_ = open_[(at[open_] >= first[open_])]
        open_ = open_[~(h[at[open_]] > h[open_] + SAME_SURFACE)]
        at[open_] -= 1
    following = np.where(at >= first, at, -1)
    odd, up = np.append(np.ones(n, bool), False), np.append(np.where(following < 0, n, following), n)
    odd[: len(known)], up[: len(known)] = known, n
    while (up < n).any():  # the parity of the way up, by doubling
        odd, up = odd ^ odd[up], up[up]
    return odd[:-1], following


def inside_between(heights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lo, hi) of the stretches lo <= z < hi of one column from which an odd number of surfaces is met upwards."""
    h = np.sort(heights)[::-1]
    lo = np.append(h[1:], -np.inf)
    take = _odd(h, np.zeros(len(h), int), np.zeros(0, bool))[0] & (lo < h)
    return lo[take], h[take]


def _intervals(kind: pa.Schema):
    def intervals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (obj_id, ix, iy, hz) with the columns together and each falling; what a column needs further down is carried on."""
        held, known = None, np.zeros(0, bool)
        give = lambda rows, take, lo: pa.RecordBatch.from_arrays(
            [*(rows.column(k).filter(pa.array(take)) for k in range(3)), pa.array(lo[take]), rows.column(3).filter(pa.array(take))], schema=kind)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if held is None else pa.concat_batches([held, batch.cast(held.schema)])
            n, since = rows.num_rows, max(len(known) - 1, 0)
            other = np.zeros(n, bool)
            for k in range(3):
                other[1:] |= pc.not_equal(rows.column(k)[1:], rows.column(k)[:-1]).to_numpy(zero_copy_only=False)
            h = rows.column(3).to_numpy(zero_copy_only=False)
            first = np.maximum.accumulate(np.where(other, np.arange(n), 0))
            odd, following = _odd(h, first, known)
            lo = np.append(np.where(other[1:], -np.inf, h[1:]), -np.inf)
            take = odd & (lo < h)
            take[:since], take[-1] = False, False  # those given already, and the one whose lower end is yet to come
            yield give(rows, take, lo)
            # lower crossings follow one of those within SAME_SURFACE above the last, or the next one up
            top = following[-1] if len(known) < n and following[-1] >= 0 else first[-1]
            held, known = rows.slice(top), odd[top:]
        if held is not None:
            rows, odd = held.slice(held.num_rows - 1), known[-1:]
            yield give(rows, odd.copy(), np.array([-np.inf]))

    return intervals


def interior_intervals(bounds: DataFrame, tris: DataFrame) -> DataFrame:
    """(obj_id, ix, iy, lo, hi): the stretches of every lattice column that lie inside the object's surface.

    A column's crossings stream through a task from above, so no list of them is held.
    """
    met = spread(crossings(bounds, tris), *COLUMN).sortWithinPartitions(*COLUMN, F.desc("hz"))
    types = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}
    obj = met.schema["obj_id"].dataType.simpleString()
    kind = pa.schema([("obj_id", types[obj]), ("ix", pa.int64()), ("iy", pa.int64()), ("lo", pa.float64()), ("hi", pa.float64())])
    return met.mapInArrow(_intervals(kind), f"obj_id {obj}, ix long, iy long, lo double, hi double")


def interior_lattice(bounds: DataFrame, tris: DataFrame, inclusive: bool = False) -> DataFrame:
    """(obj_id, pt_id, ix, iy, iz, x, y, z, spacing): the lattice points of ``bounds`` (with ``spacing``) inside the surface.

    The points are those of the whole lattice, under the same numbers, from which an odd number of surfaces is met
    upwards; but only they are made: intervals are filled, no point is tested. ``inclusive`` takes the box's own sides.
    """
    bounds = cut(bounds, "bounds")  # by its files Spark knows it for the small side of the joins; what explode makes has no size
    between = interior_intervals(bounds, tris).join(bounds, "obj_id")
    at = {c: F.col(f"min_{c}") + F.col(f"i{c}") * F.col("spacing") for c in "xyz"}
    last = F.floor((F.col("max_z") - F.col("min_z")) / F.col("spacing")).cast("long")
    low, high = F.greatest("lo", "min_z"), F.least("hi", "max_z")
    pts = between.withColumn("iz", _steps(low, high, "min_z", last)).withColumns(at).filter("z >= lo AND z < hi")
    if not inclusive:
        for c in "xyz":
            pts = pts.filter((F.col(c) > F.col(f"min_{c}")) & (F.col(c) < F.col(f"max_{c}")))
    return pts.select("obj_id", lattice_number().alias("pt_id"), "ix", "iy", "iz", "x", "y", "z", "spacing")


def volume_scatter_inside(tris: DataFrame, bounds: DataFrame, divisions: float = 200.0) -> DataFrame:
    """``volume_scatter`` within the surface: lattice points spaced by the box's diagonal over ``divisions``."""
    return interior_lattice(spaced_bounds(bounds, divisions), tris)
