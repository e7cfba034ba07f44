"""Even steps along curves: stretches of a curve move as single rows, and are sampled in numpy over Arrow batches where they are."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from meshlark.functions.skew import piece_of, running
from meshlark.functions.worker import ship

ship(__name__)
ENDS = [f"p{r}{c}" for r in range(4) for c in "xyz"]
#: points (rows, steps + 1, 3) of a batch of stretches, and which steps (rows, steps) there are
Sampler = Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]]


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def cubic(resolution: int) -> Sampler:
    """Samples of the cubics through the columns ENDS; handles are a sixth of the chord between a point's neighbours."""

    def sample(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        p0, p1, p2, p3 = (np.stack([_numbers(batch, f"p{r}{c}").astype(float) for c in "xyz"], 1)[:, None, :] for r in range(4))
        p0, p3 = np.where(np.isnan(p0), p1, p0), np.where(np.isnan(p3), p2, p3)
        h1, h2 = p1 + (p2 - p0) / 6.0, p2 - (p3 - p1) / 6.0
        t = (np.arange(resolution + 1) / float(resolution))[None, :, None]
        u = 1.0 - t
        points = u * u * u * p1 + 3.0 * u * u * t * h1 + 3.0 * u * t * t * h2 + t * t * t * p2
        return points, np.ones((len(points), resolution), bool)

    return sample


def listed(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The points of the column ``points``, lists of (k, x, y, z) by k; a step leads from k to k + 1."""
    lists = batch.column("points")
    start, size = lists.offsets.to_numpy()[:-1], np.diff(lists.offsets.to_numpy())
    fields = lists.values.flatten()
    at = np.minimum(start[:, None] + np.arange(max(size.max(initial=1), 2))[None, :], max(len(lists.values) - 1, 0))
    there = np.arange(at.shape[1])[None, :] < size[:, None]
    k = fields[0].to_numpy(zero_copy_only=False)[at]
    points = np.stack([f.to_numpy(zero_copy_only=False).astype(float)[at] for f in fields[1:]], 2)
    return points, there[:, 1:] & (k[:, 1:] == k[:, :-1] + 1)


def _along(points: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Arc length at the end of each step, from the start of its stretch; a step from or to no place has none."""
    step = np.sqrt(((points[:, 1:] - points[:, :-1]) ** 2).sum(2))
    return np.cumsum(np.where(there & ~np.isnan(step), step, 0.0), 1)


def _measured(sample: Sampler):
    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                points, there = sample(batch)
                lengths, steps = pa.array(_along(points, there)[:, -1]), pa.array(there.sum(1).astype(np.int64))
                yield pa.RecordBatch.from_arrays([*batch.columns, lengths, steps], [*batch.schema.names, "length", "steps"])

    return measured


def _frames(sample: Sampler, frame_count: int, frame_start: int):
    last = frame_count - 1

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            points, there = sample(batch)
            s0, s1, total, before, n = (_numbers(batch, c)[:, None] for c in ("s0", "s1", "total", "before", "n"))
            # the borders of neighbours are the same number, so each frame falls on one step
            ends = np.minimum(s0 + _along(points, there), s1)
            starts = np.concatenate([np.broadcast_to(s0, (len(ends), 1)), ends[:, :-1]], 1)
            number = before + np.cumsum(there, 1)
            rows, steps = np.nonzero(there)
            at, to, whole, number, n = starts[rows, steps], ends[rows, steps], total[rows, 0], number[rows, steps], n[rows, 0]
            # the last step of a stretch ends where the next one starts
            to = np.where(number == (before + there.sum(1, keepdims=True))[rows, 0], s1[rows, 0], to)
            safe = np.where(whole > 0, whole, 1.0)
            first = lambda s: np.ceil(s / safe * last).astype(np.int64)  # first frame at or after arc length s
            still = ~(whole > 0) | (last == 0)  # a path without length stays at its start, a single frame is there
            lo = np.where(still, 0, first(at))
            hi = np.where(still, np.where(number == 1, last, -1), np.where(number == n, last, first(to) - 1))
            count = np.maximum(hi - lo + 1, 0)
            of = np.repeat(np.arange(len(rows)), count)
            i = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + lo[of]
            share = i / max(last, 1)
            gap = (to - at)[of]
            t = np.where(gap > 0, (share * whole[of] - at[of]) / np.where(gap > 0, gap, 1.0), 0.0)[:, None]
            a, b = points[rows[of], steps[of]], points[rows[of], steps[of] + 1]
            place = a + (b - a) * t
            yield pa.RecordBatch.from_arrays(
                [batch.column("path_id").take(pa.array(rows[of])), pa.array((i + frame_start).astype(np.int32)),
                 *[pa.array(place[:, c], from_pandas=True) for c in range(3)]],
                ["path_id", "frame", "x", "y", "z"])

    return frames


def even_frames(stretches: DataFrame, sample: Sampler, frame_count: int, frame_start: int) -> DataFrame:
    """(path_id, frame, x, y, z) at even arc-length along stretches(path_id, seg, ..), of which ``sample`` gives the points.

    Lengths are summed over whole stretches; then each step gives the frames that fall on it, so frames and steps
    need no range join, and no point of the curve is moved.
    """
    kind = stretches.schema
    long = StructType([*kind.fields, StructField("length", DoubleType()), StructField("steps", LongType())])
    measured = stretches.mapInArrow(_measured(sample), long).filter("steps > 0")
    along = running(
        measured, ["path_id"], ["seg"], {"s1": F.col("length"), "upto": F.col("steps")}, {"s1": "total", "upto": "n"}, [piece_of("seg")],
        {"s1": "s0", "upto": "before"})
    out = StructType([kind["path_id"], StructField("frame", IntegerType()), *[StructField(c, DoubleType()) for c in "xyz"]])
    return along.mapInArrow(_frames(sample, frame_count, frame_start), out)
