"""Nearest points of a tile's points among those in and around the tile, in numpy, so that no pair leaves its task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from meshlark.functions.worker import ship

ship(__name__)
PAIRS = 1 << 16  # pairs looked at together
TOGETHER = 128  # points that are not parted any further


def nearest(asked: np.ndarray, seen: np.ndarray, most: int, within: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of asked, row of seen, squared distance) of the ``most`` nearest of seen, by row, distance and place in seen.

    ``within``: squared distances that each of asked is known to have as many of seen in.
    """
    keep = min(most, len(seen))
    some = max(1, PAIRS // len(seen))
    found = []
    for since in range(0, len(asked), some):
        part = asked[since : since + some]
        d2 = np.zeros((len(part), len(seen)))
        for axis in range(3):
            gap = part[:, axis, None] - seen[:, axis]
            gap *= gap
            d2 += gap
        edge = np.partition(d2, keep - 1, axis=1)[:, keep - 1] if within is None else within[since : since + some]
        row, col = np.nonzero(d2 <= edge[:, None])  # more than ``keep`` where some are equally far
        dist = d2[row, col]
        order = np.lexsort((dist, row))  # a stable sort, so places in seen stay in order
        row, col, dist = row[order], col[order], dist[order]
        first = np.arange(len(row)) - np.searchsorted(row, np.arange(len(part)))[row] < keep
        found.append((row[first] + since, col[first], dist[first]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def nearest_in_boxes(asked: np.ndarray, seen: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``nearest`` where ``seen`` has all of ``asked``: points are halved, and what no point of a box can have among its nearest is dropped.

    Of ``most`` points or more in a box none is further from another than the diagonal.
    """
    lo, hi = asked.min(0), asked.max(0)
    todo, found = [(np.arange(len(asked)), np.arange(len(seen)))], []
    while todo:
        own, around = todo.pop()
        at, there, edge = asked[own], seen[around], None
        if len(own) >= most:
            lo, hi = at.min(0), at.max(0)
            edge = nearest(at, at, most)[2][most - 1 :: most] if len(own) <= TOGETHER else None
            far2 = ((hi - lo) ** 2).sum() if edge is None else edge.max()
            gap = np.maximum(np.maximum(lo - there, there - hi), 0.0)
            kept = np.flatnonzero((gap * gap).sum(1) <= far2 * (1 + 1e-9))
            around, there = around[kept], there[kept]
        if len(own) <= max(TOGETHER, most) or len(own) * len(around) <= PAIRS:
            row, col, d2 = nearest(at, there, most, edge)
            found.append((own[row], around[col], d2))
            continue
        order = np.argpartition(at[:, int(np.argmax(hi - lo))], len(own) // 2)
        todo += [(own[order[: len(own) // 2]], around), (own[order[len(own) // 2 :]], around)]
    row, col, d2 = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(row, kind="stable")
    return row[order], col[order], d2[order]


def _sorted(rows: pa.Table, most: int) -> tuple:
    """A tile's rows by id, those of its own, and of these (row, row of all, squared distance) of the nearest, where a point's begin, which are proven,
    and how far the last is, infinite where there are too few."""
    rows = rows.sort_by("pt_id").combine_chunks()
    xyz = np.stack([rows.column(c).to_numpy() for c in "xyz"], 1)
    sure = rows.column("sure").to_numpy()
    own = np.flatnonzero(~np.isnan(sure))
    sure = sure[own]
    with np.errstate(over="ignore"):
        row, col, d2 = nearest_in_boxes(xyz[own], xyz, most) if len(own) else (own, own, np.zeros(0))
    ends = np.searchsorted(row, np.arange(len(own) + 1))
    farthest = np.where(np.diff(ends) == most, d2[np.maximum(ends[1:] - 1, 0)], np.inf) if len(own) else np.zeros(0)
    return rows, xyz, own, col, d2, ends, np.isinf(sure) | (farthest <= sure * sure), farthest


def met(most: int):
    """Rows (obj_id, pt_id, x, y, z, sure) in and around a tile, ``sure`` for its own: each point with its nearest and whether none can be nearer."""

    def meet(rows: pa.Table) -> pa.Table:
        rows, _, own, col, d2, ends, proven, farthest = _sorted(rows, most)
        picked = rows.take(pa.array(col, pa.int64())).combine_chunks()
        whole = lambda x: x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
        parts = [pa.array(d2), *(whole(picked.column(c)) for c in ("pt_id", "x", "y", "z"))]
        near = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(parts, ["d2", "nb_id", "nx", "ny", "nz"]))
        asked = rows.take(pa.array(own, pa.int64()))
        return pa.table({**{c: asked.column(c) for c in ("obj_id", "pt_id", "x", "y", "z")}, "near": near, "proven": pa.array(proven), "far2": pa.array(farthest)})

    return meet


def pulled(most: int, damping: float):
    """Rows as for ``met``: each point of the tile moved towards the mean of its ``most`` nearest others, if these are proven."""

    def meet(rows: pa.Table) -> pa.Table:
        rows, xyz, own, col, d2, ends, proven, farthest = _sorted(rows, most + 1)
        owner = np.repeat(np.arange(len(own)), np.diff(ends))
        other = col != own[owner]
        owner, col = owner[other], col[other]
        start = np.searchsorted(owner, np.arange(len(own) + 1))
        count = np.minimum(np.diff(start), most)
        total = np.zeros((len(own), 3))
        for k in range(most):  # the nearest first, as the sum of a list goes
            has = np.flatnonzero(count > k)
            total[has] += xyz[col[start[has] + k]]
        at = xyz[own]
        some = (count > 0)[:, None]
        to = np.where(some, total / np.maximum(count, 1)[:, None], at)
        new = np.where(proven[:, None], at + (to - at) * damping, at)
        asked = rows.take(pa.array(own, pa.int64()))
        return pa.table({"obj_id": asked.column("obj_id"), "pt_id": asked.column("pt_id"), **{c: pa.array(new[:, k]) for k, c in enumerate("xyz")}, "proven": pa.array(proven), "far2": pa.array(farthest)})

    return meet
