"""Nearest triangles of a tile's points in numpy: boxes of points drop the triangles that cannot be nearest to any of them."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa

from meshlark.functions.worker import ship

ship(__name__)
PAIRS = 1 << 18  # pairs of a point and a triangle looked at together
FEWEST = 16  # points that are not parted any further
TRIED = 8  # triangles measured first, for a bound
CORNERS = ["ax", "ay", "az", "bx", "by_", "bz", "cx_", "cy_", "cz_"]
SINGLE, DOUBLE = 2e-6, 1e-12  # shares by which bounds are taken wider than rounding of floats, or of doubles, can make them wrong


def closest(p: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest place (3, n), squared distance, whether on the normal's side) of points (3, n) and triangles (9, n), pair by pair.

    The numbers are those of ``spatial.with_closest``, step by step.
    """
    a, b, c = t[0:3], t[3:6], t[6:9]
    dot = lambda u, v: u[0] * v[0] + u[1] * v[1] + u[2] * v[2]
    ab, ac = b - a, c - a
    pa_, pb, pc = p - a, p - b, p - c
    d1, d2, d3, d4, d5, d6 = dot(ab, pa_), dot(ac, pa_), dot(ab, pb), dot(ac, pb), dot(ab, pc), dot(ac, pc)
    va, vb, vc = d3 * d6 - d5 * d4, d5 * d2 - d1 * d6, d1 * d4 - d3 * d2
    part = np.select(
        [(d1 <= 0) & (d2 <= 0), (d3 >= 0) & (d4 <= d3), (vc <= 0) & (d1 >= 0) & (d3 <= 0), (d6 >= 0) & (d5 <= d6),
         (vb <= 0) & (d2 >= 0) & (d6 <= 0), (va <= 0) & (d4 - d3 >= 0) & (d5 - d6 >= 0)], [0, 1, 3, 2, 4, 5], 6)
    at = [part == k for k in range(7)]
    up = d4 - d3
    nv = np.select([at[1], at[3], at[5], at[6]], [1.0, d1, up, vb], 0.0)
    nw = np.select([at[2], at[4], at[5], at[6]], [1.0, d2, up, vc], 0.0)
    den = np.select([at[3], at[4], at[5], at[6]], [d1 - d3, d2 - d6, up + (d5 - d6), va + vb + vc], 1.0)
    none = den == 0
    den[none] = 1.0
    v, w = np.where(none, 0.0, nv / den), np.where(none, 0.0, nw / den)
    v = np.where(at[5], 1.0 - v, v)
    s = a + ab * v + ac * w
    o = p - s
    side = o[0] * (ab[1] * ac[2] - ab[2] * ac[1]) + o[1] * (ab[2] * ac[0] - ab[0] * ac[2]) + o[2] * (ab[0] * ac[1] - ab[1] * ac[0]) > 0
    return s, dot(o, o), side


def _bounds(t: np.ndarray, middle: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """What distances to triangles (9, m) are bounded by, seen from ``middle``, for points no further than ``reach`` from it.

    From below (11, m): box (0-5), unit normal and its offset (6-9, zero where it is not sure), slack for what is rounded (10).
    From above (15, m): corner, two edges, and what takes a place to its shares of them.
    """
    a, b, c = (t[k : k + 3] - middle[:, None] for k in (0, 3, 6))
    lo, hi = np.minimum(np.minimum(a, b), c), np.maximum(np.maximum(a, b), c)
    slack = (np.maximum(-lo, hi).max(0) + reach) * SINGLE + np.abs(middle).max() * DOUBLE
    ab, ac = b - a, c - a
    n = np.cross(ab, ac, axis=0)
    size2 = (n * n).sum(0)
    sure = size2 > 1e-12 * (ab * ab).sum(0) * (ac * ac).sum(0)
    size2 = np.where(sure, size2, 1.0)
    unit = np.where(sure, n / np.sqrt(size2), 0.0)
    shares = [np.where(sure, np.cross(*e, axis=0) / size2, 0.0) for e in ((ac, n), (n, ab))]
    return np.vstack([lo, hi, unit, (unit * a).sum(0), slack]).astype(np.float32), np.vstack([a, ab, ac, *shares]).astype(np.float32)


def _above(x: np.ndarray, some: np.ndarray) -> np.ndarray:
    """The distance of points (3, n) from a place on their triangle (15, n), pair by pair: a little more than the nearest."""
    o = x - some[0:3]
    v, w = (np.clip(o[0] * some[k] + o[1] * some[k + 1] + o[2] * some[k + 2], 0, 1) for k in (9, 12))
    both = np.maximum(v + w, 1)
    v /= both
    w /= both
    o -= some[3:6] * v + some[6:9] * w
    return np.sqrt(o[0] * o[0] + o[1] * o[1] + o[2] * o[2])


def _exact(points: np.ndarray, corners: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Squared distances of pairs, a piece at a time."""
    some = [closest(points[:, row[k : k + PAIRS]], corners[:, col[k : k + PAIRS]])[1] for k in range(0, len(row), PAIRS)]
    return np.concatenate(some) if some else np.zeros(0)


def _leaf(points, near, corners, below, above, t, most: float) -> tuple[np.ndarray, np.ndarray]:
    """(triangle or -1, squared distance) of points, also given as ``near``, among triangles ``t`` no further than ``most``."""
    n = points.shape[1]
    who, least = np.full(n, -1), np.full(n, np.inf)
    some = max(1, PAIRS // len(t))
    for since in range(0, n, some):
        x = near[:, since : since + some]
        k = x.shape[1]
        low = x.T @ below[6:9]
        low -= below[9]
        np.abs(low, out=low)
        for axis in range(3):
            np.maximum(low, below[axis] - x[axis, :, None], out=low)
            np.maximum(low, x[axis, :, None] - below[3 + axis], out=low)
        low -= below[10]
        first = np.argpartition(low, TRIED, axis=1)[:, :TRIED] if len(t) > TRIED else np.tile(np.arange(len(t)), (k, 1))
        pick = first.ravel()
        up = _above(np.repeat(x, first.shape[1], axis=1), above[:, t[pick]]) + below[10, pick]
        up = np.minimum(np.fmin.reduce(up.reshape(k, -1), axis=1) * (1 + SINGLE), most)
        row, col = np.nonzero(low <= up[:, None])
        if len(row) > 2 * pick.size:  # the bounds of these tell more
            np.minimum.at(up, row, (_above(x[:, row], above[:, t[col]]) + below[10, col]) * (1 + SINGLE))
            still = low[row, col] <= up[row]
            row, col = row[still], col[still]
        if not len(row):
            continue
        d2 = _exact(points[:, since : since + some], corners, row, t[col])
        rows, start = np.unique(row, return_index=True)
        best = np.minimum.reduceat(d2, start)
        same = np.flatnonzero(d2 == np.repeat(best, np.diff(np.append(start, len(row)))))
        rows, first = np.unique(row[same], return_index=True)  # of equals the one that stands first
        who[since + rows], least[since + rows] = t[col[same[first]]], d2[same[first]]
    return who, least


def nearest_of(points: np.ndarray, corners: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
    """(triangle or -1, squared distance) of points (3, n): the nearest of triangles (9, m), the first of equals, if within ``most``.

    Points are halved along their box's longest side. A box is no nearer to a triangle than their boxes are, nor than
    to its plane; no point of it is further from its nearest than its middle is, and half the diagonal.
    """
    n, m = points.shape[1], corners.shape[1]
    who, least = np.full(n, -1), np.full(n, np.inf)
    if not m or not n:
        return who, least
    lo, hi = points.min(1), points.max(1)
    middle = (lo + hi) / 2
    near = (points - middle[:, None]).astype(np.float32)
    below, above = _bounds(corners, middle, float((hi - lo).max()))
    todo = [(np.arange(n), np.arange(m), below, most * (1 + SINGLE))]
    while todo:
        p, t, low_of, within = todo.pop()
        x = near[:, p]
        lo, hi = x.min(1), x.max(1)
        mid, half = (lo + hi) / 2, (hi - lo) / 2
        box = np.maximum(low_of[0] - hi[0], lo[0] - low_of[3])
        for k in (1, 2):
            np.maximum(box, low_of[k] - hi[k], out=box)
            np.maximum(box, lo[k] - low_of[3 + k], out=box)
        normal = low_of[6:9]
        plane = np.abs(mid @ normal - low_of[9])
        score = np.maximum(box, plane)
        tried = np.argpartition(score, TRIED)[:TRIED] if len(t) > TRIED else np.arange(len(t))
        up = np.fmin.reduce(_above(mid[:, None], above[:, t[tried]]) + low_of[10, tried])
        within = min(within, (float(up) + math.sqrt(float(half @ half))) * (1 + SINGLE))
        plane -= half @ np.abs(normal)
        np.maximum(box, plane, out=box)
        box -= low_of[10]
        kept = np.flatnonzero(box <= within)
        if not len(kept):
            continue
        t, low_of = t[kept], np.take(low_of, kept, axis=1)
        if len(p) <= FEWEST or len(p) * len(t) <= PAIRS:
            who[p], least[p] = _leaf(points[:, p], x, corners, low_of, above, t, within)
            continue
        order = np.argpartition(x[int(np.argmax(half))], len(p) // 2)
        todo += [(p[order[: len(p) // 2]], t, low_of, within), (p[order[len(p) // 2 :]], t, low_of, within)]
    return who, least


def met(most: float):
    """A tile's (obj_id, pt_id, x, y, z) and the triangles near it: of each point that has one within ``most``, the nearest."""

    def meet(asked: pa.Table, tris: pa.Table) -> pa.Table:
        tris = tris.sort_by("tri_id").combine_chunks()
        numbers = lambda table, names: np.stack([table.column(c).to_numpy().astype(float) for c in names])
        points, corners = numbers(asked, "xyz"), numbers(tris, CORNERS)
        with np.errstate(all="ignore"):
            who, d2 = nearest_of(points, corners, most)
            done = np.flatnonzero((who >= 0) & (d2 <= most * most))
            s, d2, side = closest(points[:, done], corners[:, who[done]])
        one = lambda table, c, rows: table.column(c).take(pa.array(rows, pa.int64()))
        return pa.table({
            "obj_id": one(asked, "obj_id", done), "pt_id": one(asked, "pt_id", done), "tri_id": one(tris, "tri_id", who[done]),
            "d2": pa.array(d2), "side": pa.array(side), **{f"s{c}": pa.array(s[k]) for k, c in enumerate("xyz")}})

    return meet
